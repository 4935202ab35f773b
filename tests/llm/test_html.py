import re

import pytest

from tidewatch.llm import html_text as H

TEXT = "A first paragraph that is long enough to matter. " * 3


def page(body, head="<title>t</title><style>p{}</style><script>var t=\"</p>\";</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_article_without_the_rest():
    x = page(f'<header><p>Site</p></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad 3 --><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>{TEXT}<br><p>Two&nbsp;&#228; \n three</p><div class="comments"><p>Nice!</p></div><form><p>Name</p></form></article><aside>side</aside><footer>&copy; x</footer>')
    assert H.extract(x) == "Head & line\n\n" + TEXT.strip() + "\n\nTwo ä three"
    assert H.extract(x[: x.index("<aside>")]) == H.extract(x)
    assert H.extract(None) == H.extract("") == H.extract("<html><nav>x</nav></html>") == ""
    assert H.extract("plain < text") == "plain < text"


def test_without_article_the_text_decides():
    x = page(f'<div id="top"><a href="/">Home</a> <a href="/b">More</a></div><div class="wrap"><div class="story"><p>{TEXT}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></div><div class="sidebar"><p>{TEXT}</p></div></div>')
    assert H.extract(x) == TEXT.strip() + "\n\none\n\ntwo\n\na\n\nb"


def test_misnested_and_odd_markup():
    assert H.extract('<article><p>a<i>b</p>c</i><p title="x > y">d</article><p>e') == "ab\n\nc\n\nd"
    assert H.extract("<article><p>x <script>if (a<b) '</article>'</script> y</p></article>") == "x y"
    H.extract("<" * 3000 + "<p" * 3000 + "</div>" * 3000 + "<div>" * 3000)


def test_template_of_a_host(spark):
    """A host's main slot is found over its pages where a page alone could mislead."""
    rows = []
    for k in range(12):
        long, short = (f"Body {k} " + TEXT, "Teaser") if k else ("Short body.", TEXT * 2)
        rows.append((k, "http://one.example/x", page(f'<div class="box"><p>{short}</p></div><div class="text"><p>{long}</p></div>'), "clash"))
    rows += [(20, "http://two.example/", page(f"<article><p>{TEXT}</p></article>"), None), (21, None, None, None), (20, "http://two.example/", page(f"<article><p>{TEXT}</p></article>"), None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract_pages(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 15 and by[0].text == "Short body." and by[20].text == TEXT.strip() and by[21].text == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert H.extract_pages(df.limit(0)).count() == 0


def boiler(k):
    own = f"Story number {k} has words of its own, {k * 7} and {k * 13} among them, and goes on."
    return f'<div><div class="x1"><p>The same first line</p><p>The same second line</p></div><div class="x2"><p>{own}</p></div><div class="x3">The same last line</div></div>', own


def hosts(spark, bodies):
    return spark.createDataFrame([(k, "http://plain.example/", f"<html><body>{b}</body></html>") for k, b in enumerate(bodies)], "page_id long, url string, html string")


def test_boilerplate_is_found_by_classes_not_by_names(spark):
    bodies = [boiler(k) for k in range(12)]
    df = hosts(spark, [b for b, _ in bodies])
    assert {r.page_id: r.text for r in H.extract_pages(df.unionByName(df.limit(3))).collect()} == {k: own for k, (_, own) in enumerate(bodies)}


def test_text_in_a_class_without_markup_stays(spark, monkeypatch):
    """A paragraph on most pages has a vector that no markup has; were all vectors equal, it would count as template."""
    bodies = [boiler(k) for k in range(12)]
    often = "A quotation that many of the stories have."
    df = hosts(spark, [b.replace("</p></div><div class=\"x3\">", f"</p><p>{often}</p></div><div class=\"x3\">") if k % 3 else b for k, (b, _) in enumerate(bodies)])
    want = {k: own + (f"\n\n{often}" if k % 3 else "") for k, (_, own) in enumerate(bodies)}
    assert {r.page_id: r.text for r in H.extract_pages(df).collect()} == want
    with monkeypatch.context() as m:
        m.setattr(H.F, "bit_xor", lambda c: H.F.max(H.F.lit(0).cast("long")))
        assert {r.page_id: r.text for r in H.extract_pages(df).collect()} != want


def test_a_class_out_of_order_is_no_template(spark):
    """Two lines that change places are not of the template, though they stand on every page."""
    bodies = []
    for k in range(12):
        lines = ["<p>An answer that comes first or last.</p>", "<p>A question that comes last or first.</p>"]
        bodies.append(f"<div><p>Own text of page {k}, which is long enough to be most of what is left, {k * 31}.</p>{''.join(lines[:: 1 if k % 2 else -1])}</div>")
    got = {r.page_id: r.text for r in H.extract_pages(hosts(spark, bodies)).collect()}
    assert all("An answer" in x and "A question" in x for x in got.values())


def test_copies_of_one_article_keep_their_text(spark):
    same = "".join(f"<p>Paragraph {i} of an article that all pages have, word for word.</p>" for i in range(20))
    got = {r.page_id: r.text for r in H.extract_pages(hosts(spark, [f"<article>{same}<p>{k}</p></article>" for k in range(8)])).collect()}
    assert all("Paragraph 7 of" in x and x.endswith(f"\n\n{k}") for k, x in got.items())


@pytest.mark.parametrize("piece", ["<a ", "<button>", '<div class="', "<div>", "<p>", "<li>", "</div>", "<td>", "<!--", "</script ", "<script>", '<a "> ', "<b \"'>", "<div></p>", "&", "<"])
def test_reading_takes_linear_time(piece):
    import time

    for tail in ("", ">", '">', "</p>"):
        x = piece * (1_000_000 // len(piece)) + tail
        began = time.process_time()
        H.extract(x)
        assert time.process_time() - began < 15


def test_joined_by_host_when_there_are_many(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"https://h{k % 5}.example:80/?q", page(f"<article><p>{k} {TEXT}</p></article>")) for k in range(40)], "page_id long, url string, html string")
    few = {r.page_id: r.text for r in H.extract_pages(df).collect()}
    monkeypatch.setattr(H, "MOST_BROADCAST", 0)
    assert {r.page_id: r.text for r in H.extract_pages(df).collect()} == few


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_generated_pages_equal_a_plain_reading(spark, folder):
    import html
    import os

    if not os.path.exists(f"{folder}/pages.parquet"):
        pytest.skip("no test data")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r.page_id: r.text for r in H.extract_pages(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", inner))]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)
