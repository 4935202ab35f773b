import hashlib
import random
import re

import tidewatch.llm.decontaminate as D
from tests.llm.helpers import docs, write_docs


def plain(text, items):
    w = [x.lower() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    hit, found = set(), set()
    for item, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(10, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def cases(seed, letters="ab"):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 2)))
    items = [(i, " ".join(word() for _ in range(r.choice([3, 9, 10, 11, 14, 30])))) for i in range(12)]
    items += [(100, items[-1][1]), (101, ""), (102, None), (103, "...")]
    text = []
    for _ in range(60):
        parts = [word() for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            v = (r.choice(items)[1] or "x").split()
            a = r.randrange(len(v) or 1)
            parts += v[a : a + r.randint(1, 25)]
        text.append(r.choice([" ", ", ", "\n"]).join(parts).title())
    return [None, "", *text], items


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    for k, words in ((0, 10**6), (1, 25)):
        monkeypatch.setattr(D, "BLOCK_WORDS", words)
        text, items = cases(k, "ab" if k else "abcdefgh")
        folder = write_docs(spark, tmp_path / str(k), text)
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        for r in D.op3_decontamination(spark, folder).collect():
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == plain(text[r.doc_id], items), text[r.doc_id]


def test_spans_are_cut(spark):
    item = "one two three four five six seven eight nine ten eleven"
    text = ["Start, " + item + "; end " + "more words here " * 5, "clean é words", item, None, ""]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in D.decontaminate(docs(spark, text), bench).collect()}
    assert got == {0: "Start, ; end " + "more words here " * 5, 1: "clean é words", 3: None, 4: ""}
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contamination(docs(spark, text), none).where("size(spans) > 0").count() == 0
    assert D.decontaminate(docs(spark, []), bench).count() == 0


def test_a_text_read_in_parts_gives_the_same():
    for seed in range(6):
        text, items = cases(seed, "abc")
        own = D.SuffixAutomaton([(str(i), D.words(t)) for i, t in items])
        for x in text:
            whole = own.matches(D.words(x))
            for most in (1, 7, 30):
                found = D.Matches(own)
                for part, last in D.parts(x or "", most):
                    found.read(D.words(part), last)
                assert (found.spans, found.items, found.n_words) == (*whole, len(D.words(x)))


def test_null_and_repeated_item_ids(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(None, item), (7, item), (7, item + " eleven")], "item_id long, text string")
    got = D.find_contamination(docs(spark, [item, "x"]), bench).collect()
    assert {r.doc_id: r["items"] for r in got} == {0: ["7", None], 1: []}
