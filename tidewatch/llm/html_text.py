"""Main text of web pages by equivalence-class template deduction.

A page is read once into tokens: structural elements in their role (the path of elements from the root, each
with its first class) and blocks of text in their role.  Over the different pages of a host every token has
an occurrence vector: how often it stands on each page.

1. Tokens with equal vectors on at least ``SUPPORT`` of the host's pages form an equivalence class.
2. A class is valid if it holds markup and its tokens that stand once on each of their pages keep one order
   on all of them; roles being paths, its tokens nest in those of the classes above it.
3. Valid classes are the host's template.  Their text is boilerplate, whatever its elements are called; what
   remains between template tokens are the slots.  The main slot is the deepest template role under which
   nearly all remaining unlinked text lies; where an ``article`` or ``main`` element has most of it, that one.
4. The remaining blocks of the main slot are returned, in page order, without those in elements that say
   they are no article: menus, headers, footers, sidebars, notices, adverts, forms and reader comments.

Vectors are known by the exclusive-or of a hash of (page, count), so they are aggregated with partial sums and
no host is ever in one place; exact copies of a page count once.  Where template text would be nearly all text,
the pages are copies of one article, and the text stays.  Templates are broadcast while they are few, else
joined by host, with hot hosts salted.  A host of fewer than ``LEAST_PAGES`` different pages has no vectors to
compare: there, and on a page without its host's main slot, the page is its own template.

Null, empty and textless pages give the empty text.  Unclosed and misnested elements end where their parent
ends; a page cut short ends all; elements nested deeper than ``DEPTH`` count as part of those above.  Pages
without a url share one host.  Repeated rows give a row each; an empty table gives none.  Reading takes time
in proportion to the page, whatever stands in it; a page is held whole.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.llm.texts import only, slices
from tidewatch.runtime import cut, ship

MOST_BROADCAST = 5_000_000  # template tokens, of 8 bytes
SUPPORT, COVER, LEAST_PAGES, COPIES, DEPTH, SALTED = 0.5, 0.8, 3, 0.9, 512, 2000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_UNQUOTED = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|(?!)()()", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
# fixed values: element names of the HTML standard
_RAW = frozenset("script style textarea title noscript template iframe svg math object select xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_STRUCTURE = frozenset("html head body div section article main aside nav header footer form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary hgroup dialog menu center".split())
_CLOSES_P = _STRUCTURE - {"html", "head", "body"} | {"hr"}
_ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}}
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre".split())
_APART = frozenset("head nav footer aside form button dialog menu fieldset".split())
_APART_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo|banner|menu|nav(?:bar|igation)?|breadcrumbs?|sidebar|footer|masthead|topbar|header|"
    r"cookies?|consent|notice|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend(?:ed|ations)?|widget|comments?|disqus|replies|respond|pagination|pager|skip)(?:$|[\s_-])",
    re.I,
)
_APART_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|respond)(?:$|[\s_-])", re.I)


_NAMES = [*sorted(_STRUCTURE), None]  # elements by number; the last, -1, stands for text
_NUMBER = {x: i for i, x in enumerate(_NAMES[:-1])} | {None: -1}


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


class Page:
    """``nodes``: (role, parent's number or -1, name) of each structural element; ``blocks``: (node, text, apart, linked characters)."""

    def __init__(self, page: str):
        self.nodes: list[tuple[int, int, str]] = []
        self.blocks: list[tuple[int, str, bool, int]] = []
        self.order: list[tuple[bool, int]] = []  # (is a block, its number)
        self._read(page)

    def _read(self, page: str) -> None:
        nodes, blocks, order = self.nodes, self.blocks, self.order
        stack: list[tuple[str, int, bool, bool, bool]] = []  # element, node, apart, within comments or the like, within an article
        opened: Counter = Counter()
        buffer: list[str] = []
        linked, links = 0, False

        def text(a: int, b: int) -> None:
            nonlocal linked
            if b > a:
                piece = page[a:b]
                buffer.append(_html.unescape(piece) if "&" in piece else piece)
                linked += (b - a) * links

        def flush() -> None:
            nonlocal linked
            if buffer:
                joined = " ".join("".join(buffer).split())
                if joined:
                    order.append((True, len(blocks)))
                    blocks.append((stack[-1][1] if stack else -1, joined, stack[-1][2] if stack else False, min(linked, len(joined))))
                buffer.clear()
                linked = 0

        def close(k: int) -> None:
            flush()
            for x in stack[k:]:
                opened[x[0]] -= 1
            del stack[k:]

        at, end, last, token, endless = 0, len(page), page.rfind(">") + 1, _TOKEN, set()
        while at < end:
            m = token.search(page, at, last)
            if m is None:
                text(at, end)
                break
            text(at, m.start())
            at = m.end()
            if m[4]:  # quotes that do not end: from here on they are no quotes
                token = _UNQUOTED
            name = (m[2] or m[4] or "").lower()
            if not name:
                continue
            if m[1]:
                if name == "a":
                    links = False
                elif opened[name] > 0:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            close(k)
                            break
                        if stack[k][0] in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "div", "article", "main", "section"):
                            break
                continue
            if name in _RAW or name == "button":
                over = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at, last)
                if over:
                    at = page.index(">", over.end()) + 1
                elif name in _RAW:
                    at = end
                else:
                    endless.add(name)
                continue
            if name == "br":
                buffer.append(" ")
            if name == "a":
                links = True
            if name not in _STRUCTURE and name != "hr":
                continue
            flush()
            if name in _CLOSES_P and opened["p"] > 0:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in _STRUCTURE:
                        break
            if name in _ALIKE and any(opened[x] > 0 for x in _ALIKE[name]):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in _STOPS[name]:
                        break
                    if stack[k][0] in _ALIKE[name]:
                        close(k)
                        break
            if name == "hr" or len(stack) >= DEPTH:
                continue
            given = m[3] or m[5] or ""
            named = {a.lower(): (v or "").strip("\"'") for a, v in _ATTRIBUTE.findall(given)} if given else {}
            kind = named.get("class", "")
            own = f"{kind} {named.get('id', '')}"
            _, above, above_apart, above_within, in_article = stack[-1] if stack else ("", -1, False, False, False)
            comments = bool(_COMMENTS.search(own))
            within = above_within or name in ("nav", "aside", "footer", "form") or comments
            apart = name in _APART or (name == "header" and not in_article) or named.get("role", "").lower() in _APART_ROLE or named.get("aria-hidden") == "true" or "hidden" in named or "display:none" in named.get("style", "").replace(" ", "")
            apart = apart or (name not in ("html", "body", "article", "main") and bool(_APART_NAME.search(own))) or (name in ("article", "main") and comments)
            if name in ("article", "main") and not apart:
                apart = above_within
            elif above_apart:
                apart = True
            first = kind.split()[0] if kind.strip() else ""
            role = _hash(f"{nodes[above][0] if above >= 0 else ''}/{name}.{first}")
            order.append((False, len(nodes)))
            stack.append((name, len(nodes), apart, within, in_article or name in ("article", "main")))
            nodes.append((role, above, name))
            opened[name] += 1
        flush()

    def block_token(self, i: int) -> int:
        node, words, _, _ = self.blocks[i]
        return _hash(f"{self.nodes[node][0] if node >= 0 else ''}\0{words}")

    def tokens(self) -> list[tuple[int, int | None, str | None, int, int, int]]:
        """Of each different token: (token, role above it, element or None for text, count, usable characters and linked ones below it)."""
        below = [[0, 0] for _ in self.nodes]
        out: dict[int, list] = {}
        for i, (node, words, apart, linked) in enumerate(self.blocks):
            size = (0, 0) if apart else (len(words), linked)
            x = out.setdefault(self.block_token(i), [self.nodes[node][0] if node >= 0 else None, None, 0, 0, 0])
            x[2] += 1
            x[3] += size[0]
            x[4] += size[1]
            if node >= 0:
                below[node][0] += size[0]
                below[node][1] += size[1]
        for k in range(len(self.nodes) - 1, -1, -1):
            role, above, name = self.nodes[k]
            if above >= 0:
                below[above][0] += below[k][0]
                below[above][1] += below[k][1]
            x = out.setdefault(role, [self.nodes[above][0] if above >= 0 else None, name, 0, 0, 0])
            x[2] += 1
            x[3] += below[k][0]
            x[4] += below[k][1]
        return [(token, *x) for token, x in out.items()]

    def sequence(self) -> list[int]:
        return [self.block_token(i) if is_block else self.nodes[i][0] for is_block, i in self.order]

    def text(self, main: int | None, boilerplate: frozenset | set) -> str:
        """The usable blocks in the main slot, or all usable ones if it is empty."""
        usable = [i for i, b in enumerate(self.blocks) if not b[2] and not (boilerplate and self.block_token(i) in boilerplate)]
        inside = []
        for role, above, _ in self.nodes:
            inside.append(role == main or (above >= 0 and inside[above]))
        kept = [i for i in usable if self.blocks[i][0] >= 0 and inside[self.blocks[i][0]]]
        return "\n\n".join(self.blocks[i][1] for i in (kept or usable))


def main_slot(roles: list[tuple[int, int | None, str, float]]) -> int | None:
    """``roles``: (role, role above it, element, unlinked characters that remain below it) -> the main one."""
    above = {role: up for role, up, _, _ in roles}
    depth: dict[int, int] = {}
    for role in above:
        way = []
        while role is not None and role in above and role not in depth:
            way.append(role)
            role = above[role]
        for k, x in enumerate(reversed(way), depth.get(role, 0) + 1):
            depth[x] = k
    total = max((w for _, _, _, w in roles), default=0)
    if total <= 0:
        return None
    good = [(depth[role], role) for role, _, name, w in roles if w >= COVER * total and name not in _LEAF]
    named = [(w, role) for role, _, name, w in roles if name in ("article", "main") and w >= total / 2]
    if named:
        most = max(named)[0]
        return max((depth[role], role) for w, role in named if w >= COVER * most)[1]
    return max(good)[1] if good else None


def own_main(tokens: list[tuple]) -> int | None:
    """Of a page that is its own template."""
    return main_slot([(token, up, name, chars - 2 * linked) for token, up, name, _, chars, linked in tokens if name is not None])


def extract(page: str | None) -> str:
    """The text of a page by itself."""
    if not page:
        return ""
    read = Page(page)
    return read.text(own_main(read.tokens()), frozenset())


def classes(tokens: list[tuple]) -> list[list[tuple]]:
    """``tokens``: (token, above, name, vector, pages, ...) of one host; the equivalence classes that hold markup."""
    by: dict[tuple, list] = {}
    for x in tokens:
        by.setdefault((x[3], x[4]), []).append(x)
    return [group for group in by.values() if any(x[2] is not None for x in group)]


def template(tokens: list[tuple], invalid: set) -> tuple[int | None, list[int]]:
    """``tokens``: (token, above, name, vector, pages, count, chars, linked) of one host; ``invalid``: vectors of
    classes that do not keep their order.  The main slot, and the tokens of boilerplate text."""
    valid = [x for group in classes(tokens) for x in group if x[3] not in invalid]
    left = {x[0]: [x[1], x[2], x[6] - 2.0 * x[7]] for x in valid if x[2] is not None}
    usable = max((x[6] for x in valid if x[2] is not None), default=0)
    text = [x for x in valid if x[2] is None]
    if sum(x[6] for x in text) > COPIES * usable:
        text = []
    for x in text:
        role = x[1]
        while role is not None and role in left:
            left[role][2] -= x[6] - 2.0 * x[7]
            role = left[role][0]
    return main_slot([(role, up, name, w) for role, (up, name, w) in left.items()]), [x[0] for x in text]


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


_LONG, _INT = T.LongType(), T.IntegerType()
_TOKENS = T.ArrayType(T.StructType([T.StructField("token", _LONG), T.StructField("above", _LONG), T.StructField("name", _INT), T.StructField("n", _LONG), T.StructField("chars", _LONG), T.StructField("linked", _LONG)]))


def read_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Each page's host, content digest, tokens and their order."""
    ship(pages.sparkSession)
    kept = pages.select(pages[id_col].alias("_id"), pages[url_col].cast("string").alias("_url"), pages[html_col].cast("string").alias("_html"))
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("digest", _LONG), T.StructField("tokens", _TOKENS), T.StructField("sequence", T.ArrayType(_LONG))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(None)
        for batch in batches:
            for part, texts in slices(batch, 2):
                read = [Page(x) for x in texts]
                tokens = [[{"token": t, "above": up, "name": _NUMBER[name], "n": n, "chars": chars, "linked": linked} for t, up, name, n, chars, linked in p.tokens()] for p in read]
                columns = [list(map(host, part.column(1).to_pylist())), list(map(_hash, texts)), tokens, [p.sequence() for p in read]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return kept.mapInArrow(run, schema)


def _invalid(one: DataFrame, grouped: DataFrame) -> DataFrame:
    """(host, invalid): vectors of the classes whose once-tokens do not stand in one order on all pages."""
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("vector", _LONG), T.StructField("lo", _LONG), T.StructField("hi", _LONG)])
    arrow = to_arrow_schema(schema)
    once = grouped.select("host", F.expr("transform(filter(stats, x -> x.n = x.pages), x -> struct(x.token, x.vector))").alias("once"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(None)
        held: dict[tuple[str, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            for own, sequence, pairs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                vector = {p["token"]: p["vector"] for p in pairs}
                orders: dict[int, list[int]] = {}
                for token in sequence:
                    if (v := vector.get(token)) is not None:
                        orders.setdefault(v, []).append(token)
                for v, order in orders.items():
                    d = _hash(",".join(map(str, order)))
                    x = held.setdefault((own, v), [d, d])
                    x[0], x[1] = min(x[0], d), max(x[1], d)
            if len(held) > 50_000:
                yield out()
        if held:
            yield out()

    seen = one.join(once, "host").select("host", "sequence", "once").mapInArrow(run, schema)
    bad = seen.groupBy("host", "vector").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
    return bad.groupBy("host").agg(F.collect_list("vector").alias("invalid"))


def templates(read: DataFrame) -> DataFrame:
    """(host, main, boilerplate) of every host with pages enough to compare; ``read``: of :func:`read_pages`."""
    one = cut(read.dropDuplicates(["host", "digest"]), "different")
    many = one.groupBy("host").agg(F.count("*").alias("most")).where(F.col("most") >= LEAST_PAGES)
    stats = one.select("host", "digest", F.explode("tokens").alias("t")).select("host", "digest", "t.*")
    stats = stats.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("digest", "n")).alias("vector"), F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"), F.first("above").alias("above"), F.first("name").alias("name"),
    )
    kept = stats.where("pages > 1").join(many, "host").where(F.col("pages") >= F.col("most") * SUPPORT)  # at most 1/SUPPORT times the tokens of a page
    names = ("token", "above", "name", "vector", "pages", "n", "chars", "linked")
    grouped = cut(kept.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("stats")), "classes")
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("main", _LONG), T.StructField("boilerplate", T.ArrayType(_LONG))])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [template([(x["token"], x["above"], _NAMES[x["name"]], *(x[c] for c in names[3:])) for x in stats], set(bad or ())) for stats, bad in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m for m, _ in found], pa.int64()), pa.array([b for _, b in found], pa.list_(pa.int64()))], names=schema.names)

    return grouped.join(_invalid(one, grouped), "host", "left").select("host", "stats", "invalid").mapInArrow(choose, schema)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    read = cut(read_pages(pages, id_col, url_col, html_col), "read")
    found = cut(templates(read), "templates")
    kept = pages.select(pages[id_col].alias("_id"), pages[url_col].cast("string").alias("_url"), pages[html_col].cast("string").alias("_html"))
    kept = kept.withColumn("host", F.lower(F.regexp_extract(F.coalesce("_url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    if (found.agg(F.sum(F.size("boilerplate") + 2)).first()[0] or 0) <= MOST_BROADCAST:
        joined = kept.join(F.broadcast(found), "host", "left")
    else:  # hosts with more than a thousandth of all rows, so a thousand at most, are dealt over several keys
        per = read.groupBy("host").count()
        share = max(SALTED, per.agg(F.sum("count")).first()[0] // 1000)
        hot = F.broadcast(per.where(F.col("count") > share).select("host", F.ceil(F.col("count") / share).cast("int").alias("salts")))
        one = F.coalesce("salts", F.lit(1))
        found = found.join(hot, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts")
        kept = kept.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("_id", "_url", F.length("_html")), one).cast("int"))
        joined = kept.join(found, ["host", "salt"], "left")
    schema = T.StructType([T.StructField(id_col, kept.schema["_id"].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", _LONG)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(None)
        for batch in batches:
            for part, texts in slices(batch, 2):
                out = []
                for x, main, boilerplate in zip(texts, part.column(3).to_pylist(), part.column(4).to_pylist()):
                    page = Page(x)
                    if main is None or all(role != main for role, _, _ in page.nodes):
                        main = own_main(page.tokens())
                    out.append(page.text(main, frozenset(boilerplate or ())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], schema=arrow)

    return joined.select("_id", "_url", "_html", "main", "boilerplate").mapInArrow(run, schema)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
