"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words and put into one automaton; a text's words stream through it, and after
each the length of the longest item passage that ends there is known.  From ``window`` words on, the
last ``window`` words occur in an item, so they are hit.  An item shorter than that counts as a whole.

Items are dealt into blocks of at most ``BLOCK_WORDS`` words, each with its own broadcast and narrow pass
over the texts, written before the next one, so neither the driver nor a worker ever holds more than a
block's automaton; a worker builds it once.  A text's words are held a part at a time.

Null and empty texts have no words, are never hit and list no item.  Items without words, or null, match
nothing; equal items all count; items of one id count once, also the null id, which the digest leaves out;
an empty benchmark hits nothing.  Repeated rows give a row each.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.llm.texts import kept, only, slices
from tidewatch.runtime import cut, release, ship

WINDOW = 10
BLOCK_WORDS = 500_000
PART = 500_000  # characters of a text whose words are held at a time
_BLANK = re.compile(r"[ \n\t]")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of lower-cased letters, digits and any non-ASCII characters, as UTF-8."""
    return text.encode().translate(_TABLE).split() if text else []


class SuffixAutomaton:
    """Of several word sequences; ``items``: (id, words)."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.word: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, ws in items:
            if ws:
                coded.append((item, [self.word.setdefault(w, len(self.word) + 1) for w in ws]))
                self._add(coded[-1][1])
        self.shortest = min([window, *(len(c) for _, c in coded)])
        self.holds: list[set] = [set() for _ in self.next]  # items of a state's last `window` words
        whole: list[list] = [[] for _ in self.next]
        for item, c in coded:
            state = 0
            for i, w in enumerate(c):
                state = self.next[state][w]
                if i >= window - 1:
                    state = self._trim(state)
                    self.holds[state].add(item)
            if len(c) < window:
                whole[state].append((len(c), item))
        self.cover = [self._trim(s) if n >= window else -1 for s, n in enumerate(self.length)]
        self.short: list[tuple] = [()] * len(self.next)  # short items that end a state's words
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[s] = (*whole[s], *self.short[self.link[s]])

    def _trim(self, state: int) -> int:
        """The state of the last ``window`` words."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _new(self, length: int, link: int, to: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(to)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of ``p``'s longest words followed by w, parted from q if q has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _add(self, coded: list[int]) -> None:
        last = 0
        for w in coded:
            if w in self.next[last]:
                last = self._split(last, w, self.next[last][w])
                continue
            new, p = self._new(self.length[last] + 1, 0, {}), last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, w, self.next[p][w])
            last = new

    def matches(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit passages (first word, word behind the last; joined where they touch or overlap) and the items they are of."""
        found = Matches(self)
        found.read(ws, last=True)
        return found.spans, found.items

    def matches_of(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, passages and items of a text, which is read part by part."""
        found = Matches(self)
        for part, last in parts(text or ""):
            found.read(words(part), last)
        return found.n_words, found.spans, found.items


class Matches:
    """What streams through an automaton: its state and match length, and what was found so far."""

    def __init__(self, automaton: SuffixAutomaton):
        self.automaton, self.spans, self.items = automaton, [], set()
        self.n_words, self.state, self.length = 0, 0, 0

    def read(self, ws: list[bytes], last: bool) -> None:
        own, spans, items, before = self.automaton, self.spans, self.items, self.n_words
        self.n_words += len(ws)
        get = own.word.get
        codes = [get(w, 0) for w in ws]
        known = np.zeros(len(codes) + 2, np.int8)
        known[1:-1] = np.array(codes, np.int32) != 0
        edges = np.flatnonzero(np.diff(known))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= own.shortest
        if starts.size:  # runs of known words may go on from part to part
            long[0] |= starts[0] == 0 and before > 0
            long[-1] |= ends[-1] == len(codes) and not last
        nexts, links, lengths, window, cover, short = own.next, own.link, own.length, own.window, own.cover, own.short
        state, n = (self.state, self.length) if codes and codes[0] else (0, 0)
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            if a:
                state, n = 0, 0
            for i in range(a, b):
                w = codes[i]
                to = nexts[state].get(w)
                while to is None:
                    state = links[state]
                    n = lengths[state]
                    to = nexts[state].get(w)  # the root has every known word
                state, n = to, n + 1
                at = before + i + 1
                first = at
                if n >= window:
                    first = at - window
                    items |= own.holds[cover[state]]
                for size, item in short[state]:
                    if size <= n:
                        items.add(item)
                        first = min(first, at - size)
                if first < at:
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, at))
        if codes:
            self.state, self.length = (state, n) if codes[-1] else (0, 0)


def parts(text: str, most: int | None = None) -> Iterator[tuple[str, bool]]:
    """The text in parts that end at blanks, and whether each is the last."""
    at, most = 0, most or PART
    while len(text) - at > most:
        border = _BLANK.search(text, at + most)
        if border is None:
            break
        yield text[at : border.start()], False
        at = border.start()
    yield text[at:], True


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[tuple], bool]]:
    """Items, streamed through the driver one block at a time, and whether a block is the last."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        ws = words(row.t)
        if size and size + len(ws) > BLOCK_WORDS:
            yield block, False
            block, size = [], 0
        if ws:
            block.append((None if row.i is None else str(row.i), ws))
            size += len(ws)
    yield block, True


_SPANS = "array<struct<start:bigint,end:bigint>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", edit=None) -> DataFrame:
    """(id, n_words, spans array<struct<start, end>> in words, items array<string>) of every row.

    ``edit(text, n_words, spans)``: instead, (id, text) of the rows for which it doesn't return ``False``.
    All but the last block's findings are written, so no task ever runs two passes and a block's broadcast can go.
    """
    spark = docs.sparkSession
    ship(spark)
    now = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("_text"), F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    found = T.StructType([now.schema[id_col], T.StructField("n_words", T.LongType()), now.schema["spans"], now.schema["items"]])
    edited = T.StructType([now.schema[id_col], T.StructField("text", T.StringType())])
    for block, last in _blocks(benchmark, item_id, item_text):
        shared, name = spark.sparkContext.broadcast(block), f"automaton-{uuid.uuid4().hex}"
        schema = (edited if edit else found) if last else now.schema

        def run(batches, shared=shared, name=name, last=last, arrow=to_arrow_schema(schema)):
            only(name)
            own = kept(name, lambda: SuffixAutomaton(shared.value))
            for batch in batches:
                for part, texts in slices(batch, 1):
                    sizes, spans, items = [], [], []
                    for text, old, had in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist()):
                        n, new, more = own.matches_of(text)
                        sizes.append(n)
                        spans.append(join_spans([*((s["start"], s["end"]) for s in old), *new]) if old else new)
                        items.append(sorted({*had, *more}, key=lambda x: (x is None, x or "")))
                    if last and edit:
                        new = [edit(*x) if x[2] else x[0] for x in zip(part.column(1).to_pylist(), sizes, spans)]
                        stays = pa.array([x is not False for x in new])
                        yield pa.RecordBatch.from_arrays([part.column(0).filter(stays), pa.array([x for x in new if x is not False], pa.string())], schema=arrow)
                        continue
                    passages = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], arrow.field(2).type)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()) if last else part.column(1), passages, pa.array(items, arrow.field(3).type)], schema=arrow)

        out = now.mapInArrow(run, schema)
        if last:
            return out
        before, now = now, cut(out, "passages")
        release(before)
        shared.destroy()
    raise AssertionError("there is always a last block")


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans`` and what stands between them."""
    data = text.encode()
    marked = np.frombuffer(data.translate(_TABLE), np.uint8) != 32
    edge = np.zeros(marked.size + 2, np.int8)
    edge[1:-1] = marked
    edge = np.diff(edge)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : begin[a]])
        at = int(end[b - 1])
    return b"".join([*out, data[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, most_covered: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of the rows that stay: hit passages are cut out, those of whole short items too; a row of
    whose words more than ``most_covered`` are hit goes."""

    def edit(text: str, n_words: int, spans: list[tuple[int, int]]):
        return cut_words(text, spans) if sum(b - a for a, b in spans) <= n_words * most_covered else False

    return find_contamination(docs, benchmark, id_col, text_col, edit=edit)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (hit > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM g),
o AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
m AS (SELECT rid, i, o.n, item_id FROM o JOIN g ON o.t = g.t AND o.n = g.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
k AS (
  SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN k USING (rid)
"""
