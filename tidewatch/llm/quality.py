"""Text quality by a generalised additive model with pairwise interactions.

A text becomes a few numbers; each is cut into quantile bins.  Shallow trees on one number at a time,
boosted in turn with a small rate, add up to one lookup table per number; then tables of the pairs with
the largest remaining gain are boosted the same way.  A score is an intercept plus table entries.

The model is fitted on the driver on at most ``MOST_ROWS`` labelled rows of each class, of which only the
numbers are collected; the intercept is then moved to the odds of all learnable labels, so that a score means
the same whatever was left out.  Null and empty texts have all numbers 0 and get a score like any other.  Without
labels every score is 0.5; with one class alone, that class's share.  Repeated rows get a row each; an empty table
gives none.  Other columns are not read.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.labelled import labelled_rows, remainder
from tidewatch.llm.texts import map_texts

MOST_ROWS = 15_000
NAMES = ("words", "word_length", "distinct", "repeated_next", "upper", "digit", "symbol", "bang", "comma_stop", "bar", "wide", "blank", "short_words", "lines_distinct", "top_word")
_CLASS = np.zeros((256, 9), np.int64)
for _i, _chars in enumerate((range(65, 91), range(48, 58), b"#$%&*+=@^_~\\/<>{}[]", b"!?", b",.;:", b"|", range(128, 256), b" \t\n\r\x0b\x0c", range(97, 123))):
    _CLASS[list(_chars), _i] = 1


def features(text: str) -> list[float]:
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(data)
    upper, digit, symbol, bang, stop, bar, wide, blank, _ = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS / size).tolist()
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        math.log1p(n), (size - blank * size) / n, len(count) / n, sum(map(operator.eq, words, words[1:])) / n, upper, digit, symbol, bang, stop, bar, wide, blank,
        sum(c for w, c in count.items() if len(w) <= 3) / n, len(set(lines)) / len(lines), max(count.values()) / n,
    ]


def _split(g: np.ndarray, h: np.ndarray, reg: float) -> tuple[int, float]:
    """Best cut of a histogram (entries below it go left) and its gain."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + reg) + (g.sum() - a) ** 2 / (h.sum() - b + reg) - g.sum() ** 2 / (h.sum() + reg)
    if not gain.size or gain.max() <= 1e-9:
        return 0, 0.0
    return int(gain.argmax()) + 1, float(gain.max())


def _tree(g: np.ndarray, h: np.ndarray, reg: float) -> np.ndarray:
    """Values of a tree of two levels on one binned number."""
    out = np.empty(g.size)
    top, _ = _split(g, h, reg)
    for a, b in ((0, top), (top, g.size)):
        if b > a:
            mid = a + _split(g[a:b], h[a:b], reg)[0]
            for c, d in ((a, mid), (mid, b)):
                if d > c:
                    out[c:d] = g[c:d].sum() / (h[c:d].sum() + reg)
    return out


@dataclass
class Gam:
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)
    intercept: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pairs: int = 5, rate: float = 0.1, reg: float = 4.0) -> Gam:
        model = cls()
        if not len(y):
            return model
        p = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        model.intercept = math.log(p / (1 - p))
        if y.min() == y.max():
            return model
        model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        model.tables = [np.zeros(e.size + 1) for e in model.edges]
        binned = model.bins(x)
        total = np.full(len(y), model.intercept)

        def slopes(cell: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            q = 1 / (1 + np.exp(-total))
            return np.bincount(cell, y - q, size), np.bincount(cell, q * (1 - q), size)

        for _ in range(rounds):
            for k, table in enumerate(model.tables):
                step = rate * _tree(*slopes(binned[k], table.size), reg)
                table += step
                total += step[binned[k]]
        found = []
        for i in range(len(model.tables)):
            for j in range(i):
                shape = (model.tables[i].size, model.tables[j].size)
                g, h = slopes(binned[i] * shape[1] + binned[j], shape[0] * shape[1])
                found.append((float((_quadrants(g.reshape(shape), h.reshape(shape), reg) * g.reshape(shape)).sum()), i, j))
        model.pairs = [(i, j, np.zeros((model.tables[i].size, model.tables[j].size))) for _, i, j in sorted(found, reverse=True)[:pairs]]
        for _ in range(rounds // 3):
            for i, j, table in model.pairs:
                g, h = slopes(binned[i] * table.shape[1] + binned[j], table.size)
                step = rate * _quadrants(g.reshape(table.shape), h.reshape(table.shape), reg)
                table += step
                total += step[binned[i], binned[j]]
        return model

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.tables:
            binned = self.bins(x)
            for b, table in zip(binned, self.tables):
                total += table[b]
            for i, j, table in self.pairs:
                total += table[binned[i], binned[j]]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def _quadrants(g: np.ndarray, h: np.ndarray, reg: float) -> np.ndarray:
    """Values of a tree that cuts the first number once and the second once on either side."""
    out = np.zeros(g.shape)
    top, _ = _split(g.sum(axis=1), h.sum(axis=1), reg)
    for a, b in ((0, top), (top, g.shape[0])):
        if b > a:
            gs, hs = g[a:b].sum(axis=0), h[a:b].sum(axis=0)
            mid, _ = _split(gs, hs, reg)
            for c, d in ((0, mid), (mid, g.shape[1])):
                if d > c:
                    out[a:b, c:d] = gs[c:d].sum() / (hs[c:d].sum() + reg)
    return out


_NUMBERS = [T.StructField("x", T.ArrayType(T.DoubleType()))]


def fit_quality(docs: DataFrame, labels: DataFrame, learn, target: str = "quality", most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Gam:
    rows, shift = labelled_rows(docs, labels, target, learn, {0: most_rows, 1: most_rows}, id_col, text_col)
    tagged = rows.select(F.struct("_id", "y").alias("tag"), "_text")
    seen = map_texts(tagged, lambda texts: [[features(x) for x in texts]], _NUMBERS, "tag", "_text").select("tag.y", "tag._id", "x").collect()
    seen.sort(key=lambda r: (r._id, r.y, r.x))
    model = Gam.fit(np.array([r.x for r in seen]).reshape(-1, len(NAMES)), np.array([r.y for r in seen], float))
    model.intercept += shift
    return model


def score_quality(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", text_as: str | None = None) -> DataFrame:
    """(id, score) of every row, and the text if a name is given for it; a narrow map."""

    def work(texts: list[str]) -> list:
        return [model.score(np.array([features(x) for x in texts]).reshape(-1, len(NAMES)))]

    return map_texts(docs, work, [T.StructField("score", T.DoubleType())], id_col, text_col, text_as=text_as)


def learns(id_col):
    return remainder(id_col, 4) != 2


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, fit_quality(docs, labels, learns))
    return scored.select("doc_id", F.coalesce(~learns(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
