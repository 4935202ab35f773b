"""Toxicity by compression distance.

Two zstandard dictionaries share an ordinary part: frequent words.  Before it, the toxic one has what
training finds in toxic texts: runs of byte n-grams within words that are much more usual in toxic texts
than in others; the ordinary one has as many zero bytes, so that all else stands at the same distance and
the two lengths of a window differ only by what the toxic part saves.  There are two such pairs: a strict
one (5-grams, twenty times as usual) and a loose one (7-grams, five times).  Windows are 24 words; maxima
and sums of the savings over all windows of a text give its score by a logistic curve that is calibrated
on training rows kept out of the dictionaries.

All are fitted on the driver on at most ``MOST_TOXIC`` and ``MOST_ORDINARY`` labelled rows.  Near copies
count once there.  The intercept is then moved to the odds of all learnable labels.

The dictionaries are not filled by the library's trainer: trained so on either side, they told nothing of rows held out
(figures in the README), since toxic texts are ordinary but for a few words.

Null and empty texts have no window and score like a text that saves nothing.  Without toxic or ordinary training rows
every score is the toxic share (0.5 without any rows).  Repeated rows give a row each and equal texts equal scores; an
empty table gives none.  Other columns are not read.  A text is held whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.labelled import labelled_rows, remainder
from tidewatch.llm.texts import map_texts

MOST_TOXIC, MOST_ORDINARY = 2500, 5000
WINDOW, LEVEL = 24, 9
PAIRS = ((5, 20, 8, 5), (7, 5, 5, 6))  # n-gram, times as usual, least texts, shortest match
COMMON_BYTES, TOXIC_BYTES = 16_000, 4_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def _grams(word: bytes, n: int) -> list[bytes]:
    b = b" " + word + b" "
    return [b[i : i + n] for i in range(len(b) - n + 1)]


def _without_copies(texts: list[str]) -> list[list[bytes]]:
    """The words of each text, without those that share their least or greatest hashed word triple with an earlier one."""
    seen, out = set(), []
    for t in texts:
        ws = _words(t)
        hashes = [xxhash.xxh3_64_intdigest(b" ".join(ws[i : i + 3])) for i in range(max(1, len(ws) - 2))]
        ends = {("a", min(hashes)), ("z", max(hashes))}
        if not ends & seen:
            out.append(ws)
        seen |= ends
    return out


def train_dictionaries(sides: list[list[list[bytes]]], gram: int, ratio: float, least: int) -> tuple[bytes, bytes]:
    """``sides``: the words of ordinary and of toxic texts."""
    counts = [Counter(), Counter()]
    for y in (0, 1):
        for ws in sides[y]:
            counts[y].update({g for w in set(ws) for g in _grams(w, gram)})
    n0, n1 = max(1, len(sides[0])), max(1, len(sides[1]))
    special = {g for g, c in counts[1].items() if c >= least and c / n1 >= ratio * (counts[0][g] + 0.5) / n0}
    runs: Counter = Counter()
    for ws in sides[1]:
        for w in set(ws):
            grams, b, at = _grams(w, gram), b" " + w + b" ", 0
            while at < len(grams):
                to = at
                while to < len(grams) and grams[to] in special:
                    to += 1
                if to > at:
                    runs[b[at : to + gram - 1]] += 1
                at = to + 1
    kept, size = [], 0
    for run, _ in sorted(runs.items(), key=lambda x: (-x[1], x[0])):
        if size + len(run) < TOXIC_BYTES:
            kept.append(run)
            size += len(run) + 1
    special_part = b"\0" + b"\0".join(kept[::-1]) + b"\0"
    usual: Counter = Counter()
    for ws in sides[0]:
        usual.update(set(ws))
    top = [w for w, _ in sorted(usual.items(), key=lambda x: (-x[1], x[0]))[:3000]]
    common = (b" " + b" ".join(top[::-1]) + b" ")[-COMMON_BYTES:]
    return special_part + common, bytes(len(special_part)) + common


class Windows:
    """``pairs``: (toxic, ordinary) dictionaries, as many as ``PAIRS``."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]):
        self.by = []
        for contents, (_, _, _, shortest) in zip(pairs, PAIRS):
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS, min_match=shortest, hash_log=17, chain_log=17, search_log=6)
            made = []
            for content in contents:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
            self.by.append(made)

    def savings(self, text: str) -> list[float]:
        """Of each pair the greatest saving over a text's windows, the logarithm of all savings, their mean and the share of windows that save
        three bytes or more; and the logarithm of the number of windows."""
        ws = _words(text)
        windows = [b" " + b" ".join(ws[i : i + WINDOW]) + b" " for i in range(0, len(ws), WINDOW)]
        n, out = max(1, len(windows)), [float(np.log1p(len(windows)))]
        for toxic, usual in self.by:
            d = [len(usual(x)) - len(toxic(x)) for x in windows]
            total = sum(x for x in d if x > 0)
            out += [float(max([0, *d])), float(np.log1p(total)), total / n, sum(x >= 3 for x in d) / n]
        return out


@dataclass
class Toxicity:
    pairs: list
    weights: tuple

    @classmethod
    def fit(cls, rows: list[tuple[str, int]]) -> Toxicity:
        """``rows``: (text, label) in a fixed order; every third calibrates."""
        p = (sum(y for _, y in rows) + 0.0) / len(rows) if rows else 0.5
        p = min(max(p, 1e-4), 1 - 1e-4)
        prior = float(np.log(p / (1 - p)))
        train, held = [r for i, r in enumerate(rows) if i % 3], rows[::3]
        if len({y for _, y in train}) < 2 or len({y for _, y in held}) < 2:
            return cls([], (prior,))
        sides = [_without_copies([t for t, y in train if y == k]) for k in (0, 1)]
        pairs = [train_dictionaries(sides, gram, ratio, least) for gram, ratio, least, _ in PAIRS]
        windows = Windows(pairs)
        x = np.array([(1.0, *windows.savings(t)) for t, _ in held])
        y = np.array([y for _, y in held], float)
        w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [0.1] * (x.shape[1] - 1))
        for _ in range(30):  # Newton
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge, x.T @ (y - q) - ridge @ w)
        return cls(pairs, tuple(w.tolist()))

    def scores(self, texts: list[str], windows: Windows | None) -> np.ndarray:
        x = np.array([(1.0, *(windows.savings(t) if windows else ())) for t in texts]).reshape(-1, len(self.weights))
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -50, 50)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    rows, shift = labelled_rows(docs, labels, target, learn, {1: MOST_TOXIC, 0: MOST_ORDINARY}, id_col, text_col)
    model = Toxicity.fit([(r[1] or "", r[2]) for r in sorted(rows.collect(), key=lambda r: (xxhash.xxh3_64_intdigest(str(r[0])), r[2], r[1] or ""))])
    model.weights = (model.weights[0] + shift, *model.weights[1:])
    return model


def score_toxicity(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; a narrow map."""
    made: list = []

    def work(texts: list[str]) -> list:
        if not made:
            made.append(Windows(model.pairs) if model.pairs else None)
        return [model.scores(texts, made[0])]

    return map_texts(docs, work, [T.StructField("score", T.DoubleType())], id_col, text_col)


def learns(id_col):
    return remainder(id_col, 5) != 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, fit_toxicity(docs, labels, learns))
    return scored.select("doc_id", F.coalesce(~learns(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
