"""Multivariate anomaly of channels: isolation forest, percentile label, stability, concentration."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.runtime import cut, ship


def _average_depth(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as arrays: feature (-1: leaf), cut, children, size."""

    def __init__(self, trees: list[tuple]):
        self.trees = trees
        self.psi = max((int(t[4][0]) for t in trees), default=0)

    @classmethod
    def of(cls, x: np.ndarray, trees: int = 200, seed: int = 42) -> Forest:
        """Trees that each see all of ``x``."""
        return cls([cls._grow(x, np.random.default_rng([seed, k])) for k in range(trees)])

    @staticmethod
    def _grow(x: np.ndarray, rng) -> tuple:
        limit = math.ceil(math.log2(max(2, len(x))))
        feature, cut, left, right, size = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            at = len(feature)
            feature.append(-1), cut.append(0.0), left.append(-1), right.append(-1), size.append(len(rows))
            if depth >= limit or len(rows) <= 1:
                return at
            lo, hi = rows.min(axis=0), rows.max(axis=0)
            varied = np.flatnonzero(hi > lo)
            if not varied.size:
                return at
            f = int(rng.choice(varied))
            c = float(rng.uniform(lo[f], hi[f]))
            feature[at], cut[at] = f, c
            below = rows[:, f] < c
            left[at], right[at] = node(rows[below], depth + 1), node(rows[~below], depth + 1)
            return at

        node(x, 0)
        return tuple(map(np.array, (feature, cut, left, right, size)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """-2^(-depth / usual depth): lower is more anomalous."""
        if not self.trees:
            return np.zeros(len(x))
        depth = np.zeros(len(x))
        for feature, cut, left, right, size in self.trees:
            at, d = np.zeros(len(x), int), np.zeros(len(x))
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                i = np.flatnonzero(inner)
                go = x[i, feature[at[i]]] < cut[at[i]]
                at[i] = np.where(go, left[at[i]], right[at[i]])
                d[i] += 1
            depth += d + _average_depth(size[at])
        usual = float(_average_depth(np.array([self.psi]))[0]) or 1.0
        return -(2.0 ** (-depth / len(self.trees) / usual))


def isolation_scores(channels: DataFrame, features: list[str], id_col: str = "channel_id", trees: int = 200, max_samples: int = 3000, seed: int = 42, contamination: float = 0.05) -> DataFrame:
    """Adds ``iforest_score``: the forest's score less its ``contamination`` percentile over all rows.

    Each tree is grown on an executor from ``max_samples`` rows of its own (all, if there are fewer), picked from the
    whole table by a hash of the id and the tree; the driver and the workers hold the trees only.
    """
    spark = channels.sparkSession
    ship(spark)
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    n = channels.count()
    share = round(min(1.0, 1.3 * max_samples / max(1, n) + 100 / max(1, n)) * 1_000_000)
    order = lambda t: F.xxhash64(id_col, t, F.lit(seed))
    picked = channels.select(id_col, x.alias("x"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(order(t), F.lit(1_000_000)) < share)).alias("tree"))
    picked = picked.select("tree", order(F.col("tree")).alias("h"), "x")

    def grow(pdf):
        rows = sorted(zip(pdf.h, map(tuple, pdf.x)))[:max_samples]
        own = Forest._grow(np.array([r[1] for r in rows], float).reshape(len(rows), len(features)), np.random.default_rng([seed, int(pdf.tree.iloc[0])]))
        return pd.DataFrame([{"tree": pdf.tree.iloc[0], **dict(zip(_PARTS, own))}])

    grown = picked.groupBy("tree").applyInPandas(grow, "tree int, feature array<int>, cut array<double>, below array<int>, above array<int>, size array<int>").collect()
    shared = spark.sparkContext.broadcast(Forest([tuple(np.array(r[c]) for c in _PARTS) for r in sorted(grown)]))
    out = T.StructType([*channels.schema.fields, T.StructField("iforest_score", T.DoubleType())])

    def run(frames):
        for pdf in frames:
            values = pdf[features].astype(float).fillna(0.0).to_numpy()
            yield pdf.assign(iforest_score=shared.value.score(values))

    scored = cut(channels.mapInPandas(run, out), "forest")
    offset = scored.agg(F.percentile("iforest_score", F.lit(contamination)).alias("_offset"))
    return scored.join(F.broadcast(offset)).withColumn("iforest_score", F.col("iforest_score") - F.col("_offset")).drop("_offset")


_PARTS = ("feature", "cut", "below", "above", "size")


def percentile_label(df: DataFrame, score: str = "iforest_score", contamination: float = 0.05, small_pool: int = 20, out: str = "iforest_label") -> DataFrame:
    """-1 for the lowest scores up to the linear percentile, 1 for the rest; pools under ``small_pool`` rows are all -1."""
    cut = df.agg(F.percentile(score, F.lit(contamination)).alias("_cut"), F.count("*").alias("_pool"))
    return df.join(F.broadcast(cut)).withColumn(out, F.when((F.col("_pool") < small_pool) | (F.col(score) <= F.col("_cut")), F.lit(-1)).otherwise(F.lit(1))).drop("_cut", "_pool")


def small_pool_bypass(df: DataFrame, score: str = "iforest_score", small_pool: int = 20) -> DataFrame:
    """Scores of a pool under ``small_pool`` rows are 0."""
    pool = df.agg(F.count("*").alias("_pool"))
    return df.join(F.broadcast(pool)).withColumn(score, F.when(F.col("_pool") < small_pool, F.lit(0.0)).otherwise(F.col(score))).drop("_pool")


def split_stability(df: DataFrame, score: str, train: Column) -> DataFrame:
    """One row: 1 less the mean difference of the deciles of the two parts, in deviations of the training part."""
    deciles = F.array(*[F.lit(i / 10) for i in range(11)])
    s = -F.col(score)
    a = df.agg(F.percentile(F.when(train, s), deciles).alias("a"), F.percentile(F.when(~train, s), deciles).alias("b"), F.stddev_pop(F.when(train, s)).alias("sd"), F.count("*").alias("n"))
    gap = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: t + x) / 11
    return a.select(F.when(F.col("n") < 20, F.lit(1.0)).otherwise(1 - gap / (F.col("sd") + 1e-8)).alias("stability"))


def concentration(df: DataFrame, key: str, tops: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """One row: number of keys, rows, Herfindahl index with its reading, and shares of the largest keys in per cent.

    Rows are counted by key first; only as many counts as the largest ``tops`` are ever ordered in one place.
    """
    counts = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("nan")).alias("k")).agg(F.count("*").alias("c"))
    total = counts.agg(F.count("*").alias("unique_keys"), F.sum("c").alias("total"), F.sum(F.col("c").cast("double") * F.col("c")).alias("_sq"))
    first = counts.orderBy(F.desc("c"), "k").limit(max(tops)).agg(F.sort_array(F.collect_list("c"), asc=False).alias("_top"))
    hhi = F.col("_sq") / (F.col("total").cast("double") * F.col("total"))
    share = lambda k: F.round(F.aggregate(F.slice("_top", 1, k), F.lit(0).cast("bigint"), lambda a, x: a + x) * 100.0 / F.col("total"), 2)
    reading = F.when(hhi < 0.15, "unconcentrated").when(hhi < 0.25, "moderately concentrated").otherwise("highly concentrated")
    return total.join(F.broadcast(first)).select("unique_keys", "total", F.round(hhi, 4).alias("hhi"), reading.alias("hhi_reading"), *[share(k).alias(f"top_{k}_share_pct") for k in tops])


def concentration_verdicts(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Sentences about the concentration of sources and destinations."""
    both = src.select(F.col("hhi").alias("sh"), F.col("top_5_share_pct").alias("st")).join(F.broadcast(dst.select(F.col("hhi").alias("dh"), F.col("top_5_share_pct").alias("dt"))))
    said = F.array(
        F.when((F.col("sh") < 0.15) & (F.col("dh") < 0.15), "spread across many pairs"), F.when(F.col("st") > 80, "concentrated in few sources"), F.when(F.col("dt") > 80, "concentrated in few destinations")
    )
    some = F.filter(said, lambda x: x.isNotNull())
    return both.select(F.explode(F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("no strong concentration")))).alias("verdict"))


