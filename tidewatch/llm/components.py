"""Connected components of a graph of any size, by alternating large-star and small-star steps.

A graph of at most ``FEW`` edges is solved in one task instead, which holds no more than those.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.runtime import cut, release, ship

FEW = 100_000


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in root], pa.int64())], names=["node", "label"])


def _stars(pairs: DataFrame, small: bool) -> DataFrame:
    """``pairs``: (u, v).  Every neighbour on the far side of u gets the least node of u's neighbourhood."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if small:  # all v are less than u
        hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        hung = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b) -> (node, label): the least node of its component, for every node with an edge.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the size.
    ``edges`` should be a written table: it is read twice.
    """
    if edges.count() <= FEW:
        ship(edges.sparkSession)
        return edges.where("a <> b").select("a", "b").coalesce(1).mapInArrow(_at_once, "node long, label long")
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_stars(both, small=False))
        before, now = now, cut(_stars(large, small=True))
        release(large)
        release(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        state = new
