"""Exact top-k inner products with a paged M-tree.

Vectors get one more coordinate that makes all of one length equally long (as long as the longest); then the
largest inner product with a query is the smallest Euclidean distance to it, a metric.

The root of the tree are pivots far apart from each other; a row belongs to the region of its nearest pivot,
whose covering radius is the greatest distance that occurs there.  Pivots and radii are a small table that
every task has.  Below, each region is a subtree (several, dealt by a hash, where it has more than ``TREE``
rows): pages of at most ``PAGE`` members, under nodes of at most ``FAN`` children, with covering radii and
the distance of every child and member from its parent's centre.

A query first meets the seeds, a bounded sample, so that it starts with a bound; then one subtree of its own
region, which tightens it; then the subtrees of those regions only that the bound cannot rule out.  Within
a subtree one heap holds all nodes met, nearest possible member first, and the search stops at the first
node that cannot reach the k-th best.  By the triangle inequality, children and members whose stored
distance from their parent rules them out are not computed.  What is computed is the integer product
itself, so rounding can never decide: bounds have a slack far above that of doubles.

Queries come in blocks; every (subtree, block) is a task of bounded size, and at most k rows of each query
leave it.  Vectors without any structure cannot be told apart by bounds: there all of them are computed.

Vectors that are null, empty or hold a null or non-finite component take no part.  Rows of other lengths
than a query's have no product with it.  Ties go to the smaller id; a query does not meet rows of its
own id; repeated ids are rows of their own.  Empty tables and queries alone give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.llm.texts import only
from tidewatch.runtime import cut, ship

TREE, PAGE, FAN, BLOCK, SEED = 16_384, 64, 16, 8192, 512
MOST_SEEDS = 1 << 22  # numbers in all seeds of all lengths


def lifted(x: np.ndarray, norm2: int) -> np.ndarray:
    """With the coordinate that makes all of them as long as the square root of ``norm2``."""
    x = x.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, norm2 - (x**2).sum(axis=1)))])


def spread(y: np.ndarray, n: int) -> np.ndarray:
    """``n`` (or as many as differ) rows, each the farthest from those before."""
    chosen, far = [0], ((y - y[0]) ** 2).sum(axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((y - y[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def nearest(y: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty(len(y), np.int64)
    for at in range(0, len(y), 4096):
        out[at : at + 4096] = ((pivots**2).sum(axis=1) - 2 * y[at : at + 4096] @ pivots.T).argmin(axis=1)
    return out


def _groups(y: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows dealt to groups of at most ``most``, near ones together."""
    near = nearest(y, y[np.linspace(0, len(y) - 1, -(-len(y) // most)).astype(int)])
    order = np.argsort(near, kind="stable")
    edges = np.searchsorted(near[order], np.arange(near.max() + 2))
    return [order[a : min(a + most, b)] for lo, b in zip(edges, edges[1:]) for a in range(lo, b, most)]


class Tree:
    """Nodes by number: centre, covering radius, distance from the parent's centre, and children or members."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norm2: int):
        """``x``: integer vectors; ``norm2``: at least each one's squared length."""
        y = lifted(x, norm2)
        pages = _groups(y, PAGE)
        order = np.concatenate(pages)
        self.ids, self.x, y = ids[order], x[order].astype(np.int64), y[order]
        ends = np.cumsum([len(p) for p in pages])
        self.members = list(zip([0, *ends.tolist()], ends.tolist()))
        center = [y[a:b].mean(axis=0) for a, b in self.members]
        self.own = np.concatenate([np.sqrt(((y[a:b] - c) ** 2).sum(axis=1)) for (a, b), c in zip(self.members, center)])
        radius = [float(self.own[a:b].max()) for a, b in self.members]
        self.children: list[np.ndarray | None] = [None] * len(pages)
        level, parent = np.arange(len(pages)), {}
        while len(level) > 1:
            above = []
            for g in _groups(np.array([center[i] for i in level]), FAN):
                kids = level[g]
                c = np.mean([center[i] for i in kids], axis=0)
                d = np.sqrt(((np.array([center[i] for i in kids]) - c) ** 2).sum(axis=1))
                parent.update(zip(kids.tolist(), d.tolist()))
                above.append(len(center))
                center.append(c)
                radius.append(float(max(a + radius[i] for a, i in zip(d, kids))))
                self.children.append(kids)
            level = np.array(above)
        self.center, self.radius = np.array(center), np.array(radius)
        self.parent = np.array([parent.get(i, 0.0) for i in range(len(center))])
        self.norm2, self.computed = norm2, 0

    def search(self, q: np.ndarray, own_id: int, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The best k (-score, id), without those below ``floor``, a score that k other rows are known to reach."""
        base = self.norm2 + int(q @ q)
        z = np.append(q.astype(float), 0.0)
        best: list[tuple[int, int]] = []
        limit = reach(base, floor)
        root = len(self.center) - 1
        to_root = float(np.sqrt(((self.center[root] - z) ** 2).sum()))
        self.computed += 1
        heap = [(max(0.0, to_root - self.radius[root]), root, to_root)]
        while heap:
            bound, node, d = heapq.heappop(heap)
            if bound > limit:
                break
            kids = self.children[node]
            if kids is not None:
                kids = kids[np.abs(d - self.parent[kids]) - self.radius[kids] <= limit]
                self.computed += len(kids)
                to = np.sqrt(((self.center[kids] - z) ** 2).sum(axis=1))
                for lo, i, t in zip((to - self.radius[kids]).tolist(), kids.tolist(), to.tolist()):
                    if lo <= limit:
                        heapq.heappush(heap, (max(bound, lo), i, t))
                continue
            a, b = self.members[node]
            near = a + np.flatnonzero(np.abs(d - self.own[a:b]) <= limit)
            self.computed += len(near)
            scores = self.x[near] @ q
            if floor is not None:
                keep = scores >= floor
                near, scores = near[keep], scores[keep]
            if near.size:
                found = [(-s, i) for s, i in zip(scores.tolist(), self.ids[near].tolist()) if i != own_id]
                best = sorted([*best, *found])[:k]
                if len(best) == k:
                    floor = -best[-1][0] if floor is None else max(floor, -best[-1][0])
                    limit = reach(base, floor)
        return best


def reach(base, floor):
    """How far a row of a score of ``floor`` or more can be: distance^2 = norm2 + |q|^2 - 2 score.  With slack."""
    if floor is None:
        return np.inf
    return np.sqrt(np.maximum(0.0, base - 2.0 * floor)) + 1e-6 * (1.0 + np.sqrt(base))


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in column])


_FOUND = "query_id long, query_row long, vec_id long, score long"
_DEALT = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("region", T.IntegerType()), T.StructField("far", T.DoubleType()), T.StructField("floor", T.LongType()), T.StructField("asks", T.BooleanType()), T.StructField("id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("v", T.ArrayType(T.LongType()))])


def top_k(rows: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each row that satisfies ``is_query(id)`` against all other rows."""
    found = Search(rows, is_query, k, scale, id_col, vector_col).run()
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Search:
    """The steps of a search over one table."""

    def __init__(self, rows: DataFrame, is_query, k: int, scale: int, id_col: str, vector_col: str):
        self.spark, self.k, v = rows.sparkSession, k, F.col("_v")
        ship(self.spark)
        clean = rows.select(rows[id_col].cast("long").alias("id"), rows[vector_col].alias("_v")).where("id IS NOT NULL AND size(_v) > 0")
        clean = clean.where(~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))))
        clean = clean.select(F.coalesce(is_query(F.col("id")), F.lit(False)).alias("asks"), "id", F.transform(v, lambda c: F.floor(c.cast("double") * scale)).alias("v"))
        self.rows = cut(clean.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")

    def deal(self) -> DataFrame:
        """Every row with its region, the distance from its pivot and, for queries, a score that k others reach."""
        lengths = {r.dim: (r.norm2, r.n) for r in self.rows.groupBy("dim").agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)).alias("norm2"), F.count("*").alias("n")).collect()}
        each = max(1, min(SEED, MOST_SEEDS // max(1, sum(lengths))))
        order = Window.partitionBy("dim").orderBy(F.xxhash64("row"), "row")
        seeds: dict[int, list] = {}
        for r in self.rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= each).select("dim", "id", "v").collect():
            seeds.setdefault(r.dim, []).append((r.id, r.v))
        tables = {}
        for dim, some in seeds.items():
            ids, x = np.array([i for i, _ in some]), _matrix([v for _, v in some])
            y = lifted(x, lengths[dim][0])
            tables[dim] = (lengths[dim][0], ids, x, y[spread(y, -(-lengths[dim][1] // TREE))])
        self.shared = self.spark.sparkContext.broadcast(tables)
        arrow, shared, k = to_arrow_schema(_DEALT), self.shared, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            only(None)
            for batch in batches:
                dims = batch.column(0).to_numpy(zero_copy_only=False)
                for dim in np.unique(dims).tolist():
                    part = batch.filter(pa.array(dims == dim))
                    norm2, ids, seen, pivots = shared.value[dim]
                    x = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    y = lifted(x, norm2)
                    region = nearest(y, pivots)
                    far = np.sqrt(((y - pivots[region]) ** 2).sum(axis=1))
                    asks, own = part.column(1).to_pylist(), part.column(2).to_pylist()
                    floors: list[int | None] = [None] * len(asks)
                    at = np.flatnonzero(asks)
                    for i, scores in zip(at.tolist(), x[at] @ seen.T):
                        others = scores[ids != own[i]]
                        floors[i] = int(np.partition(others, -k)[-k]) if others.size >= k else None
                    columns = [part.column(0), pa.array(region, pa.int32()), pa.array(far), pa.array(floors, pa.int64()), *part.columns[1:]]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

        return cut(self.rows.select("dim", "asks", "id", "row", "v").mapInArrow(run, _DEALT), "dealt")

    def send(self, queries: DataFrame, first: bool) -> DataFrame:
        """Queries with the (region, part) that they go to: at first one part of their own region, then all others that are not ruled out."""
        regions, shared = self.regions, self.shared
        schema = T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("dim", "region", "part", "block")], *_DEALT.fields[3:4], *_DEALT.fields[5:]])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            only(None)
            for batch in batches:
                out = []
                for dim, own, floor, i, row, v in zip(*(c.to_pylist() for c in batch.columns)):
                    norm2, _, _, pivots = shared.value[dim]
                    radius, parts, blocks = regions[dim]
                    q = np.array(v, np.int64)
                    block, home = row % blocks, row // blocks % parts[own]
                    if first:
                        out.append((dim, own, home, block, floor, i, row, v))
                        continue
                    z = np.append(q.astype(float), 0.0)
                    limit = reach(norm2 + int(q @ q), floor)
                    for r in np.flatnonzero(np.sqrt(((pivots - z) ** 2).sum(axis=1)) - radius <= limit).tolist():
                        out += [(dim, r, p, block, floor, i, row, v) for p in range(parts[r]) if (r, p) != (own, home)]
                    if len(out) > 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        return queries.select("dim", "region", "floor", "id", "row", "v").mapInArrow(run, schema)

    def search(self, members: DataFrame, asked: DataFrame) -> DataFrame:
        shared, k = self.shared, self.k

        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            held, asking, out = pdf[~pdf.asks].sort_values("row"), pdf[pdf.asks], []
            if len(held) and len(asking):
                tree = Tree(held.id.to_numpy(), _matrix(held.v), shared.value[int(key[0])][0])
                for own, row, floor, v in zip(asking.id.tolist(), asking.row.tolist(), asking.floor.tolist(), asking.v):
                    out += [(own, row, i, -s) for s, i in tree.search(np.asarray(v, np.int64), own, k, None if pd.isna(floor) else int(floor))]
            return pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "score"])

        columns = ["dim", "region", "part", "block", "asks", F.col("floor").cast("double").alias("floor"), "id", "row", "v"]
        both = members.withColumns({"asks": F.lit(False), "floor": F.lit(None)}).select(columns).unionByName(asked.withColumn("asks", F.lit(True)).select(columns))
        return both.groupBy("dim", "region", "part", "block").applyInPandas(run, _FOUND)

    def run(self) -> DataFrame:
        """(query_id, query_row, vec_id, score): the best k of every subtree that a query went to."""
        dealt = self.deal()
        queries = dealt.where("asks")
        asked = dict(queries.groupBy("dim").count().collect())
        self.regions = {}
        for dim, (_, _, _, pivots) in self.shared.value.items():
            self.regions[dim] = (np.zeros(len(pivots)), [1] * len(pivots), max(1, -(-asked.get(dim, 0) // BLOCK)))
        for r in dealt.groupBy("dim", "region").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
            radius, parts, _ = self.regions[r.dim]
            radius[r.region], parts[r.region] = r.far * (1 + 1e-9) + 1e-6, -(-r.n // TREE)
        if not asked:
            return self.spark.createDataFrame([], _FOUND)
        sizes = self.spark.createDataFrame([(d, r, p, b) for d, (_, parts, b) in self.regions.items() if d in asked for r, p in enumerate(parts)], "dim int, region int, parts int, blocks int")
        members = dealt.join(F.broadcast(sizes), ["dim", "region"]).withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))
        members = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("dim", "region", "part", "block", "id", "row", "v")
        found = cut(self.search(members, self.send(queries, True)), "first")
        if all(sum(parts) == 1 for _, parts, _ in self.regions.values()):
            return found
        kth = found.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") == self.k, F.min("score")).alias("kth"))
        again = queries.join(kth, "row", "left").withColumn("floor", F.greatest("floor", "kth")).drop("kth")
        return found.unionByName(self.search(members, self.send(again, False)))


def op9_metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, lambda i: i % 50 == 0).select("query_id", "rank", "vec_id", "score")


OP9_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM e q, e c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""
