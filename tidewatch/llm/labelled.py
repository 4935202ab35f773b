"""A bounded sample of labelled rows, without moving the other rows' texts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(id_col, mod: int):
    return F.crc32(id_col.cast("string")) % mod


def labelled_rows(docs: DataFrame, labels: DataFrame, target: str, learn, most: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """(id, text, y) of rows whose label is 0 or 1 and whose id satisfies ``learn``, at most ``most[y]`` labels of each class.

    The labels are thinned by a hash of the id and then cut exactly; what is broadcast to the texts is
    bounded by ``most``.  Ids with several labels count with each; null ids and labels are left out.
    Second, what a model fitted on the sample adds to its log odds of 1 to hold for all these labels.
    """
    chosen = None
    known = labels.select(F.col(id_col).alias("_id"), F.col(target).alias("y")).where(F.col("_id").isNotNull() & F.col("y").isin(0, 1)).where(learn(F.col("_id")))
    sizes = dict(known.groupBy("y").count().collect())
    for y, n in most.items():
        share = min(1.0, 1.3 * n / max(1, sizes.get(y, 0)))
        order = F.xxhash64("_id", F.lit("sample"))
        some = known.where(F.col("y") == y).where(F.pmod(order, F.lit(1_000_000)) < round(share * 1_000_000)).orderBy(order, "_id").limit(n)
        chosen = some if chosen is None else chosen.unionByName(some)
    kept = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    shift = 0.0
    if any(sizes.get(y, 0) > n for y, n in most.items()):
        drawn = dict(chosen.groupBy("y").count().collect())
        if drawn.get(0) and drawn.get(1):
            shift = math.log(sizes[1] / drawn[1]) - math.log(sizes[0] / drawn[0])
    return kept.join(F.broadcast(chosen), "_id").select("_id", "_text", "y"), shift
