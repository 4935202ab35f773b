"""Changepoints of beacon timing by penalised segmentation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.config import Settings
from tidewatch.operators.sax import iat_rows
from tidewatch.runtime import ship

SHIFT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("timestamp", "old_period_s", "new_period_s", "delta_pct")])
RESULT = T.StructType(
    [
        T.StructField("n_changepoints", T.IntegerType()), T.StructField("changepoint_times", T.ArrayType(T.DoubleType())), T.StructField("beacon_start_ts", T.DoubleType()), T.StructField("beacon_start_dt", T.StringType()),
        T.StructField("pre_start_iat_mean", T.DoubleType()), T.StructField("post_start_iat_mean", T.DoubleType()), T.StructField("interval_shifts", T.ArrayType(SHIFT)), T.StructField("has_interval_shift", T.BooleanType()), T.StructField("pelt_cost", T.DoubleType()),
    ]
)


def bic_penalty(rows: DataFrame, entity: str, value: str = "iat") -> DataFrame:
    """(entity, penalty): 2 ln(n) times the population variance, 1 at least."""
    v = F.var_pop(value)
    return rows.groupBy(entity).agg(F.greatest(2 * F.log(F.greatest(F.count("*"), F.lit(2))) * v, F.lit(1.0)).alias("penalty"))


def segment_cost(rows: DataFrame, entity: str, segment: str, value: str = "iat") -> DataFrame:
    """(entity, segment, cost): squared deviations from each segment's mean."""
    return rows.groupBy(entity, segment).agg((F.var_pop(value) * F.count(value)).alias("cost"))


def segment(x: np.ndarray, penalty: float, least: int = 2, prune: str = "exact") -> list[int]:
    """Boundaries of the cheapest segmentation into pieces of ``least`` or more values.

    ``prune="exact"``: a start that even without a penalty costs more than the best at t can never win where a
    boundary at t is allowed, so from t + ``least`` on it is dropped.  ``"reference"`` drops a start at once when its
    own best and a penalty cost more, which nearly always leaves no boundary.
    """
    n = len(x)
    if n < 2 * least:
        return []
    y = x - x.mean()
    s1, s2 = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)])
    best, back, starts = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.array([0])
    until = np.full(n + 1, n + 1)  # where a start is dropped
    best[0] = -penalty
    for t in range(1, n + 1):
        if prune == "exact":
            starts = starts[until[starts] > t]
        size = t - starts
        cost = np.where(size > 1, s2[t] - s2[starts] - (s1[t] - s1[starts]) ** 2 / size, 0.0)
        ok = size >= least
        if ok.any():
            total = np.where(ok, best[starts] + cost + penalty, np.inf)
            k = int(total.argmin())
            best[t], back[t] = total[k], starts[k]
            if prune == "exact":
                lost = starts[ok & (best[starts] + cost > best[t])]
                until[lost] = np.minimum(until[lost], t + least)
            else:
                starts = starts[best[starts] + penalty <= best[t]]
        starts = np.append(starts, t)
    out, t = [], n
    while back[t] > 0:
        t = int(back[t])
        out.append(t)
    return out[::-1]


def classify_segments(x: np.ndarray, cuts: list[int], times: np.ndarray, cv: float = 0.6) -> tuple[float | None, list[dict]]:
    """(start of the first periodic segment behind an aperiodic one, shifts of the period by more than a tenth between periodic neighbours)."""
    edges = [0, *cuts, len(x)]
    parts = []
    for a, b in zip(edges, edges[1:]):
        mean = float(x[a:b].mean())
        parts.append((a, mean, mean > 0 and float(x[a:b].std()) / (mean + 1e-9) < cv))
    start, shifts = None, []
    for (_, m0, p0), (a, m1, p1) in zip(parts, parts[1:]):
        if p1 and not p0 and start is None:
            start = float(times[a])
        if p0 and p1 and m0 > 0 and abs(m1 - m0) / m0 > 0.10:
            shifts.append({"timestamp": float(times[a]), "old_period_s": round(m0, 1), "new_period_s": round(m1, 1), "delta_pct": round((m1 - m0) / m0 * 100, 1)})
    return start, shifts


def analyse(times: np.ndarray, cfg: Settings) -> dict:
    p = cfg.pelt
    t = np.sort(times)
    x = np.diff(t)
    if len(t) < p.min_observations or len(x) < 10:
        return {"n_changepoints": 0, "changepoint_times": [], "beacon_start_ts": None, "beacon_start_dt": None, "pre_start_iat_mean": None, "post_start_iat_mean": None, "interval_shifts": [], "has_interval_shift": False, "pelt_cost": None}
    penalty = max(2 * np.log(max(len(x), 2)) * float(x.var()), 1.0) if p.penalty == "bic" else float(p.penalty)
    cuts = segment(x, penalty, p.min_segment_length, "reference" if cfg.parity == "reference" else p.prune)
    start, shifts = classify_segments(x, cuts, t, cfg.periodicity.cv_threshold)
    before = x[t[:-1] < start] if start is not None else x[:0]
    after = x[t[:-1] >= start] if start is not None else x
    edges = [0, *cuts, len(x)]
    cost = sum(float(((x[a:b] - x[a:b].mean()) ** 2).sum()) for a, b in zip(edges, edges[1:]))
    return {
        "n_changepoints": len(cuts), "changepoint_times": [float(t[k]) for k in cuts], "beacon_start_ts": start,
        "beacon_start_dt": None if start is None else pd.Timestamp(start, unit="s", tz="UTC").strftime("%Y-%m-%d %H:%M:%S UTC"),
        "pre_start_iat_mean": round(float(before.mean()), 1) if len(before) else None, "post_start_iat_mean": round(float(after.mean()), 1) if len(after) else None,
        "interval_shifts": shifts, "has_interval_shift": bool(shifts), "pelt_cost": round(cost, 1),
    }


def changepoints(events: DataFrame, entity: str, time: str, cfg: Settings | None = None) -> DataFrame:
    """One row for each entity; ordered by start, none last.  The dynamic program is sequential, so an entity is one group."""
    cfg = cfg or Settings()
    ship(events.sparkSession)
    out = T.StructType([T.StructField(entity, events.schema[entity].dataType), *RESULT.fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{entity: pdf[entity].iloc[0], **analyse(pdf[time].dropna().to_numpy(float), cfg)}])

    return events.select(entity, time).groupBy(entity).applyInPandas(run, out).orderBy(F.asc_nulls_last("beacon_start_ts"), entity)


def segment_table(events: DataFrame, entity: str, time: str, boundaries: DataFrame, cv: float = 0.6) -> DataFrame:
    """(entity, segment, n, mean, cv, is_periodic, prev_mean, is_start, is_shift) of given boundaries (entity, boundary): the same classification in SQL."""
    from pyspark.sql import Window

    rows = iat_rows(events, entity, time)
    marked = rows.join(boundaries.select(entity, F.col("boundary").alias("j"), F.lit(1).alias("_cut")), [entity, "j"], "left")
    run = Window.partitionBy(entity).orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    parts = marked.withColumn("segment", F.sum(F.coalesce("_cut", F.lit(0))).over(run)).groupBy(entity, "segment").agg(F.count("*").alias("n"), F.avg("iat").alias("mean"), (F.stddev_pop("iat") / (F.avg("iat") + 1e-9)).alias("cv"))
    parts = parts.withColumn("is_periodic", (F.col("mean") > 0) & (F.col("cv") < cv))
    order = Window.partitionBy(entity).orderBy("segment")
    parts = parts.withColumn("prev_mean", F.lag("mean").over(order)).withColumn("_p", F.lag("is_periodic").over(order))
    return parts.withColumns({"is_start": F.coalesce(F.col("is_periodic") & ~F.col("_p"), F.lit(False)), "is_shift": F.coalesce(F.col("is_periodic") & F.col("_p") & (F.abs(F.col("mean") - F.col("prev_mean")) / F.col("prev_mean") > 0.10), F.lit(False))}).drop("_p")
