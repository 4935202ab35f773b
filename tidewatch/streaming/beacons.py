"""Streams of flows: timing per channel that is kept up to date, windows and sessions.

Beyond batch: the same gap statistics as the batch features for flows that arrive in time order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.runtime import ship


def windowed_volume(flows: DataFrame, key: list[str], at: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(key, window, n): tumbling counts; rows later than the watermark are left out."""
    return flows.withWatermark(at, late).groupBy(*key, F.window(at, width)).agg(F.count("*").alias("n"))


def sessions(flows: DataFrame, key: list[str], at: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, session_window, n): bursts of activity."""
    return flows.withWatermark(at, late).groupBy(*key, F.session_window(at, gap)).agg(F.count("*").alias("n"))


def running_timing(flows: DataFrame, entity: str, time: str) -> DataFrame:
    """(entity, n, iat_mean, iat_cv) after every micro-batch, from a state of five numbers for each entity (running mean and squared deviations)."""
    ship(flows.sparkSession)

    def step(key, frames, state: GroupState):
        n, last, k, mean, m2 = state.get if state.exists else (0, 0.0, 0, 0.0, 0.0)
        for t in sorted(t for pdf in frames for t in pdf[time].dropna()):
            if n and t > last:
                k += 1
                d = (t - last) - mean
                mean += d / k
                m2 += d * ((t - last) - mean)
            n, last = n + 1, max(last, t) if n else t
        state.update((n, last, k, mean, m2))
        cv = (m2 / k) ** 0.5 / mean if k >= 2 and mean > 0 else None
        yield pd.DataFrame({entity: [key[0]], "n": [n], "iat_mean": [mean if k >= 2 else None], "iat_cv": [cv]}).astype({"iat_mean": float, "iat_cv": float})

    kind = flows.schema[entity].dataType.simpleString()
    return flows.groupBy(entity).applyInPandasWithState(step, f"{entity} {kind}, n long, iat_mean double, iat_cv double", "n long, last double, k long, mean double, m2 double", "update", GroupStateTimeout.NoTimeout)
