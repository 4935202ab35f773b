"""Cleaning and deriving columns of flows.  A flow has ``timestamp`` in unix seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def time_parts(df: DataFrame) -> DataFrame:
    """``datetime``, and hour and minute in UTC whatever the session's zone."""
    at, day = F.timestamp_micros(F.floor(F.col("timestamp") * 1e6).cast("bigint")), F.pmod(F.floor("timestamp"), F.lit(86_400))
    return df.withColumns({"datetime": at, "hour": F.floor(day / 3600).cast("int"), "minute": F.floor(day % 3600 / 60).cast("int")})


def cyclic_time(df: DataFrame) -> DataFrame:
    """Sine and cosine of the time of day in whole milliseconds."""
    turn = 2 * F.pi() * F.pmod(F.floor(F.col("timestamp") * 1000), F.lit(DAY_MS)) / DAY_MS
    return df.withColumns({"sin_time": F.sin(turn), "cos_time": F.cos(turn)})


def total_bytes(df: DataFrame) -> DataFrame:
    return df.withColumn("total_bytes", F.coalesce("resp_bytes", F.lit(0)) + F.coalesce("src_bytes", F.lit(0)))


def drop_missing_required(df: DataFrame, columns: tuple[str, ...] = ("service", "duration")) -> DataFrame:
    out = df
    for c in columns:
        if c in df.columns:
            out = out.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return out


def dedup_flows(df: DataFrame, key: tuple[str, ...] = ("timestamp", "src_ip", "dst_ip", "src_p", "dst_p"), order: tuple[str, ...] = ()) -> DataFrame:
    """Rows without nulls, one for each key: the first by ``order`` and then by all columns, so the choice is fixed."""
    keys = [c for c in key if c in df.columns]
    rest = [c for c in (*order, *sorted(set(df.columns) - set(keys) - set(order)))]
    by = Window.partitionBy(*keys).orderBy(*(rest or keys))
    return df.dropna("any").withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_rank")


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A 0/1 column for each value beside the source column."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def frequency_encode(df: DataFrame, columns: tuple[str, ...] = ("src_ip", "dst_ip")) -> DataFrame:
    """How often each row's value occurs: counted with partial sums and joined back.  Where the counts are too many to
    broadcast, rows are dealt by value, so a value that very many rows share makes a large task."""
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias(f"{c}_freq"))
        df = df.join(counts, c, "left")
    return df


def strip_scaled(df: DataFrame, suffix: str = "_stdz") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])


def prepare(flows: DataFrame) -> DataFrame:
    """Raw connection rows to flows, in order of dependence; source columns are kept."""
    out = cyclic_time(time_parts(flows))
    if {"resp_bytes", "src_bytes"} <= set(out.columns):
        out = total_bytes(out)
    return drop_missing_required(out)
