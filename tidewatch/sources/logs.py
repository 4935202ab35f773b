"""Readers of the four logs, and the sinks.

Every reader has an explicit schema, all of strings where a column mixes forms (TTLs, answers); empty
strings become null.  Times come as unix seconds; a row whose time does not parse has none.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONN = "timestamp double, `source.ip` string, `destination.ip` string, `source.port` int, `destination.port` int, `source.packets` int, `destination.packets` int, `source.bytes` bigint, `destination.bytes` bigint, `event.duration` double, `network.connection.state` string, `network.protocol` string, `network.transport` string, label string, scenario string"
CONN_NAMES = {
    "source.ip": "src_ip", "destination.ip": "dst_ip", "source.port": "src_p", "destination.port": "dst_p", "source.packets": "src_pkts", "destination.packets": "resp_pkts",
    "source.bytes": "src_bytes", "destination.bytes": "resp_bytes", "event.duration": "duration", "network.connection.state": "conn_state", "network.protocol": "service",
    "network.transport": "proto", "orig_bytes": "src_bytes", "bytes": "src_bytes", "ip_bytes": "resp_bytes", "transport": "proto", "ts": "timestamp", "_timestamp": "timestamp",
}
REMOTE_COLUMNS = ("_timestamp", *[c for c in CONN_NAMES if "." in c])


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns as strings."""
    return spark.read.option("header", True).option("nullValue", "").option("enforceSchema", False).csv(path)


def scan_conn(spark: SparkSession, path: str) -> DataFrame:
    """The connection log with typed columns; columns the file lacks are left out."""
    raw = _csv(spark, path)
    types = {f.name: f.dataType for f in T._parse_datatype_string(CONN).fields}
    return raw.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in raw.columns])


def normalize_schema(df: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Rename known columns (first one wins) and keep those asked for."""
    names: dict[str, str] = {}
    for c in df.columns:
        new = CONN_NAMES.get(c, c)
        if new not in names.values():
            names[c] = new
    out = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return out.select(*[c for c in keep if c in out.columns]) if keep else out


def scan_window(table: DataFrame, start, end, limit: int, time: str = "_timestamp", columns: tuple[str, ...] = REMOTE_COLUMNS, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of [start, end) of a remote table, the projected columns it has, at most ``limit``: the first by ``order``, nulls last, or any."""
    rows = table.where((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))
    if order:
        rows = rows.orderBy(*[F.asc_nulls_last(F.col(f"`{c}`")) for c in order])
    return rows.select(*[F.col(f"`{c}`") for c in columns if c in table.columns]).limit(limit)


def timestamp_fallback(df: DataFrame, column: str = "ts") -> DataFrame:
    """Seconds, else milliseconds, else ISO text: one form for the whole table, the first in which any row has a plausible time.

    The choice is a one-row aggregate joined to the rows, not a decision on the driver.
    """
    number = F.col(column).try_cast("double")
    forms = [F.when(number < 1e11, number), F.when(number >= 1e11, number / 1000), F.unix_micros(F.try_to_timestamp(F.col(column).cast("string"))) / 1e6]
    which = df.agg(*[F.count(f).alias(f"_n{i}") for i, f in enumerate(forms)])
    chosen = F.when(F.col("_n0") > 0, forms[0]).when(F.col("_n1") > 0, forms[1]).otherwise(forms[2])
    return df.join(F.broadcast(which)).withColumn("timestamp", chosen).drop("_n0", "_n1", "_n2")


def _log(df: DataFrame, names: dict[str, str], required: tuple[str, ...], dropna: tuple[str, ...], window: tuple[float, float] | None) -> DataFrame:
    for old, new in names.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"the log lacks {missing}")
    seconds = F.col("ts").try_cast("double") if "ts" in df.columns else F.lit(None).cast("double")
    df = df.withColumn("ts", seconds)
    if window:
        df = df.where(F.col("ts").between(*window))
    return df.dropna(subset=list(dropna))


def load_dns(df: DataFrame, window: tuple[float, float] | None = None) -> DataFrame:
    """Closed window; rows without time, source or query go."""
    return _log(df, {"id.orig_h": "src_ip", "rcode_name": "rcode", "TTLs": "ttls"}, ("ts", "src_ip", "query"), ("ts", "src_ip", "query"), window)


def load_http(df: DataFrame, window: tuple[float, float] | None = None) -> DataFrame:
    """A log without times has null times, and no rows if a window is asked for."""
    return _log(df, {"id.orig_h": "src_ip", "id.resp_h": "dst_ip"}, ("src_ip",), ("src_ip",), window)


def load_ssl(df: DataFrame, window: tuple[float, float] | None = None) -> DataFrame:
    return _log(df, {"id.orig_h": "src_ip", "id.resp_h": "dst_ip", "cert_chain": "cert_chain_fuids"}, ("ts", "src_ip"), ("ts", "src_ip"), window)


def read_dns(spark: SparkSession, path: str, window=None) -> DataFrame:
    return load_dns(_csv(spark, path), window)


def read_http(spark: SparkSession, path: str, window=None) -> DataFrame:
    return load_http(_csv(spark, path), window)


def read_ssl(spark: SparkSession, path: str, window=None) -> DataFrame:
    return load_ssl(_csv(spark, path), window)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_summary(counts: DataFrame, path: str, **more) -> dict:
    """The one-row frame of funnel counters as JSON."""
    out = counts.first().asDict() | more
    Path(path).write_text(json.dumps(out, indent=2, default=str))
    return out
