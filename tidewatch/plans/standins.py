"""The driver's tables seen as telemetry, for Spark and, as CTEs of the same names, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(kind: str, column: str = "ts"):
    """Unix seconds of a timestamp of type ``kind``, whatever the session's zone: one without a zone is read as UTC, one with it is an instant."""
    if kind == "timestamp":
        return F.unix_micros(column).cast("double") / 1e6
    whole = f"unix_date(CAST({column} AS DATE)) * 86400L + hour({column}) * 3600 + minute({column}) * 60"
    return F.expr(f"({whole}) * 1000000 + CAST(extract(SECOND FROM {column}) * 1000000 AS BIGINT)").cast("double") / 1e6


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    return t.select("event_id", "user_id", "event_type", "value", "props", seconds(dict(t.dtypes)["ts"]).alias("timestamp"))


EVENTS = "ev AS (SELECT event_id, user_id, event_type, value, props, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS timestamp FROM events)"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    dst = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("203.0.113."), u % 7))
        .when(F.col("event_type") == "view", F.concat(F.lit("104.18."), u % 5, F.lit(".9")))
        .when(F.col("event_type") == "error", F.concat(F.lit("198.51.100."), u % 40))
        .when(F.col("event_type") == "purchase", F.lit("8.8.8.8"))
        .otherwise(F.concat(F.lit("10.9.9."), u % 3))
    )
    return events(spark, sf_dir).select(
        "event_id", "timestamp", F.concat(F.lit("10.0."), F.floor(u / 250), F.lit("."), u % 250).alias("src_ip"), dst.alias("dst_ip"), F.get_json_object("props", "$.k").cast("int").alias("dst_p"), (F.col("event_id") % 50000).cast("int").alias("src_p"),
        F.col("value").alias("resp_bytes"), (F.col("value") * 0.3).alias("src_bytes"), (F.col("value") / 100).alias("duration"), F.when(F.col("event_type") == "error", "REJ").when(F.col("event_id") % 13 == 0, "S0").otherwise("SF").alias("conn_state"), F.col("event_type").alias("service"),
    )


FLOWS = (
    EVENTS
    + """, flows AS (
  SELECT event_id, timestamp, concat('10.0.', user_id // 250, '.', user_id % 250) AS src_ip,
    CASE event_type WHEN 'click' THEN concat('203.0.113.', user_id % 7) WHEN 'view' THEN concat('104.18.', user_id % 5, '.9')
      WHEN 'error' THEN concat('198.51.100.', user_id % 40) WHEN 'purchase' THEN '8.8.8.8' ELSE concat('10.9.9.', user_id % 3) END AS dst_ip,
    CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS dst_p, CAST(event_id % 50000 AS INTEGER) AS src_p, value AS resp_bytes, value * 0.3 AS src_bytes, value / 100 AS duration,
    CASE WHEN event_type = 'error' THEN 'REJ' WHEN event_id % 13 = 0 THEN 'S0' ELSE 'SF' END AS conn_state, event_type AS service
  FROM ev)"""
)


def addressed(df: DataFrame) -> DataFrame:
    """The sources of ``flows`` as valid addresses: numbers past 255 carry (10.0.256.1 is 10.1.0.1, up to 16 million users), so no two become one.

    Users past 63,999 have names that are no addresses, and what reads addresses would not see them in 10.0.0.0/8.
    """
    third = F.get(F.split("src_ip", r"\."), 2).try_cast("int")
    carried = F.concat(F.lit("10."), F.floor(third / 256), F.lit("."), third % 256, F.lit("."), F.substring_index("src_ip", ".", -1))
    return df.withColumn("src_ip", F.when(third > 255, carried).otherwise(F.col("src_ip")))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zero made zero."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])
