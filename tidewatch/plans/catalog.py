"""Every registered query of the analytics engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators import periodicity
from tidewatch.plans import evidence_queries, flow_queries, series_queries
from tidewatch.plans.standins import events


def queries() -> dict:
    return flow_queries.QUERIES | series_queries.QUERIES | evidence_queries.QUERIES


def oracle_sql() -> dict:
    return flow_queries.SQL | series_queries.SQL | evidence_queries.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beacon confidence of every entity with enough events, surest first."""
    from pyspark.sql import functions as F

    return periodicity.score_channels(events(spark, sf_dir), "user_id", "timestamp").orderBy(F.desc("beacon_confidence"), "user_id")
