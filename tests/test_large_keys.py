"""Queries on tables made here with rows out of order or keys beyond those of the test tables, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import rows
from tidewatch.plans import catalog
from tidewatch.plans.standins import addressed
from tidewatch.sources import logs


def same(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    cur = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    df = catalog.queries()[name](spark, str(folder))
    got = rows(df.columns, df.collect())
    assert got == rows(names, cur.fetchall())
    return got


def test_scan_window_limit_takes_the_first_rows(spark, tmp_path):
    """1,200,000 rows in the window, the largest ids first and in four files."""
    made = spark.range(0, 1_200_000, 1, 4).select((1_199_999 - F.col("id")).alias("event_id"), F.expr("TIMESTAMP_NTZ'2024-01-06 00:00:00'").alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"))
    made.write.parquet(f"{tmp_path}/events.parquet")
    got = same(spark, tmp_path, "scan_window_limit")
    assert len(got) == 1_000_000 and max(r[0] for r in got) == 999_999


def test_scan_window_orders_by_what_it_does_not_return(spark):
    t = spark.createDataFrame([(5, 1.0, "a"), (None, 1.0, "b"), (2, 1.0, "c"), (1, 9.0, "d")], "k int, _timestamp double, v string")
    assert [r.v for r in logs.scan_window(t, 0.0, 2.0, 2, columns=("v",), order=("k",)).collect()] == ["c", "a"]
    assert logs.scan_window(t, 0.0, 2.0, 2, columns=("v",)).count() == 2


@pytest.fixture
def many_users(spark, tmp_path):
    """Users round 64,000, from where on the names of sources are no addresses; a hundred events each, of four types."""
    made = spark.range(0, 2400, 1, 2).select("id", (63_990 + 9 * (F.col("id") % 24) + 20_000 * (F.col("id") % 2)).alias("user_id"), F.floor(F.col("id") / 24).alias("i"))
    kind = F.when(F.col("i") % 3 == 0, "signup").when(F.col("i") % 5 == 0, "purchase").when(F.col("i") % 2 == 0, "error").otherwise("click")
    at = F.expr("CAST(timestampadd(SECOND, CAST(i * 613 AS INT), TIMESTAMP_NTZ'2024-01-02 00:00:00') AS TIMESTAMP_NTZ)")
    made.select(F.col("id").alias("event_id"), at.alias("ts"), "user_id", kind.alias("event_type"), (F.col("i") + 1.0).alias("value"), F.lit('{"k": 5}').alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    return tmp_path


def test_prefilter_classify_many_users(spark, many_users):
    got = same(spark, many_users, "prefilter_classify")
    assert {r[1] for r in got if "→10.9.9." in r[0] and r[0] > "10.0.256"} == {"both_internal"} == {r[1] for r in got if "→10.9.9." in r[0]}


def test_addresses_stay_apart(spark):
    names = [("10.0.5.9",), ("10.0.255.249",), ("10.0.256.9",), ("10.0.361.9",), ("10.0.511.0",), ("10.0.512.0",), ("nothing",), (None,)]
    got = [r.src_ip for r in addressed(spark.createDataFrame(names, "src_ip string")).collect()]
    assert got == ["10.0.5.9", "10.0.255.249", "10.1.0.9", "10.1.105.9", "10.1.255.0", "10.2.0.0", "nothing", None]


def test_prefilter_apply_many_users(spark, many_users):
    got = same(spark, many_users, "prefilter_apply")
    assert all(r[0].split("→")[0] == r[2] for r in got)


def test_prefilter_breakdown_many_users(spark, many_users):
    assert dict((r[1], r[0]) for r in same(spark, many_users, "prefilter_breakdown"))["both_internal"] > 0


def test_funnel_counts_many_users(spark, many_users):
    (got,) = same(spark, many_users, "funnel_counts")
    assert got[0] == got[2] + got[3]
