"""The timing queries on small tables made here, against their SQL or by hand."""

import ast
from pathlib import Path

import duckdb
import pytest

from tidewatch.plans import catalog


@pytest.mark.parametrize("path", sorted(Path(catalog.__file__).parent.glob("*.py")), ids=lambda p: p.stem)
def test_no_function_replaces_another(path):
    names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef)]
    assert len(names) == len(set(names))


@pytest.fixture
def beats(spark, tmp_path):
    """The folder of a table: user 0 beats every 300 s, user 1 grows slower, user 2 has nine events, user 3 two hundred at uneven times."""
    times = {0: [300 * i for i in range(80)], 1: [40 * i * i for i in range(30)], 2: [300 * i for i in range(9)], 3: [97 * i + 61 * (i * i % 7) for i in range(200)]}
    at = "CAST(timestampadd(SECOND, s, TIMESTAMP_NTZ'2024-01-02 00:00:00') AS TIMESTAMP_NTZ)"
    made = spark.createDataFrame([(u, s) for u, all_ in times.items() for s in all_], "user_id bigint, s int")
    made.selectExpr("CAST(monotonically_increasing_id() AS BIGINT) AS event_id", f"{at} AS ts", "user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def both(spark, folder, name):
    """Rows of the query and of its SQL, as dictionaries in order."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    cur = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    return [r.asDict() for r in catalog.queries()[name](spark, folder).collect()], [dict(zip(names, r)) for r in cur.fetchall()]


def test_periodicity_scores(spark, beats):
    got, want = both(spark, beats, "periodicity_scores")
    assert sorted(got, key=lambda r: r["user_id"]) == sorted(want, key=lambda r: r["user_id"])
    found = {r["user_id"]: r for r in got}
    assert set(found) == {0, 1, 3} and found[0]["is_periodic"] and found[0]["dominant_period_s"] == 300.0 and not found[1]["is_periodic"]


def test_beacon_confidence(spark, beats):
    got, want = both(spark, beats, "beacon_confidence")
    assert sorted(got, key=lambda r: r["user_id"]) == sorted(want, key=lambda r: r["user_id"])
    assert {r["user_id"]: r["beacon_confidence"] for r in got}[0] == 0.8  # 0.4 for the peak, 0.3 for even gaps, 0.1 for both; no spectrum in gaps all alike


def test_score_all_channels(spark, beats):
    got, want = both(spark, beats, "score_all_channels")
    assert got == want
    assert (got[0]["user_id"], got[0]["is_beacon_pair"], got[-1]["is_beacon_pair"]) == (0, True, False)  # 0.8 and less than 0.45


@pytest.fixture
def untimed(spark, tmp_path):
    """The folder of a table with events that have no time: user 0 beats 80 times, user 1 nine times and has five such events, user 2 has only such, user 3 beats unevenly and has three."""
    times = {0: [300 * i for i in range(80)], 1: [None] * 5 + [300 * i for i in range(9)], 2: [None] * 12, 3: [97 * i + 61 * (i * i % 7) for i in range(200)] + [None] * 3}
    at = "CAST(timestampadd(SECOND, s, TIMESTAMP_NTZ'2024-01-02 00:00:00') AS TIMESTAMP_NTZ)"
    made = spark.createDataFrame([(u, s) for u, all_ in times.items() for s in all_], "user_id bigint, s int")
    made.selectExpr("CAST(monotonically_increasing_id() AS BIGINT) AS event_id", f"{at} AS ts", "user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_beacon_confidence_counts_events_without_a_time(spark, untimed):
    got, want = both(spark, untimed, "beacon_confidence")
    assert sorted(got, key=lambda r: r["user_id"]) == sorted(want, key=lambda r: r["user_id"])
    assert {r["user_id"]: r["beacon_confidence"] for r in got}.items() >= {0: 0.8, 1: 0.8, 2: 0.0}.items()


def test_score_all_channels_counts_events_without_a_time(spark, untimed):
    got, want = both(spark, untimed, "score_all_channels")
    assert got == want
    assert [(r["user_id"], r["is_beacon_pair"]) for r in got][:2] == [(0, True), (1, True)] and got[-1] == {"user_id": 2, "beacon_confidence": 0.0, "is_beacon_pair": False}


def test_score_all_channels_puts_no_user_last_among_equals(spark, tmp_path):
    """Events without a user are a channel of their own, with 0; so have users 3 and -5, whose events have no time."""
    at = "CAST(timestampadd(SECOND, s, TIMESTAMP_NTZ'2024-01-02 00:00:00') AS TIMESTAMP_NTZ)"
    made = [(0, 300 * i) for i in range(80)] + [(None, 300 * i) for i in range(40)] + [(3, None)] * 12 + [(-5, None)] * 15
    spark.createDataFrame(made, "user_id bigint, s int").selectExpr("CAST(monotonically_increasing_id() AS BIGINT) AS event_id", f"{at} AS ts", "user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    got, want = both(spark, str(tmp_path), "score_all_channels")
    assert got == want
    assert [(r["user_id"], r["beacon_confidence"]) for r in got] == [(0, 0.8), (-5, 0.0), (3, 0.0), (None, 0.0)]


def test_score_all_channels_does_not_hang_on_the_session_zone(spark, tmp_path):
    """Beats of 900 s over the night of 2024-03-10, when New York's clocks skip the hour from 2 to 3."""
    made = [(u, (900 + u) * i) for u in range(3) for i in range(80)]
    at = "CAST(timestampadd(SECOND, s, TIMESTAMP_NTZ'2024-03-09 18:00:00') AS TIMESTAMP_NTZ)"
    spark.createDataFrame(made, "user_id bigint, s int").selectExpr("CAST(monotonically_increasing_id() AS BIGINT) AS event_id", f"{at} AS ts", "user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got, want = both(spark, str(tmp_path), "score_all_channels")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == want
    assert got[0] == {"user_id": 0, "beacon_confidence": 0.8, "is_beacon_pair": True}


def test_score_all_channels_reads_times_with_a_zone_as_instants(spark, tmp_path):
    """The same beats in a column of instants, also in sessions of other zones."""
    made = [(u, 1709985600 + (900 + u) * i) for u in range(3) for i in range(80)]
    spark.createDataFrame(made, "user_id bigint, s bigint").selectExpr("CAST(monotonically_increasing_id() AS BIGINT) AS event_id", "timestamp_seconds(s) AS ts", "user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got, want = both(spark, str(tmp_path), "score_all_channels")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == want
    assert got[0] == {"user_id": 0, "beacon_confidence": 0.8, "is_beacon_pair": True}
