"""The whole engine on generated telemetry, the report, and streams against batch."""

import json

import pytest
from pyspark.sql import functions as F

from tidewatch.config import Channels, Isolation, Settings
from tidewatch.engine import Engine, funnel_counts
from tidewatch.operators import features, prepare, sax
from tidewatch.report import analyst_brief, write_report
from tidewatch.runtime import cut
from tidewatch.sources import synth
from tidewatch.streaming.beacons import running_timing, sessions, windowed_volume


@pytest.fixture(scope="module")
def run(spark):
    data = {k: cut(v, k) for k, v in synth.generate(spark, days=3, bg_rows_per_day=2000, noisy_rows_per_day=200).items()}
    cfg = Settings(isolation=Isolation(contamination=0.10), channels=Channels(max_channels=500))
    return data, Engine(spark, cfg).run(prepare.prepare(data["conn"]), data["dns"], data["http"], data["ssl"])


def test_generated_tables(spark, run):
    data, _ = run
    labels = data["labels"].collect()
    assert {r.scenario for r in labels} == {s.name for s in synth.SCENARIOS}
    again = synth.generate(spark, days=3, bg_rows_per_day=2000, noisy_rows_per_day=200)["conn"]
    digest = lambda df: df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0]
    assert digest(again.repartition(3)) == digest(data["conn"])
    assert data["ssl"].where("src_ip = '10.0.1.50' AND dst_ip = '203.0.113.10'").select("ja3").distinct().count() == 1


def test_leads(run):
    data, art = run
    found = {r.src_ip for r in art.corroboration.where("corroborated").collect()}
    malicious = {s.src_ip for s in synth.SCENARIOS if s.malicious}
    assert not found & {s.src_ip for s in synth.SCENARIOS if not s.malicious}
    assert len(found & malicious) >= 3
    scores = synth.evaluate(art.corroboration.where("corroborated"), data["labels"]).first()
    assert scores.recall >= 0.75 and scores.precision == 1.0
    assert all(0 <= r.corroboration_score <= 1 for r in art.corroboration.collect())
    assert all(0 <= r.priority_score <= 10 for r in art.priority.collect())


def test_report(run, tmp_path):
    _, art = run
    page = write_report(art, str(tmp_path))
    text = open(page).read()
    assert "10.0.1.75" in text and json.load(open(tmp_path / "run_summary.json"))["corroborated"] >= 3
    assert analyst_brief(art.leads).count("\n") > 3
    counts = funnel_counts(art).first()
    assert counts.flows > counts.channels >= counts.kept + counts.removed - 1 and counts.sax_passed <= counts.sax_evaluated


def test_briefs_and_charts(run, tmp_path):
    from tidewatch import report
    from tidewatch.evaluate import briefs

    data, art = run
    text = briefs(art, data["labels"])
    assert "10.0.1.75" in text and "recall" in text and "techniques" in text and "taken out" in text
    assert report.score_histogram(art.scored).agg(F.sum("n")).first()[0] == art.scored.count()
    assert report.confidence_bars(art.periodicity, top=3).count() <= 3
    assert report.period_histogram(art.periodicity).agg(F.sum("n")).first()[0] == art.periodicity.where("is_beacon_pair AND dominant_period_s > 0").count()
    assert report.campaign_timeline(art.changepoints, "src_ip").count() == art.changepoints.where("beacon_start_ts IS NOT NULL").count()
    assert report.sax_points(art.sax).count() == art.sax.count() and report.evidence_points(art.corroboration).count() == art.corroboration.count()
    page = open(report.write_report(art, str(tmp_path), most_leads=1)).read()
    assert page.count("<svg") == 5 and (art.leads.count() <= 1 or "The first 1 of" in page)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"e{i % 3}", 1.7e9 + i * 7.0 + (i % 5)) for i in range(120)]
    schema = "id string, t double"
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = running_timing(stream, "id", "t").writeStream.outputMode("update").format("memory").queryName("timing").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.id: r for r in spark.sql("SELECT id, max_by(n, n) n, max_by(iat_mean, n) m, max_by(iat_cv, n) c FROM timing GROUP BY id").collect()}
    batch = sax.iat_rows(spark.createDataFrame(rows, schema), "id", "t").where("iat > 0").groupBy("id").agg(F.avg("iat").alias("m"), (F.stddev_pop("iat") / F.avg("iat")).alias("c")).collect()
    assert all(got[r.id].m == pytest.approx(r.m) and got[r.id].c == pytest.approx(r.c) for r in batch)


def test_windows_and_sessions(spark):
    df = spark.createDataFrame([("a", i * 60 if i < 5 else 86400 + i) for i in range(8)], "id string, s long").select("id", F.timestamp_seconds("s").alias("at"))
    assert sorted(r.n for r in sessions(df, ["id"], "at").collect()) == [3, 5]
    assert windowed_volume(df, ["id"], "at").agg(F.sum("n")).first()[0] == 8
    assert features.channel_key(df.withColumns({"src_ip": F.lit(1), "dst_ip": F.lit(2)})) == ["src_ip", "dst_ip"]
