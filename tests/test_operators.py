"""Golden values, numpy readings, invariants and edge cases of the analytics operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import Settings
from tidewatch.functions import expr as X
from tidewatch.operators import anomaly, changepoint, corroborate, features, periodicity, prefilter, prepare, sax, triage
from tidewatch.sources import logs

# fixed values: published results of the method on seven pairs
WORDS = [("ccbccbbbbcbcbbcbcccc", 0.321, 0.4674, 0.5), ("bcbccbbccbbcbcbcbbbb", 0.3499, 0.2982, 0.6), ("cbbbdccbcbbbcbbbcdcb", 0.4316, 0.4939, 0.6), ("cccbbbbccbccbbbbbcbb", 0.3499, 0.5833, 0.5), ("cabbbbaddcca", 0.7706, 0.5789, 0.5)]
CONFIDENCES = [(0.8369, 0.0504, 1.0, True, 0.9748), (0.7795, 0.0511, 1.0, True, 0.9744), (0.4577, 0.2011, 1.0, True, 0.8994), (0.3464, 1.0643, 0.0, False, 0.4)]


def test_words(spark):
    df = spark.createDataFrame([(w, [ord(c) - 97 for c in w]) for w, *_ in WORDS], "sax_word string, symbols array<int>")
    got = {r.sax_word: r for r in sax.word_tests(df).collect()}
    for w, cv, acf, motif in WORDS:
        assert got[w].sax_symbol_cv == pytest.approx(cv, abs=1e-4) and got[w].sax_acf_peak == pytest.approx(acf, abs=1e-4) and got[w].sax_motif_fraction == motif


def test_confidence(spark):
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(CONFIDENCES)], "acf_peak double, iat_cv double, fft_power_ratio double, is_periodic boolean, want double, i int")
    assert all(r.beacon_confidence == pytest.approx(r.want, abs=2e-4) for r in periodicity.beacon_confidence(df).collect())


def test_tiers(spark):
    rows = [(0.40, 0.0, 0.0, True, True, False, False, 0, 0, 0.73), (0.75, 0.9, 0.0, True, True, True, True, 5, 0, 0.93), (0.75, 0.0, 0.435, True, True, False, False, 0, 3, 0.594)]
    df = spark.createDataFrame(rows, "d double, h double, t double, h1 boolean, h2 boolean, h3 boolean, h4 boolean, hf int, sf int, want double")
    no = F.lit(False)
    got = df.select("want", corroborate.corroboration_score(F.col("d"), F.col("h"), F.col("t"), [F.col("h1"), F.col("h2"), F.col("h3"), F.col("h4"), no, no], F.col("hf"), F.col("sf")).alias("s")).collect()
    assert [r.s for r in got] == pytest.approx([r.want for r in got], abs=1e-4)


def series(spark, times, name="a"):
    return spark.createDataFrame([(name, float(t)) for t in times], "id string, t double")


@pytest.mark.parametrize("period,n", [(300, 60), (3600, 30)])
def test_regular_series(spark, period, n):
    t = 1.7e9 + period * np.arange(n)
    got = periodicity.score_channels(series(spark, t), "id", "t").first()
    assert period * 0.5 < got.dominant_period_s < period * 1.5 and got.is_beacon_pair


def test_acf_equals_dense_histograms(spark):
    r = np.random.default_rng(1)
    for k, t in enumerate([1.7e9 + np.cumsum(r.exponential(100, 80)), 1.7e9 + 61.7 * np.arange(90), 1.7e9 + np.cumsum(300 + 20 * r.normal(size=70))]):
        got = {x.lag: x.r for x in periodicity.binned_acf(series(spark, t), "id", "t").collect()}
        gaps = np.diff(np.sort(t))
        b = max(np.median(gaps[gaps > 0]) / 2, 1.0)
        c = np.histogram(t, np.arange(t.min(), t.max() + b, b))[0].astype(float)
        x = c - c.mean()
        want = {j: (x[:-j] * x[j:]).sum() / ((x**2).sum() + 1e-9) for j in range(1, (40 if len(c) >= 42 else max(1, len(c) - 2)) + 1)}
        assert got.keys() == want.keys() and all(got[j] == pytest.approx(want[j], abs=5e-3 if k == 1 else 1e-6) for j in want)


def test_welch_closed_form_holds_at_default():
    r = np.random.default_rng(2)
    for n in (8, 30, 59, 60, 64, 100, 500):
        period, ratio = periodicity.welch(300 + 20 * r.normal(size=n), 60.0)
        assert (period, ratio) == ((min(n, 64), pytest.approx(1.0)) if n >= 60 else (0.0, 0.0))


def test_segmentation():
    r = np.random.default_rng(3)
    x = np.concatenate([300 + 5 * r.normal(size=60), 3000 + 5 * r.normal(size=60), 300 + 5 * r.normal(size=60)])
    pen = 2 * math.log(len(x)) * x.var()
    assert changepoint.segment(x, pen, 5) == [60, 120] and changepoint.segment(x, pen, 5, "reference") == []
    best = np.full(len(x) + 1, np.inf)
    best[0] = -pen
    for t in range(5, len(x) + 1):  # without any pruning
        best[t] = min(best[s] + ((x[s:t] - x[s:t].mean()) ** 2).sum() + pen for s in range(t - 4) if np.isfinite(best[s]))
    cuts = [0, *changepoint.segment(x, pen, 5), len(x)]
    assert sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(cuts, cuts[1:])) + pen * (len(cuts) - 2) == pytest.approx(best[-1])


def test_changepoints_of_a_changed_interval(spark):
    r = np.random.default_rng(4)
    t = 1.7e9 + np.cumsum(np.concatenate([300 + 5 * r.normal(size=60), 900 + 5 * r.normal(size=60)]))
    df = series(spark, t).union(series(spark, t[:5], "few"))
    got = {x.id: x for x in changepoint.changepoints(df, "id", "t").collect()}
    assert got["a"].n_changepoints == 1 and got["a"].has_interval_shift and got["few"].n_changepoints == 0
    parity = changepoint.changepoints(df, "id", "t", Settings(parity="reference")).where("id = 'a'").first()
    assert parity.n_changepoints == 0


def test_forest_ranks_outliers(spark):
    r = np.random.default_rng(5)
    rows = [(f"c{i}", float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(400, 2)))] + [(f"x{i}", 9.0 + i, -9.0 - i) for i in range(5)]
    df = spark.createDataFrame(rows, "channel_id string, a double, b double")
    scored = anomaly.percentile_label(anomaly.isolation_scores(df, ["a", "b"]))
    assert {x.channel_id for x in scored.where("iforest_label = -1").collect()} >= {f"x{i}" for i in range(5)}
    again = {x.channel_id: x.iforest_score for x in anomaly.isolation_scores(df.repartition(7), ["a", "b"]).collect()}
    assert all(again[x.channel_id] == x.iforest_score for x in scored.collect())


FLOW = "timestamp double, src_ip string, dst_ip string, dst_p int, resp_bytes bigint, src_bytes bigint, duration double, conn_state string, service string"


def flow_rows(n, src="10.0.0.1", dst="203.0.113.5", state="SF", step=100.0):
    return [(1.7e9 + i * step, src, dst, 443, 100, 10, 1.0, state, "ssl") for i in range(n)]


def test_channel_features_and_edges(spark):
    df = spark.createDataFrame([*flow_rows(10), *flow_rows(7, "10.0.0.2"), *[(1.7e9, "10.0.0.3", "203.0.113.5", 443, 0, 0, None, None, None)] * 9, (1.7e9, None, "x", 1, 1, 1, 1.0, "SF", "a")], FLOW)
    got = {r.src_ip: r for r in features.aggregate_channels(df, wanted=("src_ip", "dst_ip")).collect()}
    assert set(got) == {"10.0.0.1", "10.0.0.3"}
    a, c = got["10.0.0.1"], got["10.0.0.3"]
    assert a.iat_cv == 0 and a.missing_beat_rate == 0 and a.bytes_cv == 0 and a.persistence_ratio == pytest.approx(1.0) and a.conn_state_entropy == pytest.approx(0, abs=1e-9)
    assert c.iat_mean_s is None and c.zero_payload_frac == 1 and c.req_resp_asymmetry is None
    assert features.aggregate_channels(df.limit(0), wanted=("src_ip", "dst_ip")).count() == 0
    scaled = features.standard_scale(features.aggregate_channels(df, wanted=("src_ip", "dst_ip"))).collect()
    assert all(v is not None and math.isfinite(v) for r in scaled for k, v in r.asDict().items() if k.endswith("_stdz"))


def test_prefilter_rules_and_valve(spark):
    rows = [*flow_rows(9), *flow_rows(9, "10.0.0.2", "10.9.9.9"), *flow_rows(9, "10.0.0.2", "8.8.8.8"), *flow_rows(9, "10.0.0.2", "17.253.34.123"), *flow_rows(9, "10.0.0.2", "104.18.1.1"), *flow_rows(10, "10.0.0.2", "198.51.100.1", "REJ"), *flow_rows(9, "10.0.0.2", "198.51.100.7"), *flow_rows(9, "93.184.1.1", "198.51.100.8")]
    df = spark.createDataFrame(rows, FLOW)
    channels = features.aggregate_channels(df, wanted=("src_ip", "dst_ip"))
    got = {(r.src_ip, r.dst_ip): r.prefilter_reason for r in prefilter.classify(channels, df, allowlist=("198.51.100.7",)).collect()}
    assert got == {
        ("10.0.0.1", "203.0.113.5"): None, ("10.0.0.2", "10.9.9.9"): "both_internal", ("10.0.0.2", "8.8.8.8"): "known_dns_resolver", ("10.0.0.2", "17.253.34.123"): "known_ntp", ("10.0.0.2", "104.18.1.1"): "known_cdn",
        ("10.0.0.2", "198.51.100.1"): "dead_pair_failed_conns", ("10.0.0.2", "198.51.100.7"): "custom_allowlist", ("93.184.1.1", "198.51.100.8"): None,
    }
    hot = spark.createDataFrame([r for s in range(4) for r in flow_rows(9, f"10.0.1.{s}")], FLOW)
    all_hot = features.aggregate_channels(hot, wanted=("src_ip", "dst_ip"))
    assert {r.prefilter_reason for r in prefilter.classify(all_hot, hot).collect()} == {None}  # the valve opens
    assert {r.prefilter_reason for r in prefilter.classify(all_hot, hot, least_kept=0.0).collect()} == {"high_fanin_destination"}


def test_priority_is_the_sum_of_its_parts(spark):
    df = spark.createDataFrame(flow_rows(40), FLOW)
    r = triage.priority_score(df, ["src_ip", "dst_ip"]).first()
    assert r.priority_score == r.score_beacon + r.score_payload + r.score_persistence + r.score_period_agree + r.score_temporal <= 10


def test_tls_evidence(spark):
    rows = [("10.0.0.1", "203.0.113.5", None, "a" * 32, "F1", "ok", i < 17) for i in range(20)] + [("10.0.0.2", "203.0.113.5", "x.y", "b" * 32, "", "self signed certificate in chain", False) for _ in range(10)]
    ssl = spark.createDataFrame(rows, "src_ip string, dst_ip string, server_name string, ja3 string, cert_chain_fuids string, validation_status string, resumed boolean")
    got = {r.src_ip: r for r in corroborate.score_tls(ssl.select("src_ip", "dst_ip").distinct(), ssl).collect()}
    a, b = got["10.0.0.1"], got["10.0.0.2"]
    assert a.h5_ja3_monotonic and a.h6_absent_sni and a.h6_high_resumption and a.tls_score > 0 and b.h6_self_signed and b.h6_tls_anomaly and b.h5_sni_stable


def test_loaders(spark, tmp_path):
    (tmp_path / "dns.csv").write_text("ts,id.orig_h,query,rcode_name,answers,TTLs\n5.0,10.0.0.1,a.b,NOERROR,1.2.3.4,60\nbad,10.0.0.1,a.b,,,\n9.0,,a.b,,,\n50,10.0.0.2,c.d,NXDOMAIN,,\"[60,900]\"\n")
    got = logs.read_dns(spark, str(tmp_path / "dns.csv")).collect()
    assert [(r.ts, r.src_ip, r.ttls) for r in got] == [(5.0, "10.0.0.1", "60"), (50.0, "10.0.0.2", "[60,900]")]
    assert logs.read_dns(spark, str(tmp_path / "dns.csv"), (5.0, 6.0)).count() == 1
    with pytest.raises(ValueError):
        logs.load_dns(spark.createDataFrame([(1.0, "a")], "ts double, src_ip string"))
    no_time = spark.createDataFrame([("10.0.0.1", "x")], "src_ip string, uri string")
    assert logs.load_http(no_time).count() == 1 and logs.load_http(no_time, (0.0, 1.0)).count() == 0
    (tmp_path / "conn.csv").write_text("timestamp,source.ip,destination.ip,source.port,destination.port,source.bytes,destination.bytes,event.duration,network.connection.state,network.protocol,scenario\n1.7e9,10.0.0.1,1.2.3.4,1,443,5,6,0.5,SF,ssl,\n1.7e9,10.0.0.1,1.2.3.4,1,443,5,6,,SF,ssl,x\n")
    flows = prepare.prepare(logs.normalize_schema(logs.scan_conn(spark, str(tmp_path / "conn.csv"))))
    assert [(r.src_ip, r.dst_p, r.total_bytes, r.scenario) for r in flows.collect()] == [("10.0.0.1", 443, 11, None)]


def test_settings(tmp_path):
    s = Settings()
    s.to_json(str(tmp_path / "s.json"))
    assert Settings.from_json(str(tmp_path / "s.json")) == s and s.corroboration.min_score == 0.55
    (tmp_path / "p.json").write_text(json.dumps({"sax": {"word_length": 10}}))
    assert Settings.from_json(str(tmp_path / "p.json")).sax.word_length == 10
    (tmp_path / "bad.json").write_text(json.dumps({"sax": {"no": 1}}))
    with pytest.raises(ValueError):
        Settings.from_json(str(tmp_path / "bad.json"))


def test_expressions(spark):
    row = spark.range(1).select(
        X.is_internal(F.lit("::1")).alias("a"), X.is_internal(F.lit("2001:db8::1")).alias("b"), X.is_internal(F.lit(None).cast("string")).alias("c"), X.in_prefixes(F.lit("104.16.0.1")).alias("d"), X.string_entropy(F.lit("")).alias("e"), X.string_entropy(F.lit("AbaB")).alias("f"),
        X.benign_domain(F.lit("A.Google.com.")).alias("g"), X.benign_domain(F.lit("notgoogle.com")).alias("h"), X.looks_generated(F.lit("xk2j9qwzrtpl.com")).alias("i"), X.looks_generated(F.lit("wikipedia.org")).alias("j"), X.answer_ips(F.lit("['1.2.3.4', x, fe80::1]")).alias("k"),
    ).first()
    assert tuple(row) == (True, False, False, True, 0.0, 1.0, True, False, True, False, ["1.2.3.4", "fe80::1"])


def test_segmentation_equals_a_plain_program_on_many_series():
    import numpy as np

    from tidewatch.operators.changepoint import segment

    def cost(x, a, b):
        return float(((x[a:b] - x[a:b].mean()) ** 2).sum())

    r = np.random.default_rng(3)
    for k in range(1000):
        n, least = int(r.integers(4, 40)), int(r.choice([2, 3, 5]))
        x = r.choice([10.0, 60.0, 300.0], size=n) * r.normal(1, 0.2, size=n) if k % 2 else np.repeat(r.normal(100, 50, size=n), r.integers(1, 6, size=n))[:n]
        penalty = max(2 * np.log(n) * x.var() * r.choice([1, 0.3, 0.1]), 1e-9)
        best = [-penalty] + [np.inf] * n
        for t in range(1, n + 1):
            best[t] = min((best[s] + cost(x, s, t) + penalty for s in range(0, t - least + 1) if best[s] < np.inf), default=np.inf)
        edges = [0, *segment(x, penalty, least), n]
        if n >= 2 * least:
            assert min(b - a for a, b in zip(edges, edges[1:])) >= least
            got = sum(cost(x, a, b) + penalty for a, b in zip(edges, edges[1:])) - penalty
            assert np.isclose(got, best[n], rtol=1e-9, atol=1e-6 * x.var()), (k, got, best[n])


def test_agents_as_seen_and_any_known_fingerprint(spark):
    """Agents in order of their first time, not of the alphabet; a known fingerprint counts wherever it sorts."""
    rows = [("a", "b", 100.0 - i, f"agent{i:02d}") for i in range(12)] + [("a", "b", 500.0, "agent11"), ("a", "c", None, None)]
    got = {r.dst_ip: r.seen for r in corroborate.first_seen(spark.createDataFrame(rows, "src_ip string, dst_ip string, ts double, ua string"), ["src_ip", "dst_ip"], "ua").collect()}
    assert got == {"b": [f"agent{i:02d}" for i in range(11, 1, -1)], "c": [None]}
    known = Settings().corroboration.tls.ja3_known_c2[0]
    prints = [f"{k:032x}" for k in range(5)] + [known]
    ssl = spark.createDataFrame([("a", "b", float(i), "x.example", p, "F", "ok", False) for i, p in enumerate(prints)], "src_ip string, dst_ip string, ts double, server_name string, ja3 string, cert_chain_fuids string, validation_status string, resumed boolean")
    r = corroborate.score_tls(spark.createDataFrame([("a", "b")], "src_ip string, dst_ip string"), ssl).first()
    assert r.h6_known_c2_ja3 and known not in r.observed_ja3s and len(r.observed_ja3s) == 5
