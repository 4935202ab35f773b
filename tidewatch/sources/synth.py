"""Synthetic telemetry with planted beacons, and evaluation against the plants.

Every random number is a hash of (seed, stream, row), so tables are the same in every process, at any
partitioning, and are made where they are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scenario:
    name: str
    src_ip: str
    dst_ip: str
    dst_port: int
    period_s: float
    jitter: float
    payload: float
    payload_cv: float
    service: str
    domain: str | None  # None: generated names
    malicious: bool
    user_agent: str = "Mozilla/4.0 (compatible; agent)"
    ja3: str = "72a589da586844d7f0818ce684948eea"


# fixed values: the scenarios of the test data
SCENARIOS = (
    Scenario("fast_https_dga", "10.0.1.50", "203.0.113.10", 443, 300, 0.10, 512, 0.05, "ssl", None, True),
    Scenario("slow_http_fixed", "10.0.1.75", "198.51.100.20", 80, 3600, 0.05, 256, 0.03, "http", "updates.dyndns-office.com", True),
    Scenario("multi_host_campaign", "10.0.2.100", "203.0.113.55", 8080, 900, 0.15, 1024, 0.08, "http", None, True),
    Scenario("exfil_slow", "10.0.3.200", "198.51.100.99", 443, 21600, 0.08, 50000, 0.40, "ssl", "cdn.analytics-platform.net", True),
    Scenario("decoy_windows_update", "10.0.1.20", "13.107.4.50", 443, 3600, 0.20, 8192, 0.30, "ssl", "windowsupdate.microsoft.com", False, "Windows Update Agent"),
    Scenario("decoy_ntp", "10.0.1.30", "216.239.35.0", 123, 1024, 0.05, 48, 0.01, "ntp", "time.google.com", False),
)
DAY = 86400.0


def _u(seed: int, stream: str, *row) -> Column:
    """Uniform in (0, 1)."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(stream), *row), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _normal(seed: int, stream: str, *row) -> Column:
    return F.sqrt(-2 * F.log(_u(seed, stream + "/r", *row))) * F.cos(2 * F.pi() * _u(seed, stream + "/a", *row))


def _pick(u: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def generated_name(seed: int, *row) -> Column:
    """8 to 14 consonants and digits below a fixed ending."""
    letters = "bcdfghjklmnpqrstvwxz23456789"
    chars = [F.substring(F.lit(letters), (F.floor(_u(seed, f"dga{i}", *row) * len(letters)) + 1).cast("int"), F.lit(1)) for i in range(14)]
    return F.concat(F.substring(F.concat(*chars), F.lit(1), (8 + F.floor(_u(seed, "dgalen", *row) * 7)).cast("int")), F.lit(".com"))


def firings(spark: SparkSession, scenarios, start: float, days: int, seed: int) -> DataFrame:
    """Times of every scenario: a phase, then periods with normal jitter, added up; with the scenario's columns."""
    from pyspark.sql import types as T

    rows = [tuple(getattr(s, f) for f in Scenario.__dataclass_fields__) for s in scenarios]
    kinds = {"str": T.StringType(), "int": T.IntegerType(), "float": T.DoubleType(), "bool": T.BooleanType(), "str | None": T.StringType()}
    schema = T.StructType([T.StructField(n, kinds[f.type]) for n, f in Scenario.__dataclass_fields__.items()])
    rows = [tuple(float(v) if t.dataType == T.DoubleType() else v for v, t in zip(r, schema)) for r in rows]
    table = spark.createDataFrame(rows, schema)
    counted = table.withColumn("i", F.explode(F.sequence(F.lit(0), F.ceil(days * DAY / F.col("period_s") * 1.2).cast("int"))))
    step = F.when(F.col("i") == 0, F.col("period_s") * _u(seed, "phase", "name")).otherwise(F.greatest(F.col("period_s") * 0.1, F.col("period_s") * (1 + F.col("jitter") * _normal(seed, "step", "name", "i"))))
    return counted.withColumn("at", start + F.sum(step).over(Window.partitionBy("name").orderBy("i"))).where(F.col("at") < start + days * DAY)


def _conn(df: DataFrame, seed: int, stream: str, *key) -> DataFrame:
    return df.select(
        F.col("at").alias("timestamp"), "src_ip", "dst_ip", (49152 + F.floor(_u(seed, stream + "sp", *key) * 16000)).cast("int").alias("src_p"), F.col("dst_port").alias("dst_p"),
        (1 + F.floor(_u(seed, stream + "p1", *key) * 20)).cast("int").alias("src_pkts"), (1 + F.floor(_u(seed, stream + "p2", *key) * 20)).cast("int").alias("resp_pkts"), F.floor(F.col("size") * 0.3).cast("bigint").alias("src_bytes"),
        F.col("size").cast("bigint").alias("resp_bytes"), F.col("took").alias("duration"), F.col("state").alias("conn_state"), "service", F.lit("tcp").alias("proto"), "scenario",
    )


def generate(spark: SparkSession, days: int = 30, bg_rows_per_day: int = 30_000, noisy_rows_per_day: int = 1000, start: float = 1_759_276_800.0, seed: int = 42, scenarios=SCENARIOS) -> dict[str, DataFrame]:
    """conn, dns, http, ssl and labels."""
    fired = firings(spark, scenarios, start, days, seed).withColumn("scenario", F.col("name"))
    k = ("name", "i")
    beat = fired.withColumns({"size": F.greatest(F.lit(1.0), F.col("payload") * (1 + F.col("payload_cv") * _normal(seed, "size", *k))), "took": 0.05 + 0.4 * _u(seed, "took", *k), "state": F.lit("SF")})
    n, noisy = days * bg_rows_per_day, days * noisy_rows_per_day
    when = lambda s: F.lit(start) + _u(seed, s, "id") * days * DAY
    host = lambda s: F.concat(F.lit("10.0."), (1 + F.floor(_u(seed, s + "a", "id") * 3)).cast("int"), F.lit("."), (1 + F.floor(_u(seed, s + "b", "id") * 250)).cast("int"))
    far = lambda s: F.concat(F.lit("93.184."), F.floor(_u(seed, s + "c", "id") * 20).cast("int"), F.lit("."), (1 + F.floor(_u(seed, s + "d", "id") * 250)).cast("int"))
    usual = spark.range(n).select("id", when("bgt").alias("at"), host("bg").alias("src_ip"), far("bg").alias("dst_ip"), _pick(_u(seed, "bgs", "id"), ["ssl", "ssl", "http", "dns", "ssh"]).alias("service"), _pick(_u(seed, "bgc", "id"), ["SF"] * 8 + ["S0", "REJ"]).alias("state"), F.exp(7 + 1.5 * _normal(seed, "bgb", "id")).alias("size"), F.exp(-1 + _normal(seed, "bgd", "id")).alias("took"), F.lit(None).cast("string").alias("scenario"))
    usual = usual.withColumn("dst_port", F.when(F.col("service") == "ssl", 443).when(F.col("service") == "http", 80).when(F.col("service") == "dns", 53).otherwise(22))
    loud = spark.range(noisy).select("id", when("nzt").alias("at"), _pick(_u(seed, "nzs", "id"), ["10.0.9.1", "10.0.9.2", "10.0.9.3"]).alias("src_ip"), F.concat(F.lit("10.0.0."), (1 + F.floor(_u(seed, "nzd", "id") * 20)).cast("int")).alias("dst_ip"), F.lit("smb").alias("service"), F.lit("SF").alias("state"), F.exp(6 + _normal(seed, "nzb", "id")).alias("size"), F.lit(0.1).alias("took"), F.lit(None).cast("string").alias("scenario"), F.lit(445).alias("dst_port"))
    conn = _conn(beat, seed, "b", *k).unionByName(_conn(usual, seed, "u", "id")).unionByName(_conn(loud, seed, "n", "id"))
    before = lambda s: F.col("at") - (0.01 + 0.49 * _u(seed, s, *k))
    dns = beat.where("service <> 'ntp' OR domain IS NOT NULL").select(before("q").alias("ts"), "src_ip", F.coalesce("domain", generated_name(seed, "name", F.floor(F.col("i") / 50))).alias("query"), F.when(F.col("domain").isNull() & (_u(seed, "nx", *k) < 0.2), "NXDOMAIN").otherwise("NOERROR").alias("rcode"), F.col("dst_ip").alias("answers"), F.when(F.col("malicious"), "60").otherwise("3600").alias("ttls"))
    names = spark.range(n // 5).select(when("dnt").alias("ts"), host("dn").alias("src_ip"), F.concat(F.lit("site"), F.floor(_u(seed, "dnq", "id") * 500).cast("int"), F.lit(".example.org")).alias("query"), F.lit("NOERROR").alias("rcode"), F.concat(F.lit("1.2.3."), F.floor(_u(seed, "dna", "id") * 250).cast("int")).alias("answers"), F.lit("3600").alias("ttls"))
    calls = beat.where("service = 'http'").select(F.col("at").alias("ts"), "src_ip", "dst_ip", F.concat(F.lit("/gate?id="), F.substring(F.sha2(F.concat_ws("/", "name", "i"), 256), 1, 24)).alias("uri"), "user_agent", F.lit("POST").alias("method"), F.lit(200).alias("status_code"), F.lit(64).cast("bigint").alias("request_body_len"), F.col("size").cast("bigint").alias("response_body_len"))
    agents = [f"Browser/{i}.0" for i in range(8)]
    pages = spark.range(n // 3).select(when("htt").alias("ts"), host("ht").alias("src_ip"), far("ht").alias("dst_ip"), F.concat(F.lit("/page/"), F.floor(F.exp(9 * _u(seed, "htu", "id"))).cast("int")).alias("uri"), _pick(_u(seed, "hta", "id"), agents).alias("user_agent"), _pick(_u(seed, "htm", "id"), ["GET", "GET", "GET", "POST"]).alias("method"), F.lit(200).alias("status_code"), F.lit(0).cast("bigint").alias("request_body_len"), F.exp(8 + 1.5 * _normal(seed, "htb", "id")).cast("bigint").alias("response_body_len"))
    hand = beat.where("service = 'ssl'").select(F.col("at").alias("ts"), "src_ip", "dst_ip", F.col("domain").alias("server_name"), "ja3", F.lit("ok").alias("ja3s"), F.concat(F.lit("F"), "name").alias("cert_chain_fuids"), F.when(F.col("malicious"), "self signed certificate").otherwise("ok").alias("validation_status"), (_u(seed, "res", *k) < F.when(F.col("malicious"), 0.9).otherwise(0.3)).alias("resumed"), F.lit(True).alias("established"))
    shakes = spark.range(n // 4).select(when("slt").alias("ts"), host("sl").alias("src_ip"), far("sl").alias("dst_ip"), F.concat(F.lit("www"), F.floor(_u(seed, "sln", "id") * 300).cast("int"), F.lit(".example.org")).alias("server_name"), F.md5(F.floor(_u(seed, "slj", "id") * 12).cast("string")).alias("ja3"), F.lit("ok").alias("ja3s"), F.concat(F.lit("C"), F.floor(_u(seed, "slc", "id") * 5000).cast("int")).alias("cert_chain_fuids"), F.lit("ok").alias("validation_status"), (_u(seed, "slr", "id") < 0.3).alias("resumed"), F.lit(True).alias("established"))
    labels = fired.groupBy("scenario", "src_ip", "dst_ip", "period_s", F.col("jitter").alias("jitter_pct"), "malicious").agg(F.count("*").alias("n_firings"))
    return {"conn": conn, "dns": dns.unionByName(names), "http": calls.unionByName(pages), "ssl": hand.unionByName(shakes), "labels": labels}


def matches_truth(detected: DataFrame, labels: DataFrame) -> DataFrame:
    """(pair_id, scenario, malicious): detected pairs that share a source or a destination with a scenario; two equi-joins instead of a loop over an OR."""
    right = labels.select("scenario", "malicious", F.col("src_ip").alias("_s"), F.col("dst_ip").alias("_d"))
    by_src = detected.join(right, F.col("src_ip") == F.col("_s"))
    by_dst = detected.join(right, F.col("dst_ip") == F.col("_d"))
    return by_src.unionByName(by_dst).select("pair_id", "scenario", "malicious").distinct()


def evaluate(detected: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: true and false positives, misses, precision, recall, F1."""
    met = matches_truth(detected, labels)
    good = met.where("malicious").agg(F.count_distinct("scenario").alias("tp"))
    hit = met.where("malicious").select("pair_id").distinct()
    false = detected.select("pair_id").distinct().join(hit, "pair_id", "left_anti").agg(F.count("*").alias("fp"))
    all_ = labels.where("malicious").agg(F.count_distinct("scenario").alias("_n"))
    out = good.join(F.broadcast(false)).join(F.broadcast(all_)).withColumn("fn", F.col("_n") - F.col("tp"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    r = F.when(F.col("_n") > 0, F.col("tp") / F.col("_n")).otherwise(F.lit(0.0))
    return out.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))).drop("_n")
