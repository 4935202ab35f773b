"""Queries of corroborating evidence, annotation, leads and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import expr as X
from tidewatch.operators import corroborate as C
from tidewatch.operators import triage
from tidewatch.plans.flow_queries import QUERIES, SQL, query
from tidewatch.plans.standins import EVENTS, events, table
from tidewatch.report import hypothesis_pass_rates as pass_rates
from tidewatch.sources import synth

__all__ = ["QUERIES", "SQL"]
_LETTERS = "bcdfghjklmnpqrstvwxz23456789bcdf"

# stand-ins


def dns(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    name = (
        F.when(e % 40 < 10, F.concat(F.lit("host"), e % 3, F.lit(".example.org")))
        .when(u % 4 == 0, F.concat(F.substring(F.lit(_LETTERS), (u % 17 + 1).cast("int"), F.lit(12)), F.lit(".com")))
        .when(u % 4 == 1, F.lit("www.Google.com."))
        .otherwise(F.concat(F.lit("host"), e % 3, F.lit(".example.org")))
    )
    return events(spark, d).select(
        "event_id", F.when(e % 40 < 20, 1704067200.0 + e * 250.0).otherwise(F.col("timestamp")).alias("ts"), F.concat(F.lit("10.0.0."), e % 40).alias("src_ip"), name.alias("query"), F.concat(F.lit("[1.2.3."), e % 9, F.lit(", 8.8.8.8]")).alias("answers"),
        F.when(e % 4 == 0, "60").when(e % 4 == 1, "3600").when(e % 4 == 2, "[30, 600]").otherwise("[20,bad]").alias("ttls"), F.when(e % 10 == 0, "NXDOMAIN").otherwise("NOERROR").alias("rcode"),
    )


_DNS = f"""{EVENTS}, dns AS (SELECT event_id, CASE WHEN event_id % 40 < 20 THEN 1704067200.0::DOUBLE + event_id * 250.0::DOUBLE ELSE timestamp END AS ts, concat('10.0.0.', event_id % 40) AS src_ip,
  CASE WHEN event_id % 40 < 10 THEN concat('host', event_id % 3, '.example.org') WHEN user_id % 4 = 0 THEN concat(substr('{_LETTERS}', CAST(user_id % 17 + 1 AS INT), 12), '.com') WHEN user_id % 4 = 1 THEN 'www.Google.com.' ELSE concat('host', event_id % 3, '.example.org') END AS query,
  concat('[1.2.3.', event_id % 9, ', 8.8.8.8]') AS answers, event_id % 4 IN (0, 2) AS short, event_id % 10 = 0 AS nx, event_id % 40 >= 10 AND user_id % 4 = 1 AS benign,
  event_id % 40 >= 10 AND user_id % 4 = 0 AS coined FROM ev)"""


def candidates(spark, d):
    e = F.col("event_id")
    return events(spark, d).where(e < 40).select(F.concat(F.lit("10.0.0."), e % 40).alias("src_ip"), F.concat(F.lit("1.2.3."), e % 9).alias("dst_ip"), F.when(e % 3 == 0, 30000.0).when(e % 3 == 1, 10000.0).otherwise(32000.0).alias("dominant_period_s"))


_CAND = "cand AS (SELECT concat('10.0.0.', event_id % 40) AS src_ip, concat('1.2.3.', event_id % 9) AS dst_ip, CASE WHEN event_id % 3 = 0 THEN 30000.0::DOUBLE WHEN event_id % 3 = 1 THEN 10000.0 ELSE 32000.0 END AS p FROM ev WHERE event_id < 40)"


def every_candidate(spark, d):
    """One candidate for each pair of the whole table; ``candidates`` and its SQL hold the first 40 events only."""
    e = F.col("event_id")
    return events(spark, d).select(F.concat(F.lit("10.0.0."), e % 40).alias("src_ip"), F.concat(F.lit("1.2.3."), e % 9).alias("dst_ip"), F.when(e % 3 == 0, 30000.0).when(e % 3 == 1, 10000.0).otherwise(32000.0).alias("dominant_period_s")).distinct()


def http(spark, d):
    i = F.col("page_id")
    return table(spark, d, "pages").select(
        "page_id", F.concat(F.lit("10.0.0."), i % 5).alias("src_ip"), F.concat(F.lit("h"), i % 4).alias("dst_ip"), F.regexp_extract("url", "^https?://[^/]*(.*)$", 1).alias("uri"),
        F.when(i % 6 < 4, F.lit("agent-a")).when(i % 6 == 5, F.concat(F.lit("agent-"), i % 50)).when(i % 24 == 4, F.lit("Googlebot/2.1")).alias("user_agent"), F.when(i % 9 == 0, "put").otherwise("GET").alias("method"), F.length("html").alias("response_body_len"),
    )


_HTTP = "http AS (SELECT page_id, concat('10.0.0.', page_id % 5) AS src_ip, concat('h', page_id % 4) AS dst_ip, regexp_extract(url, '^https?://[^/]*(.*)$', 1) AS uri, CASE WHEN page_id % 6 < 4 THEN 'agent-a' WHEN page_id % 6 = 5 THEN concat('agent-', page_id % 50) WHEN page_id % 24 = 4 THEN 'Googlebot/2.1' END AS ua, CASE WHEN page_id % 9 = 0 THEN 'PUT' ELSE 'GET' END AS method, length(html) AS body FROM pages), hx AS (SELECT * FROM http WHERE ua IS DISTINCT FROM 'Googlebot/2.1')"


def web_pairs(spark, d):
    return http(spark, d).select("src_ip", "dst_ip").distinct()


def ssl(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("10.0.0."), i % 6).alias("src_ip"), F.concat(F.lit("t"), i % 7).alias("dst_ip"), F.when(i % 6 == 0, F.lit("one.example")).when(i % 6 < 4, F.concat(F.lit("n"), i % 5, F.lit(".example"))).when(i % 6 == 4, F.lit("-")).alias("server_name"),
        F.when((i % 7 < 4) | (i % 20 == 0), F.md5(F.lit("a"))).otherwise(F.md5((i % 3).cast("string"))).alias("ja3"), F.when(i % 7 != 6, F.concat(F.lit("C"), i % 7)).otherwise(F.lit("")).alias("cert_chain_fuids"),
        F.when((i % 42 == 5), "Self signed certificate").otherwise("ok").alias("validation_status"), (i % 6 == 3).alias("resumed"),
    )


_SSL = "ssl AS (SELECT doc_id, concat('10.0.0.', doc_id % 6) AS src_ip, concat('t', doc_id % 7) AS dst_ip, CASE WHEN doc_id % 6 = 0 THEN 'one.example' WHEN doc_id % 6 < 4 THEN concat('n', doc_id % 5, '.example') END AS sni, CASE WHEN doc_id % 7 < 4 OR doc_id % 20 = 0 THEN md5('a') ELSE md5(CAST(doc_id % 3 AS VARCHAR)) END AS ja3, CASE WHEN doc_id % 7 <> 6 THEN concat('C', doc_id % 7) END AS cert, doc_id % 42 = 5 AS bad, doc_id % 6 = 3 AS resumed FROM documents)"

_ENT = "coalesce(list_sum([-(len(list_filter(string_split(lower({s}), ''), lambda y: y = ch)) / CAST(len({s}) AS DOUBLE)) * log2(len(list_filter(string_split(lower({s}), ''), lambda y: y = ch)) / CAST(len({s}) AS DOUBLE)) FOR ch IN list_distinct(string_split(lower({s}), ''))]), 0)"

# string operators


@query(f"SELECT p_partkey, round({_ENT.format(s='p_name')}, 6) AS entropy FROM part")
def string_entropy(spark, d):
    return table(spark, d, "part").select("p_partkey", X.string_entropy("p_name").alias("entropy"))


@query(f"WITH {_DNS} SELECT event_id, benign FROM dns")
def benign_domain(spark, d):
    return dns(spark, d).select("event_id", X.benign_domain("query").alias("benign"))


@query(f"WITH {_HTTP} SELECT page_id, coalesce(ua = 'Googlebot/2.1', false) AS benign FROM http")
def benign_ua(spark, d):
    return http(spark, d).select("page_id", X.benign_agent("user_agent").alias("benign"))


_DGA = "coined AND len(l) >= 8 AND e >= 3.5 AND (NOT regexp_matches(l, '[aeiou]') OR regexp_matches(l, '[^aeiou]{6,}'))"


@query(f"WITH {_DNS}, lb AS (SELECT event_id, coined, split_part(query, '.', 1) AS l FROM dns), le AS (SELECT *, {_ENT.format(s='l')} AS e FROM lb) SELECT event_id, {_DGA} AS dga FROM le")
def dga_detect(spark, d):
    return dns(spark, d).select("event_id", X.looks_generated("query").alias("dga"))


@query(f"WITH {_DNS} SELECT event_id, concat('1.2.3.', event_id % 9, '|8.8.8.8') AS ips FROM dns")
def parse_answers(spark, d):
    return dns(spark, d).select("event_id", F.array_join(X.answer_ips("answers"), "|").alias("ips"))


@query(f"WITH {_DNS} SELECT event_id, short FROM dns")
def short_ttl(spark, d):
    return dns(spark, d).select("event_id", X.short_ttl("ttls").alias("short"))


# DNS


@query(f"WITH {_DNS}, {_CAND}, w AS (SELECT max(ts) - min(ts) AS s FROM dns) SELECT src_ip, CAST(greatest(3, floor(s / p * 0.5)) AS BIGINT) AS n FROM cand, w")
def dns_min_obs(spark, d):
    return candidates(spark, d).join(F.broadcast(C.dns_window(dns(spark, d)))).select("src_ip", C.min_observations(F.col("window_s"), F.col("dominant_period_s")).alias("n"))


_REG = f"""{_DNS}, {_CAND}, gq AS (SELECT *, ts - lag(ts) OVER (PARTITION BY src_ip, query ORDER BY ts) AS iat FROM dns WHERE NOT benign),
rg AS (SELECT src_ip, query, count(*) AS n, count(iat) AS n_iat, quantile_cont(iat, 0.5) AS med, stddev_pop(iat) / (quantile_cont(iat, 0.5) + 1e-9) AS cv, list(DISTINCT event_id % 9) AS own FROM gq GROUP BY ALL)"""
_H1 = f"""{_REG}, wn AS (SELECT max(ts) - min(ts) AS s FROM dns), m0 AS (SELECT cand.src_ip, dst_ip, query, abs(med - p) / (p + 1e-9) AS dl, list_contains(own, CAST(split_part(dst_ip, '.', 4) AS BIGINT)) AS here FROM cand JOIN rg USING (src_ip), wn
  WHERE n >= greatest(3, floor(s / p * 0.5)) AND n_iat >= 2 AND cv <= 0.6 AND abs(med - p) / (p + 1e-9) <= 0.15),
h1 AS (SELECT src_ip, dst_ip, query, CASE WHEN here THEN dl ELSE least(dl + 0.05, 1.0) END AS delta FROM m0)"""


@query(f"WITH {_REG} SELECT src_ip, query, n, n_iat, round(med, 6) AS median_iat, round(cv, 6) AS cv FROM rg")
def dns_regularity(spark, d):
    return C.dns_regularity(dns(spark, d)).drop("answer_set")


@query(f"WITH {_H1} SELECT src_ip, dst_ip, query, round(delta, 6) AS delta, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY delta, query) AS rank FROM h1")
def h1_dns_regularity(spark, d):
    q = dns(spark, d)
    return C.h1_matches(candidates(spark, d), C.dns_regularity(q), C.dns_window(q, 0.0))


@query(f"WITH {_H1} SELECT src_ip, dst_ip, arg_min(query, [round(delta, 9)::VARCHAR, query]) AS best, round(min(delta), 6) AS delta FROM h1 GROUP BY ALL")
def h1_best_domain(spark, d):
    return h1_dns_regularity(spark, d).where("rank = 1").select("src_ip", "dst_ip", F.col("query").alias("best"), "delta")


_SIG = f"""{_H1}, nm AS (SELECT src_ip, query, bool_or(coined) AS coined, count(*) FILTER (nx) AS nx, count(*) FILTER (short) AS short, count(DISTINCT event_id % 9) + 1 AS ips FROM dns WHERE NOT benign GROUP BY ALL),
ne AS (SELECT *, split_part(query, '.', 1) AS l FROM nm), nd AS (SELECT *, {_ENT.format(s='l')} AS e FROM ne),
al AS (SELECT src_ip, count(*) AS a FROM dns GROUP BY 1),
sg AS (SELECT src_ip, sum(nx) AS nx, sum(short) AS short, coalesce(list(query ORDER BY query) FILTER ({_DGA}), []) AS dga, coalesce(list(query ORDER BY query) FILTER (ips >= 5), []) AS flux FROM nd GROUP BY 1),
ss AS (SELECT al.src_ip, coalesce(nx, 0) AS nx, coalesce(nx, 0) / CAST(a AS DOUBLE) AS nx_rate, coalesce(short, 0) AS short, coalesce(dga, []) AS dga, coalesce(flux, []) AS flux FROM al LEFT JOIN sg USING (src_ip))"""


@query(f"WITH {_SIG} SELECT src_ip, CAST(nx AS BIGINT) AS nx, round(nx_rate, 6) AS nx_rate FROM ss")
def nxdomain_rate(spark, d):
    return C.dns_signals(dns(spark, d)).select("src_ip", "nx", "nx_rate")


@query(f"WITH {_SIG} SELECT src_ip, array_to_string(flux, '|') AS flux, CAST(short AS BIGINT) AS short FROM ss")
def fast_flux(spark, d):
    return C.dns_signals(dns(spark, d)).select("src_ip", F.array_join("flux", "|").alias("flux"), "short")


@query(
    f"WITH {_SIG}, mm AS (SELECT src_ip, dst_ip, list(query) AS matched FROM h1 GROUP BY ALL), sc AS (SELECT DISTINCT cand.src_ip, cand.dst_ip, matched, nx, short, dga, flux FROM cand LEFT JOIN mm ON mm.src_ip = cand.src_ip AND mm.dst_ip = cand.dst_ip LEFT JOIN ss ON ss.src_ip = cand.src_ip)"
    " SELECT src_ip, dst_ip, matched IS NOT NULL AS h1, (len(dga) > 0 OR nx > 0 OR short > 0 OR len(flux) > 0) AS h2, round(least(1, 0.35 * CAST(matched IS NOT NULL AS INT) + 0.40 * CAST(len(dga) > 0 OR nx > 0 OR short > 0 OR len(flux) > 0 AS INT) + 0.15 * CAST(len(dga) > 0 AS INT) + 0.10 * CAST(nx > 0 AS INT) + 0.10 * CAST(coalesce(list_has_any(matched, list_concat(dga, flux)), false) AS INT)), 4)::DOUBLE AS dns_score FROM sc"
)
def dns_score(spark, d):
    return C.score_dns(candidates(spark, d), dns(spark, d)).select("src_ip", "dst_ip", F.col("h1_dns_regularity").alias("h1"), F.col("h2_dns_anomaly").alias("h2"), "dns_score")


# HTTP


@query(f"WITH {_HTTP} SELECT ua AS user_agent, round(count(*) / (SELECT CAST(count(ua) AS DOUBLE) FROM http), 6) AS freq FROM http WHERE ua IS NOT NULL GROUP BY 1")
def global_ua_freq(spark, d):
    return C.global_agents(http(spark, d))


_WEB = f"""{_HTTP}, qb AS (SELECT src_ip, dst_ip, quantile_cont(body, 0.05) AS lo, quantile_cont(body, 0.95) AS hi, count(*) AS n, avg(body) AS m FROM hx GROUP BY ALL),
tb AS (SELECT hx.src_ip, hx.dst_ip, CASE WHEN count(*) > 1 AND avg(body) > 0 THEN stddev_samp(body) / avg(body) END AS bcv FROM hx JOIN qb ON hx.src_ip = qb.src_ip AND hx.dst_ip = qb.dst_ip WHERE n > 1 AND m > 0 AND body BETWEEN lo AND hi GROUP BY ALL),
ug AS (SELECT ua, count(*) / (SELECT CAST(count(ua) AS DOUBLE) FROM http) AS freq FROM http WHERE ua IS NOT NULL GROUP BY 1),
uc AS (SELECT src_ip, dst_ip, coalesce(ua, '') AS ua, count(*) AS c FROM hx GROUP BY ALL), ut AS (SELECT src_ip, dst_ip, max(c) / CAST(sum(c) AS DOUBLE) AS share, (list(ua ORDER BY c DESC, ua))[1] AS top FROM uc GROUP BY ALL),
he AS (SELECT *, CASE WHEN len(uri) > 0 THEN {_ENT.format(s='uri')} ELSE 0 END AS e, len(split_part(uri, '?', 1)) AS pl FROM hx),
wa AS (SELECT src_ip, dst_ip, count(*) AS flows, CASE WHEN count(*) > 1 AND avg(len(uri)) > 0 THEN stddev_samp(len(uri)) / avg(len(uri)) END AS ucv, CASE WHEN count(*) > 1 AND avg(pl) > 0 THEN stddev_samp(pl) / avg(pl) END AS pcv, avg(CASE WHEN e > 4.0 THEN 1.0 ELSE 0.0 END) AS rich, list_sort(list_filter(list(DISTINCT method), lambda x: x <> 'GET')) AS odd FROM he GROUP BY ALL),
wb AS (SELECT wa.*, bcv, share, top, freq, (CASE WHEN bcv IS NOT NULL THEN 0.4 * CAST(bcv < 0.3 AS INT) ELSE 0 END + CASE WHEN ucv IS NOT NULL THEN 0.3 * CAST(ucv < 0.4 AS INT) ELSE 0 END + CASE WHEN pcv IS NOT NULL THEN 0.3 * CAST(pcv < 0.4 AS INT) ELSE 0 END) / nullif(CASE WHEN bcv IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN ucv IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN pcv IS NOT NULL THEN 0.3 ELSE 0 END, 0) AS h3
  FROM wa LEFT JOIN tb ON tb.src_ip = wa.src_ip AND tb.dst_ip = wa.dst_ip JOIN ut ON ut.src_ip = wa.src_ip AND ut.dst_ip = wa.dst_ip LEFT JOIN ug ON ug.ua = ut.top),
wc AS (SELECT *, share >= 0.95 AS mono, CASE WHEN top <> '' THEN coalesce(freq, 0) < 0.01 ELSE share < 0.05 END AS rare, rich >= 0.25 AS ent, len(odd) > 0 AS abn FROM wb)"""


@query(f"WITH {_WEB} SELECT src_ip, dst_ip, round(bcv, 6) AS cv FROM tb")
def trimmed_cv(spark, d):
    h = http(spark, d)
    return C.trimmed_cv(h.where(~X.benign_agent("user_agent")).withColumn("b", F.col("response_body_len").cast("double")), ["src_ip", "dst_ip"], "b")


def _web(spark, d):
    return C.score_http(web_pairs(spark, d), http(spark, d))


@query(f"WITH {_WEB} SELECT src_ip, dst_ip, round(ucv, 4) AS h3_uri_len_cv, round(pcv, 4) AS h3_path_cv FROM wc")
def uri_path_cv(spark, d):
    return _web(spark, d).select("src_ip", "dst_ip", "h3_uri_len_cv", "h3_path_cv")


@query(f"WITH {_WEB} SELECT src_ip, dst_ip, round(CAST(coalesce(h3, 0) AS DOUBLE), 4) AS h3_score, coalesce(h3, 0) >= 0.5 AS h3_http_consistency FROM wc")
def h3_consistency(spark, d):
    return _web(spark, d).select("src_ip", "dst_ip", "h3_score", "h3_http_consistency")


@query(f"WITH {_WEB} SELECT src_ip, dst_ip, mono AS h4_ua_monotony FROM wc")
def ua_monotony(spark, d):
    return _web(spark, d).select("src_ip", "dst_ip", "h4_ua_monotony")


@query(f"WITH {_WEB} SELECT src_ip, dst_ip, rare AS h4_rare_ua FROM wc")
def rare_ua(spark, d):
    return _web(spark, d).select("src_ip", "dst_ip", "h4_rare_ua")


@query(f"WITH {_WEB} SELECT src_ip, dst_ip, ent AS h4_high_uri_entropy FROM wc")
def high_entropy_uri(spark, d):
    return _web(spark, d).select("src_ip", "dst_ip", "h4_high_uri_entropy")


@query(f"WITH {_WEB} SELECT src_ip, dst_ip, array_to_string(odd, ',') AS methods FROM wc")
def abnormal_methods(spark, d):
    return _web(spark, d).select("src_ip", "dst_ip", F.array_join("h4_abnormal_methods", ",").alias("methods"))


@query(f"WITH {_WEB} SELECT src_ip, dst_ip, flows AS http_flows, (mono OR rare OR ent OR abn) AS h4, round(0.30 * CAST(coalesce(h3, 0) >= 0.5 AS INT) + 0.25 * CAST(rare AS INT) + 0.15 * CAST(mono AS INT) + 0.20 * CAST(ent AS INT) + 0.10 * CAST(abn AS INT), 4)::DOUBLE AS http_score FROM wc")
def http_score(spark, d):
    return _web(spark, d).select("src_ip", "dst_ip", "http_flows", F.col("h4_evasion_indicators").alias("h4"), "http_score")


# TLS

_TLS = f"""{_SSL}, tj AS (SELECT src_ip, dst_ip, ja3, count(*) AS c FROM ssl GROUP BY ALL), tk AS (SELECT src_ip, dst_ip, max(c) / CAST(sum(c) AS DOUBLE) >= 0.9 AS ja3 FROM tj GROUP BY ALL),
tc AS (SELECT src_ip, dst_ip, cert, count(*) AS c FROM ssl WHERE cert IS NOT NULL GROUP BY ALL), td AS (SELECT src_ip, dst_ip, max(c) >= 3 AS cert FROM tc GROUP BY ALL),
ta AS (SELECT src_ip, dst_ip, count(*) AS flows, count(DISTINCT sni) = 1 AS sni, count(sni) = 0 AS absent, bool_or(bad) AS bad, avg(CASE WHEN resumed THEN 1.0 ELSE 0.0 END) > 0.8 AS res FROM ssl GROUP BY ALL),
te AS (SELECT ta.*, coalesce(tk.ja3, false) AS ja3, coalesce(td.cert, false) AS cert FROM ta LEFT JOIN tk ON ta.src_ip = tk.src_ip AND ta.dst_ip = tk.dst_ip LEFT JOIN td ON ta.src_ip = td.src_ip AND ta.dst_ip = td.dst_ip)"""


def _tls(spark, d):
    s = ssl(spark, d)
    return C.score_tls(s.select("src_ip", "dst_ip").distinct(), s)


for _name, _mine, _theirs in (("sni_stable", "h5_sni_stable", "sni"), ("ja3_monotony", "h5_ja3_monotonic", "ja3"), ("cert_reuse", "h5_cert_reuse", "cert"), ("self_signed", "h6_self_signed", "bad"), ("absent_sni", "h6_absent_sni", "absent"), ("high_resumption", "h6_high_resumption", "res")):

    def _one(spark, d, c=_mine):
        return _tls(spark, d).select("src_ip", "dst_ip", c)

    _one.__name__ = _name
    query(f"WITH {_TLS} SELECT src_ip, dst_ip, {_theirs} AS {_mine} FROM te")(_one)


@query(f"WITH {_TLS} SELECT src_ip, dst_ip, CAST(sni AS INT) + CAST(ja3 AS INT) + CAST(cert AS INT) >= 2 AS h5_tls_consistency FROM te")
def h5(spark, d):
    return _tls(spark, d).select("src_ip", "dst_ip", "h5_tls_consistency")


@query(f"WITH {_TLS} SELECT src_ip, dst_ip, flows AS ssl_flows, (bad OR absent OR res) AS h6_tls_anomaly, round(0.3 * (0.4 * CAST(sni AS INT) + 0.4 * CAST(ja3 AS INT) + 0.2 * CAST(cert AS INT)) + 0.3 * (0.3 * CAST(bad AS INT) + 0.25 * CAST(absent AS INT) + 0.2 * CAST(res AS INT)), 4)::DOUBLE AS tls_score FROM te")
def tls_score(spark, d):
    return _tls(spark, d).select("src_ip", "dst_ip", "ssl_flows", "h6_tls_anomaly", "tls_score")


# scores and leads


def scored(spark, d):
    """One made-up candidate for each order."""
    k = F.col("o_orderkey")
    bit = lambda n: F.floor(k / n) % 2 == 1
    flags = ("h1_dns_regularity", "h2_dns_anomaly", "h3_http_consistency", "h4_evasion_indicators", "h5_tls_consistency", "h6_tls_anomaly")
    t = table(spark, d, "orders").select(
        k.alias("k"), F.concat(F.lit("10.0.0."), k % 200).alias("src_ip"), F.concat(F.lit("d"), k).alias("dst_ip"), *[bit(2**i).alias(c) for i, c in enumerate(flags)], (k % 11 / 10).alias("dns_score"), (k % 7 / 6).alias("http_score"), (k % 5 / 8).alias("tls_score"),
        (k % 3 - 1).alias("http_flows"), (k % 4 - 1).alias("ssl_flows"), ((k % 101) / 100).alias("beacon_confidence"), F.when(k % 9 == 0, 0.0).otherwise(k % 5000 * 1.0).alias("dominant_period_s"), (k % 1000).alias("flow_count"),
        F.when(k % 6 == 0, F.array(F.lit("a1.com"), F.lit("b2.com"))).otherwise(F.array().cast("array<string>")).alias("h2_dga_domains"), (k % 8).alias("h2_nxdomain_count"), (k % 3).alias("h2_short_ttl_count"), bit(64).alias("h4_rare_ua"), bit(128).alias("h4_high_uri_entropy"),
        F.when(k % 10 == 0, F.array(F.lit("PUT"))).otherwise(F.array().cast("array<string>")).alias("h4_abnormal_methods"), (k % 13 == 0).alias("has_interval_shift"),
    )
    score = C.corroboration_score(F.col("dns_score"), F.col("http_score"), F.col("tls_score"), [F.col(c) for c in flags], F.col("http_flows"), F.col("ssl_flows"))
    return t.withColumn("corroboration_score", score).withColumn("corroborated", F.col("corroboration_score") >= 0.55)


_SC = """s0 AS (SELECT o_orderkey AS k, concat('10.0.0.', o_orderkey % 200) AS src_ip, concat('d', o_orderkey) AS dst_ip, o_orderkey // 1 % 2 AS h1, o_orderkey // 2 % 2 AS h2, o_orderkey // 4 % 2 AS h3, o_orderkey // 8 % 2 AS h4, o_orderkey // 16 % 2 AS h5, o_orderkey // 32 % 2 AS h6,
  (o_orderkey % 11) / 10.0::DOUBLE AS d, (o_orderkey % 7) / 6.0::DOUBLE AS h, (o_orderkey % 5) / 8.0::DOUBLE AS t, o_orderkey % 3 - 1 AS hf, o_orderkey % 4 - 1 AS sf, (o_orderkey % 101) / 100.0::DOUBLE AS conf, CASE WHEN o_orderkey % 9 = 0 THEN 0.0 ELSE CAST(o_orderkey % 5000 AS DOUBLE) END AS period FROM orders),
s1 AS (SELECT *, round(CASE WHEN hf > 0 AND sf > 0 THEN 0.30 * d + 0.30 * h + 0.20 * t + 0.20 * (0.20 * h1 + 0.25 * h2 + 0.15 * h3 + 0.15 * h4 + 0.13 * h5 + 0.12 * h6) WHEN hf > 0 THEN 0.60 * (0.25 * h1 + 0.35 * h2 + 0.20 * h3 + 0.20 * h4) + 0.20 * d + 0.20 * h
  WHEN sf > 0 THEN 0.40 * d + 0.40 * t + 0.20 * (0.25 * h1 + 0.35 * h2 + 0.20 * h5 + 0.20 * h6) ELSE 0.55 * (0.35 * h1 + 0.65 * h2) + 0.45 * d END, 3) AS score FROM s0)"""


@query(f"WITH {_SC} SELECT k, round(score, 3) AS score FROM s1")
def corroboration_score(spark, d):
    return scored(spark, d).select("k", F.round("corroboration_score", 3).alias("score")).where("k IS NOT NULL")


_YES = f"""{_SC}, s2 AS (SELECT *, round(CASE WHEN hf > 0 AND sf > 0 THEN 0.30 * d + 0.30 * h + 0.20 * t + 0.20 * (0.20 * h1 + 0.25 * h2 + 0.15 * h3 + 0.15 * h4 + 0.13 * h5 + 0.12 * h6) WHEN hf > 0 THEN 0.60 * (0.25 * h1 + 0.35 * h2 + 0.20 * h3 + 0.20 * h4) + 0.20 * d + 0.20 * h
  WHEN sf > 0 THEN 0.40 * d + 0.40 * t + 0.20 * (0.25 * h1 + 0.35 * h2 + 0.20 * h5 + 0.20 * h6) ELSE 0.55 * (0.35 * h1 + 0.65 * h2) + 0.45 * d END, 4) AS full_score FROM s1), yes AS (SELECT * FROM s2 WHERE full_score >= 0.55)"""
_RULES = (
    ("T1029", "period > 0"), ("T1071.004", "h1 = 1"), ("T1568.002", "k % 6 = 0"), ("T1568.001", "k % 3 > 0"), ("T1071.004", "k % 8 > 0 AND k % 6 <> 0"), ("T1071.001", "h3 = 1"), ("T1036", "k // 64 % 2 = 1"), ("T1132", "k // 128 % 2 = 1"), ("T1001", "k // 128 % 2 = 1"),
    ("T1071.001", "k % 10 = 0"), ("T1573", "h3 = 0 AND h4 = 0 AND conf >= 0.5"), ("T1571", "k % 13 = 0"), ("T1041", "k % 1000 > 500 AND period > 0"),
)
_TECH = _YES + ", te AS (" + " UNION ALL ".join(f"SELECT k, {i} AS pos, '{t}' AS technique_id, '{triage.TECHNIQUES[t][1]}' AS tactic FROM yes WHERE {w}" for i, (t, w) in enumerate(_RULES)) + ")"


@query(f"WITH {_TECH} SELECT k, technique_id, tactic, count(*) AS n FROM te GROUP BY ALL")
def attack_techniques(spark, d):
    rows = triage.annotate(scored(spark, d)).select("k", F.explode("mitre_techniques").alias("t"))
    return rows.groupBy("k", F.col("t.technique_id").alias("technique_id"), F.col("t.tactic").alias("tactic")).agg(F.count("*").alias("n"))


@query(f"WITH {_TECH} SELECT k, tactic, string_agg(DISTINCT technique_id, ',' ORDER BY technique_id) AS techniques FROM te GROUP BY ALL")
def techniques_by_tactic(spark, d):
    return triage.techniques_by_tactic(triage.annotate(scored(spark, d)), ["k"]).select("k", "tactic", F.array_join("techniques", ",").alias("techniques"))


@query(f"WITH {_YES} SELECT k, row_number() OVER (ORDER BY full_score DESC, src_ip, dst_ip) AS rank, CASE WHEN k % 13 = 0 OR (conf >= 0.8 AND full_score >= 0.7) THEN 'CRITICAL' WHEN conf >= 0.65 AND full_score >= 0.55 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM yes")
def triage_leads(spark, d):
    s = scored(spark, d).withColumns({"n_changepoints": F.lit(0), "beacon_start_dt": F.lit(None).cast("string")})
    return triage.triage_leads(s).select("k", "rank", "severity")


@query(f"WITH {_YES} SELECT k, CASE WHEN k % 5 = 0 THEN k % 4 END AS n_changepoints, CASE WHEN k % 5 = 0 THEN 'day' ELSE 'Unknown' END AS start FROM yes")
def lead_enrich(spark, d):
    s = scored(spark, d)
    changes = s.where("k % 5 = 0").select("src_ip", "dst_ip", (F.col("k") % 4).alias("n_changepoints"), F.lit("day").alias("beacon_start_dt"), F.lit(False).alias("has_interval_shift"))
    return triage.triage_leads(s, changes).select("k", "n_changepoints", "start")


@query(f"WITH {_YES} SELECT k, 3 + CAST(k % 13 = 0 AS BIGINT) + CAST(h2 = 1 AND k % 6 = 0 AS BIGINT) + CAST(h2 = 1 AND k % 8 > 0 AND k % 6 <> 0 AS BIGINT) + CAST(h2 = 1 AND k % 3 > 0 AND k % 6 <> 0 AS BIGINT) + h4 + CAST(h6 = 1 OR (h3 = 0 AND h4 = 0 AND h5 = 0) AS BIGINT) AS n_steps FROM yes")
def next_steps(spark, d):
    s = scored(spark, d).where("corroborated").withColumn("start", F.lit("Unknown"))
    return triage.next_steps(s).select("k", F.size("next_steps").cast("bigint").alias("n_steps"))


@query(f"WITH {_SC} " + " UNION ALL ".join(f"SELECT '{c}' AS hypothesis, CAST(sum(h{i + 1}) AS BIGINT) AS passed, count(*) AS total FROM s1" for i, c in enumerate(("h1_dns_regularity", "h2_dns_anomaly", "h3_http_consistency", "h4_evasion_indicators", "h5_tls_consistency", "h6_tls_anomaly"))))
def hypothesis_pass_rates(spark, d):
    return pass_rates(scored(spark, d))


@query(f"WITH {_SIG}, {_WEB.replace('http AS', 'http AS', 1)}, mm AS (SELECT src_ip, dst_ip, list(query) AS matched FROM h1 GROUP BY ALL) SELECT DISTINCT cand.src_ip, cand.dst_ip, matched IS NOT NULL AS h1, round(least(1, 0.35 * CAST(matched IS NOT NULL AS INT) + 0.40 * CAST(len(dga) > 0 OR nx > 0 OR short > 0 OR len(flux) > 0 AS INT) + 0.15 * CAST(len(dga) > 0 AS INT) + 0.10 * CAST(nx > 0 AS INT) + 0.10 * CAST(coalesce(list_has_any(matched, list_concat(dga, flux)), false) AS INT)), 4)::DOUBLE AS dns_score FROM cand LEFT JOIN mm ON mm.src_ip = cand.src_ip AND mm.dst_ip = cand.dst_ip LEFT JOIN ss ON ss.src_ip = cand.src_ip")
def corroborate(spark, d):
    return C.corroborate(candidates(spark, d), dns(spark, d), http(spark, d), ssl(spark, d)).select("src_ip", "dst_ip", F.col("h1_dns_regularity").alias("h1"), "dns_score")


# DNS and corroboration over every pair of the table


@query()
def dns_min_obs_all(spark, d):
    return every_candidate(spark, d).join(F.broadcast(C.dns_window(dns(spark, d)))).select("src_ip", C.min_observations(F.col("window_s"), F.col("dominant_period_s")).alias("n"))


@query()
def h1_dns_regularity_all(spark, d):
    q = dns(spark, d)
    return C.h1_matches(every_candidate(spark, d), C.dns_regularity(q), C.dns_window(q, 0.0))


@query()
def h1_best_domain_all(spark, d):
    return h1_dns_regularity_all(spark, d).where("rank = 1").select("src_ip", "dst_ip", F.col("query").alias("best"), "delta")


@query()
def dns_score_all(spark, d):
    return C.score_dns(every_candidate(spark, d), dns(spark, d)).select("src_ip", "dst_ip", F.col("h1_dns_regularity").alias("h1"), F.col("h2_dns_anomaly").alias("h2"), "dns_score")


@query()
def corroborate_all(spark, d):
    return C.corroborate(every_candidate(spark, d), dns(spark, d), http(spark, d), ssl(spark, d)).select("src_ip", "dst_ip", F.col("h1_dns_regularity").alias("h1"), "dns_score")


# evaluation and data


def _truth(spark, d):
    i = F.col("c_custkey")
    labels = table(spark, d, "customer").where(i < 30).select(F.concat(F.lit("s"), i).alias("scenario"), (i % 3 != 0).alias("malicious"), F.concat(F.lit("10.0.0."), i).alias("src_ip"), F.concat(F.lit("d"), i * 7).alias("dst_ip"))
    found = scored(spark, d).where("k < 300").select(F.concat("src_ip", F.lit("→"), "dst_ip").alias("pair_id"), "src_ip", "dst_ip")
    return found, labels


_TRUTH = "lb AS (SELECT concat('s', c_custkey) AS scenario, c_custkey % 3 <> 0 AS malicious, concat('10.0.0.', c_custkey) AS src_ip, concat('d', c_custkey * 7) AS dst_ip FROM customer WHERE c_custkey < 30), fo AS (SELECT concat('10.0.0.', o_orderkey % 200, '→', 'd', o_orderkey) AS pair_id, concat('10.0.0.', o_orderkey % 200) AS src_ip, concat('d', o_orderkey) AS dst_ip FROM orders WHERE o_orderkey < 300), mt AS (SELECT DISTINCT pair_id, scenario, malicious FROM fo JOIN lb ON fo.src_ip = lb.src_ip OR fo.dst_ip = lb.dst_ip)"


@query(f"WITH {_TRUTH} SELECT * FROM mt")
def eval_or_join(spark, d):
    return synth.matches_truth(*_truth(spark, d))


@query(f"WITH {_TRUTH}, c AS (SELECT (SELECT count(DISTINCT scenario) FROM mt WHERE malicious) AS tp, (SELECT count(DISTINCT pair_id) FROM fo WHERE pair_id NOT IN (SELECT pair_id FROM mt WHERE malicious)) AS fp, (SELECT count(DISTINCT scenario) FROM lb WHERE malicious) AS n), p AS (SELECT tp, fp, n - tp AS fn, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(n AS DOUBLE) AS recall FROM c) SELECT tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM p")
def eval_prf(spark, d):
    return synth.evaluate(*_truth(spark, d))


def _whole_truth(spark, d):
    """Labels of every customer, detections of every order; ``_truth`` and its SQL hold the least ids only."""
    i = F.col("c_custkey")
    labels = table(spark, d, "customer").select(F.concat(F.lit("s"), i).alias("scenario"), (i % 3 != 0).alias("malicious"), F.concat(F.lit("10.0.0."), i).alias("src_ip"), F.concat(F.lit("d"), i * 7).alias("dst_ip"))
    return scored(spark, d).select(F.concat("src_ip", F.lit("→"), "dst_ip").alias("pair_id"), "src_ip", "dst_ip"), labels


@query()
def eval_or_join_all(spark, d):
    return synth.matches_truth(*_whole_truth(spark, d))


@query()
def eval_prf_all(spark, d):
    return synth.evaluate(*_whole_truth(spark, d))


@query()
def synthetic_conn(spark, d):
    return synth.generate(spark, days=1, bg_rows_per_day=500, noisy_rows_per_day=50)["conn"]


@query()
def synthetic_labels(spark, d):
    return synth.generate(spark, days=2, bg_rows_per_day=100, noisy_rows_per_day=10)["labels"]
