"""Independent evidence for beacon candidates from DNS, HTTP and TLS logs.

Candidates have ``src_ip``, ``dst_ip`` and ``dominant_period_s``.  Logs are aggregated by their own keys
before they meet the candidates, so a hot source is summed up in many tasks first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import Settings
from tidewatch.functions.expr import answer_ips, benign_agent, benign_domain, clip01, looks_generated, short_ttl, string_entropy, uri_path

SELF_SIGNED = ("self signed", "unable to get", "certificate verify failed", "unknown ca", "self-signed")
USUAL_METHODS = ("GET", "POST", "HEAD", "OPTIONS")
PAIR = ("src_ip", "dst_ip")


def _flag(c) -> Column:
    return F.coalesce(c, F.lit(False))


def dns_window(dns: DataFrame, fallback: float = 0.0) -> DataFrame:
    """One row: seconds that the DNS log covers."""
    span = F.max("ts") - F.min("ts")
    return dns.agg(F.coalesce(F.when(span > 0, span), F.lit(fallback)).alias("window_s"))


def min_observations(window: Column, period: Column, duty: float = 0.5) -> Column:
    return F.when((window > 0) & (period > 0), F.greatest(F.lit(3), F.floor(window / period * duty).cast("int"))).otherwise(F.lit(3))


def dns_regularity(dns: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(src_ip, query, n, n_iat, median_iat, cv, answer_set) of non-benign names."""
    rows = dns.where(~benign_domain("query", extra))
    w = Window.partitionBy("src_ip", "query").orderBy("ts")
    gaps = rows.withColumn("iat", F.col("ts") - F.lag("ts").over(w))
    answers = F.array_distinct(F.flatten(F.collect_set(answer_ips("answers")))) if "answers" in dns.columns else F.array().cast("array<string>")
    agg = gaps.groupBy("src_ip", "query").agg(F.count("*").alias("n"), F.count("iat").alias("n_iat"), F.percentile("iat", F.lit(0.5)).alias("median_iat"), F.stddev_pop("iat").alias("_sd"), answers.alias("answer_set"))
    return agg.withColumn("cv", F.col("_sd") / (F.col("median_iat") + 1e-9)).drop("_sd")


def h1_matches(candidates: DataFrame, regular: DataFrame, window: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """(src_ip, dst_ip, query, delta, rank): names asked for in the beacon's rhythm, the best first; names that resolve elsewhere count 0.05 worse."""
    c = (cfg or Settings()).corroboration
    period = F.col("dominant_period_s")
    met = candidates.select(*PAIR, "dominant_period_s").join(regular, "src_ip").join(F.broadcast(window))
    delta = F.abs(F.col("median_iat") - period) / (period + 1e-9)
    good = (F.col("n") >= min_observations(F.col("window_s"), period, c.dns_min_obs_duty_cycle)) & (F.col("n_iat") >= 2) & (F.col("cv") <= 0.60) & (delta <= c.period_tolerance_pct)
    away = (F.size("answer_set") > 0) & ~F.array_contains("answer_set", F.col("dst_ip"))
    found = met.where(good).withColumn("delta", F.when(away, F.least(delta + 0.05, F.lit(1.0))).otherwise(delta))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*PAIR).orderBy("delta", "query"))).select(*PAIR, "query", "delta", "rank")


def dns_signals(dns: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """One row for each source: generated names, failed lookups, short TTLs, fast flux."""
    s = cfg or Settings()
    c, extra = s.corroboration, s.corroboration.extra_benign_domain_suffixes
    total = dns.groupBy("src_ip").agg(F.count("*").alias("_all"))
    rows = dns.where(~benign_domain("query", extra))
    failed = F.upper("rcode").isin("NXDOMAIN") if "rcode" in dns.columns else F.lit(False)
    brief = short_ttl("ttls", c.short_ttl_threshold_s) if "ttls" in dns.columns and s.parity != "reference" else F.lit(False)
    ips = answer_ips("answers") if "answers" in dns.columns else F.array().cast("array<string>")
    names = rows.groupBy("src_ip", "query").agg(F.count_if(failed).alias("nx"), F.count_if(brief).alias("short"), F.size(F.array_distinct(F.flatten(F.collect_set(ips)))).alias("ips"))
    names = names.withColumn("dga", looks_generated("query", c.dga_min_label_len, c.dga_entropy_threshold)).withColumn("flux", F.col("ips") >= c.fast_flux_unique_ip_threshold)
    by = names.groupBy("src_ip").agg(
        F.sum("nx").alias("nx"), F.sum("short").alias("short"), F.array_sort(F.collect_set(F.when(F.col("dga"), F.col("query")))).alias("dga"), F.array_sort(F.collect_set(F.when(F.col("flux"), F.col("query")))).alias("flux")
    )
    return total.join(by, "src_ip", "left").select(
        "src_ip", F.coalesce("nx", F.lit(0)).alias("nx"), (F.coalesce("nx", F.lit(0)) / F.col("_all")).alias("nx_rate"), F.coalesce("short", F.lit(0)).alias("short"),
        F.coalesce("dga", F.array().cast("array<string>")).alias("dga"), F.coalesce("flux", F.array().cast("array<string>")).alias("flux"),
    )


def score_dns(candidates: DataFrame, dns: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """(src_ip, dst_ip) with H1, H2, their details and ``dns_score``."""
    s = cfg or Settings()
    none = F.array().cast("array<string>")
    matches = h1_matches(candidates, dns_regularity(dns, s.corroboration.extra_benign_domain_suffixes), dns_window(dns), s)
    best = matches.groupBy(*PAIR).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "query"))), lambda x: x["query"]).alias("_matched"), F.min(F.when(F.col("rank") == 1, F.col("delta"))).alias("h1_period_delta"), F.min(F.when(F.col("rank") == 1, F.col("query"))).alias("h1_best_domain")
    )
    out = candidates.select(*PAIR).distinct().join(best, list(PAIR), "left").join(dns_signals(dns, s), "src_ip", "left")
    matched, dga, flux = F.coalesce("_matched", none), F.coalesce("dga", none), F.coalesce("flux", none)
    nx = (F.col("nx_rate") >= s.corroboration.nxdomain_rate_threshold) | (F.col("nx") > 0)
    h1, has_dga, has_nx = F.size(matched) > 0, F.size(dga) > 0, _flag(nx)
    h2 = has_dga | has_nx | _flag(F.col("short") > 0) | (F.size(flux) > 0)
    both = F.arrays_overlap(matched, F.array_union(dga, flux))
    score = 0.35 * h1.cast("double") + 0.40 * h2.cast("double") + 0.15 * has_dga.cast("double") + 0.10 * has_nx.cast("double") + 0.10 * _flag(both).cast("double")
    return out.select(
        *PAIR, h1.alias("h1_dns_regularity"), F.coalesce("h1_best_domain", F.lit("")).alias("h1_best_domain"), "h1_period_delta", h2.alias("h2_dns_anomaly"), F.slice(dga, 1, 10).alias("h2_dga_domains"), F.least(F.size(dga), F.lit(10)).alias("h2_dga_count"),
        F.coalesce("nx", F.lit(0)).alias("h2_nxdomain_count"), F.coalesce("nx_rate", F.lit(0.0)).alias("h2_nxdomain_rate"), F.coalesce("short", F.lit(0)).alias("h2_short_ttl_count"), F.slice(flux, 1, 10).alias("h2_fast_flux_domains"),
        F.least(F.size(flux), F.lit(10)).alias("h2_fast_flux_count"), F.slice(matched, 1, 10).alias("matched_domains"), F.round(clip01(score), 4).alias("dns_score"),
    )


def global_agents(http: DataFrame) -> DataFrame:
    """(user_agent, freq): share of each agent among all rows that have one."""
    counts = http.where("user_agent IS NOT NULL").groupBy("user_agent").agg(F.count("*").alias("_c"))
    return counts.join(F.broadcast(counts.agg(F.sum("_c").alias("_n")))).select("user_agent", (F.col("_c") / F.col("_n")).alias("freq"))


def trimmed_cv(rows: DataFrame, key: list[str], value: str, trim: float = 0.05) -> DataFrame:
    """(key, cv): sample deviation by mean within the trimmed quantiles, both ends included; null for one row or a mean of 0 and less."""
    bounds = rows.groupBy(*key).agg(F.percentile(value, F.array(F.lit(trim), F.lit(1 - trim))).alias("_q"), F.count(value).alias("_n"), F.avg(value).alias("_m")).where("_n > 1 AND _m > 0")
    kept = rows.join(bounds, key).where(F.col(value).between(F.col("_q")[0], F.col("_q")[1]))
    return kept.groupBy(*key).agg(F.when((F.count(value) > 1) & (F.avg(value) > 0), F.stddev_samp(value) / F.avg(value)).alias("cv"))


def plain_cv(value) -> Column:
    return F.when((F.count(value) > 1) & (F.avg(value) > 0), F.stddev_samp(value) / F.avg(value))


def h3_score(body: Column, uri: Column, path: Column, cfg: Settings | None = None) -> Column:
    """Weighted share of the available variations that are small."""
    c = (cfg or Settings()).corroboration
    parts = ((0.4, body, c.http_body_cv_threshold), (0.3, uri, c.http_uri_cv_threshold), (0.3, path, c.http_uri_cv_threshold))
    got = sum((F.when(v.isNotNull(), F.lit(w) * (v < t).cast("double")).otherwise(F.lit(0.0)) for w, v, t in parts), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for w, v, _ in parts), F.lit(0.0))
    return F.when(weight > 0, got / weight).otherwise(F.lit(0.0))


def top_share(rows: DataFrame, key: list[str], value: Column) -> DataFrame:
    """(key, top, share, n): the commonest value (ties: least) and its share."""
    counts = rows.groupBy(*key, value.alias("_v")).agg(F.count("*").alias("_c"))
    return counts.groupBy(*key).agg(F.max(F.struct("_c")).alias("_m"), F.sum("_c").alias("n"), F.min_by("_v", F.struct(-F.col("_c"), "_v")).alias("top")).select(*key, "top", (F.col("_m._c") / F.col("n")).alias("share"), "n")


def first_seen(rows: DataFrame, key: list[str], value: str, most: int = 10) -> DataFrame:
    """(key, seen): the first ``most`` different values, in the order of their first time (ties and rows without a time by value)."""
    times = F.min("ts") if "ts" in rows.columns else F.lit(None).cast("double")
    first = rows.groupBy(*key, F.col(value).alias("_v")).agg(times.alias("_t"))
    order = [F.asc_nulls_last("_t"), "_v"]
    ranked = first.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_k") <= most)
    return ranked.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda x: x["_v"]).alias("seen"))


def score_http(candidates: DataFrame, http: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """(src_ip, dst_ip) with H3, H4, their details, ``http_flows`` and ``http_score``."""
    s = cfg or Settings()
    c, key = s.corroboration, list(PAIR)
    rows = http.join(candidates.select(*key).distinct(), key, "left_semi").where(~benign_agent("user_agent"))
    rows = rows.withColumns({"_body": F.col("response_body_len").cast("double"), "_uri": F.length("uri").cast("double"), "_path": F.length(uri_path("uri")).cast("double")})
    rich = (string_entropy("uri") > c.uri_entropy_threshold).cast("double")
    agg = rows.groupBy(*key).agg(
        F.count("*").alias("http_flows"), plain_cv("_uri").alias("_ucv"), plain_cv("_path").alias("_pcv"), F.avg(rich).alias("_rich"), F.array_sort(F.array_except(F.collect_set(F.upper("method")), F.array(*map(F.lit, USUAL_METHODS)))).alias("_odd"),
    )
    agg = agg.join(first_seen(rows.withColumn("_ua", F.coalesce("user_agent", F.lit(""))), key, "_ua").withColumnRenamed("seen", "unique_user_agents"), key, "left")
    agg = agg.join(trimmed_cv(rows, key, "_body", c.body_cv_trim_pct).withColumnRenamed("cv", "_bcv"), key, "left")
    agent = top_share(rows, key, F.coalesce("user_agent", F.lit(""))).join(global_agents(http).withColumnRenamed("user_agent", "top"), "top", "left")
    agg = agg.join(agent.select(*key, "top", "share", "freq"), key)
    consistency = h3_score(F.col("_bcv"), F.col("_ucv"), F.col("_pcv"), s)
    h3 = consistency >= 0.5
    mono = F.col("share") >= 1 - c.rare_ua_threshold
    rare = F.when(F.col("top") != "", F.coalesce("freq", F.lit(0.0)) < c.global_ua_rare_threshold).otherwise(F.col("share") < c.rare_ua_threshold)
    entropy, odd = F.col("_rich") >= c.high_entropy_uri_frac, F.size("_odd") > 0
    h4 = mono | rare | entropy | odd
    score = 0.30 * h3.cast("double") + 0.25 * rare.cast("double") + 0.15 * mono.cast("double") + 0.20 * entropy.cast("double") + 0.10 * odd.cast("double")
    return agg.select(
        *key, "http_flows", h3.alias("h3_http_consistency"), F.round(consistency, 4).alias("h3_score"), F.round("_bcv", 4).alias("h3_response_body_cv"), F.round("_ucv", 4).alias("h3_uri_len_cv"), F.round("_pcv", 4).alias("h3_path_cv"), h4.alias("h4_evasion_indicators"),
        mono.alias("h4_ua_monotony"), rare.alias("h4_rare_ua"), entropy.alias("h4_high_uri_entropy"), F.col("_odd").alias("h4_abnormal_methods"), "unique_user_agents", F.round(clip01(score), 4).alias("http_score"),
    )


def sni_stability(rows: DataFrame, key: list[str], threshold: float = 1.0) -> DataFrame:
    """(key, n_sni, sni_stable): one server name, or names of so few characters that their entropy is low."""
    named = rows.where(F.col("server_name").isNotNull() & ~F.col("server_name").isin("", "-"))
    names = named.groupBy(*key, "server_name").agg(F.count("*").alias("_c"))
    agg = names.groupBy(*key).agg(F.sum("_c").alias("n_sni"), F.count("*").alias("_d"))
    # the entropy of all names with repeats, joined by spaces, from counts of characters
    chars = names.select(*key, "_c", F.explode(F.filter(F.split(F.lower("server_name"), ""), lambda x: x != "")).alias("_ch"))
    spaces = agg.select(*key, (F.col("n_sni") - 1).alias("_c"), F.lit(" ").alias("_ch")).where("_c > 0")
    counts = chars.unionByName(spaces).groupBy(*key, "_ch").agg(F.sum("_c").alias("_c"))
    entropy = counts.groupBy(*key).agg((F.log2(F.sum("_c")) - F.sum(F.col("_c") * F.log2("_c")) / F.sum("_c")).alias("_e"))
    return agg.join(entropy, key).select(*key, "n_sni", ((F.col("_d") == 1) | (F.col("_e") < threshold)).alias("sni_stable"))


def score_tls(candidates: DataFrame, ssl: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """(src_ip, dst_ip) with H5, H6, their details, ``ssl_flows`` and ``tls_score``."""
    s = cfg or Settings()
    t, key = s.corroboration.tls, list(PAIR)
    rows = ssl.join(candidates.select(*key).distinct(), key, "left_semi")
    bad = F.lit(False)
    for word in SELF_SIGNED:
        bad = bad | F.lower("validation_status").contains(word)
    agg = rows.groupBy(*key).agg(
        F.count("*").alias("ssl_flows"), F.max(_flag(F.col("ja3").isin(*t.ja3_known_c2))).alias("_known"), F.max(_flag(bad)).alias("self_signed"), F.avg((F.lower(F.col("resumed").cast("string")) == "true").cast("double")).alias("_res"),
        F.slice(F.array_sort(F.collect_set(F.when(~F.col("server_name").isin("", "-"), F.col("server_name")))), 1, 10).alias("observed_snis"), F.slice(F.array_sort(F.collect_set("ja3")), 1, 5).alias("observed_ja3s"),
    )
    agg = agg.join(sni_stability(rows, key, t.sni_entropy_threshold), key, "left")
    agg = agg.join(top_share(rows.where(F.length("ja3") == 32), key, F.col("ja3")).select(*key, F.col("share").alias("_ja3")), key, "left")
    certs = rows.where(F.length("cert_chain_fuids") > 0).groupBy(*key, "cert_chain_fuids").agg(F.count("*").alias("_c")).groupBy(*key).agg(F.max("_c").alias("_certs"))
    agg = agg.join(certs, key, "left")
    sni, ja3, cert = _flag(F.col("sni_stable")), _flag(F.col("_ja3") >= t.ja3_monotony_threshold), _flag(F.col("_certs") >= t.cert_reuse_min_sessions)
    known = _flag(F.col("_known"))
    absent, resumed = F.coalesce("n_sni", F.lit(0)) == 0, _flag(F.col("_res") > t.resumption_threshold)
    own = F.col("self_signed")
    d = lambda c: c.cast("double")
    h5 = d(sni) + d(ja3) + d(cert) >= 2
    score = t.h5_weight * (0.4 * d(sni) + 0.4 * d(ja3) + 0.2 * d(cert)) + t.h6_weight * (0.3 * d(own) + 0.25 * d(known | F.lit(False)) + 0.25 * d(absent) + 0.2 * d(resumed))
    return agg.select(
        *key, "ssl_flows", h5.alias("h5_tls_consistency"), sni.alias("h5_sni_stable"), ja3.alias("h5_ja3_monotonic"), cert.alias("h5_cert_reuse"), (own | known | absent | resumed).alias("h6_tls_anomaly"), own.alias("h6_self_signed"), known.alias("h6_known_c2_ja3"),
        absent.alias("h6_absent_sni"), resumed.alias("h6_high_resumption"), F.lit(False).alias("h6_new_cert"), "observed_snis", "observed_ja3s", F.round(score, 4).alias("tls_score"),
    )


def corroboration_score(dns: Column, http: Column, tls: Column, h: list[Column], http_flows: Column, ssl_flows: Column) -> Column:
    """Weighted by which logs have rows for the pair."""
    w = lambda *p: sum((F.lit(k) * x.cast("double") for k, x in p), F.lit(0.0))
    full = 0.30 * dns + 0.30 * http + 0.20 * tls + 0.20 * w(*zip((0.20, 0.25, 0.15, 0.15, 0.13, 0.12), h))
    web = 0.60 * w(*zip((0.25, 0.35, 0.20, 0.20), h[:4])) + 0.20 * dns + 0.20 * http
    secure = 0.40 * dns + 0.40 * tls + 0.20 * w(*zip((0.25, 0.35, 0.20, 0.20), (h[0], h[1], h[4], h[5])))
    bare = 0.55 * w((0.35, h[0]), (0.65, h[1])) + 0.45 * dns
    has_http, has_ssl = http_flows > 0, ssl_flows > 0
    return F.round(F.when(has_http & has_ssl, full).when(has_http, web).when(has_ssl, secure).otherwise(bare), 4)


def corroborate(candidates: DataFrame, dns: DataFrame | None, http: DataFrame | None, ssl: DataFrame | None, cfg: Settings | None = None) -> DataFrame:
    """Every candidate with all evidence, its score and whether it is corroborated, best first."""
    s, key = cfg or Settings(), list(PAIR)
    out = candidates
    if dns is not None:
        out = out.join(score_dns(candidates, dns, s), key, "left")
    if http is not None:
        out = out.join(score_http(candidates, http, s), key, "left")
    if ssl is not None:
        out = out.join(score_tls(candidates, ssl, s), key, "left")
    flags = ["h1_dns_regularity", "h2_dns_anomaly", "h3_http_consistency", "h4_evasion_indicators", "h5_tls_consistency", "h6_tls_anomaly"]
    more = ["h4_ua_monotony", "h4_rare_ua", "h4_high_uri_entropy", "h5_sni_stable", "h5_ja3_monotonic", "h5_cert_reuse", "h6_self_signed", "h6_known_c2_ja3", "h6_absent_sni", "h6_high_resumption", "h6_new_cert"]
    numbers = ["dns_score", "http_score", "tls_score", "h3_score", "h2_nxdomain_rate"]
    counts = ["http_flows", "ssl_flows", "h2_dga_count", "h2_nxdomain_count", "h2_short_ttl_count", "h2_fast_flux_count"]
    lists = ["h2_dga_domains", "h2_fast_flux_domains", "matched_domains", "h4_abnormal_methods", "unique_user_agents", "observed_snis", "observed_ja3s"]
    fill = lambda names, value: {c: F.coalesce(F.col(c), value) if c in out.columns else value for c in names}
    out = out.withColumns(fill([*flags, *more], F.lit(False)) | fill(numbers, F.lit(0.0)) | fill(counts, F.lit(0).cast("bigint")) | fill(lists, F.array().cast("array<string>")))
    score = corroboration_score(F.col("dns_score"), F.col("http_score"), F.col("tls_score"), [F.col(c) for c in flags], F.col("http_flows"), F.col("ssl_flows"))
    out = out.withColumn("corroboration_score", score)
    return out.withColumn("corroborated", F.col("corroboration_score") >= s.corroboration.min_score).orderBy(F.desc("corroboration_score"), *key)
