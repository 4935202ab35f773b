"""Queries of timing: symbolic words, autocorrelation, spectrum, confidence, segments, priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.config import Settings
from tidewatch.operators import changepoint, periodicity, sax, triage
from tidewatch.plans.flow_queries import QUERIES, SQL, query
from tidewatch.plans.standins import EVENTS, FLOWS, events, flows, rounded, table

__all__ = ["QUERIES", "SQL"]

_IAT = f"{EVENTS}, r AS (SELECT user_id, timestamp - lag(timestamp) OVER w AS iat, row_number() OVER w - 2 AS j FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY timestamp)), x AS (SELECT * FROM r WHERE iat IS NOT NULL)"
_Z = _IAT + ", st AS (SELECT user_id, count(*) AS n, avg(iat) AS m, stddev_pop(iat) AS s FROM x GROUP BY 1), z AS (SELECT x.user_id, j, n, CASE WHEN s < 1e-8 THEN 0.0 ELSE (iat - m) / s END AS z FROM x JOIN st USING (user_id))"
_PAA = (
    _Z
    + """, c AS (SELECT *, least(20, n - 1) AS w FROM z), e AS (SELECT *, unnest(range((j * w) // n, ((j + 1) * w - 1) // n + 1)) AS i FROM c WHERE w >= 1),
pa AS (SELECT user_id, n, w, i, sum(greatest(0.0, least(CAST(j + 1 AS DOUBLE), (i + 1) * n / CAST(w AS DOUBLE)) - greatest(CAST(j AS DOUBLE), i * n / CAST(w AS DOUBLE))) * z)
  / sum(greatest(0.0, least(CAST(j + 1 AS DOUBLE), (i + 1) * n / CAST(w AS DOUBLE)) - greatest(CAST(j AS DOUBLE), i * n / CAST(w AS DOUBLE)))) AS mean FROM e GROUP BY ALL)"""
)
_SAX = (
    _PAA
    + """, sy AS (SELECT user_id, n, w, i, CAST(mean > -0.6745 AS INT) + CAST(mean > 0.0 AS INT) + CAST(mean > 0.6745 AS INT) AS s FROM pa),
wd AS (SELECT user_id, n, w, list(s ORDER BY i) AS symbols, string_agg(substr('abcdefgh', s + 1, 1), '' ORDER BY i) AS sax_word, avg(s) AS mu, stddev_pop(s) AS sd FROM sy GROUP BY ALL),
ts AS (SELECT user_id, n, w, sax_word, sd / (mu + 1e-9) AS sax_symbol_cv,
  CASE WHEN sd < 1e-9 OR len(symbols) < least(10, len(symbols) // 2) + 2 THEN 0.0 ELSE list_max([abs(list_sum([(symbols[a] - mu) / sd * (symbols[a + k] - mu) / sd FOR a IN range(1, len(symbols) - k + 1)]) / (len(symbols) - k)) FOR k IN range(1, least(10, len(symbols) // 2) + 1)]) END AS sax_acf_peak,
  round(list_max([(len(sax_word) - len(replace(sax_word, substr(sax_word, 1, m), ''))) / CAST(len(sax_word) AS DOUBLE) FOR m IN range(2, len(sax_word) // 2 + 1)]), 4) AS sax_motif_fraction FROM wd WHERE n >= 3 AND w >= 4)"""
)


def _rows(spark, d):
    return sax.iat_rows(events(spark, d), "user_id", "timestamp")


def _parts(spark, d):
    return sax.paa(sax.znorm(_rows(spark, d), "user_id"), "user_id")


def _words(spark, d):
    return sax.word_tests(sax.encode(_parts(spark, d).where("n >= 3 AND w >= 4"), "user_id"))


@query(f"WITH {_Z} SELECT user_id, j, round(z, 5) + 0.0 AS z FROM z")
def znorm(spark, d):
    return rounded(sax.znorm(_rows(spark, d), "user_id").select("user_id", "j", "z"), 5)


@query(f"WITH {_PAA} SELECT user_id, n, w, i, round(mean, 5) + 0.0 AS mean FROM pa")
def paa(spark, d):
    return rounded(_parts(spark, d).select("user_id", "n", "w", F.col("i").cast("bigint").alias("i"), "mean"), 5)


@query(f"WITH {_SAX} SELECT user_id, sax_word FROM wd")
def sax_encode(spark, d):
    return sax.encode(_parts(spark, d), "user_id").select("user_id", "sax_word")


@query(f"WITH {_SAX} SELECT user_id, round(sax_symbol_cv, 6) AS sax_symbol_cv FROM ts")
def sax_symbol_cv(spark, d):
    return _words(spark, d).select("user_id", "sax_symbol_cv")


@query(f"WITH {_SAX} SELECT user_id, round(sax_acf_peak, 6) AS sax_acf_peak FROM ts")
def sax_acf_peak(spark, d):
    return _words(spark, d).select("user_id", "sax_acf_peak")


@query(f"WITH {_SAX} SELECT user_id, sax_motif_fraction FROM ts")
def sax_motif_fraction(spark, d):
    return _words(spark, d).select("user_id", "sax_motif_fraction")


_TOP = f"{_SAX}, top AS (SELECT user_id, count(*) AS n_observations FROM ev GROUP BY 1 HAVING count(*) >= 8 ORDER BY 2 DESC, 1 LIMIT 5000), sc AS (SELECT top.user_id, n_observations, sax_word, sax_symbol_cv, sax_acf_peak, sax_motif_fraction, coalesce(CAST(sax_symbol_cv < 0.6 AS INT) + CAST(sax_acf_peak > 0.3 AS INT) + CAST(sax_motif_fraction > 0.4 AS INT) >= 2, false) AS sax_passes FROM top LEFT JOIN ts USING (user_id))"


@query(f"WITH {_TOP} SELECT user_id, n_observations, sax_word, round(sax_symbol_cv, 6) AS sax_symbol_cv, round(sax_acf_peak, 6) AS sax_acf_peak, sax_motif_fraction, sax_passes FROM sc")
def sax_screen(spark, d):
    return sax.screen(events(spark, d), "user_id", "timestamp")


@query(f"WITH {_TOP} SELECT user_id, n_observations FROM top")
def topk_channels(spark, d):
    return sax.top_channels(events(spark, d), "user_id")


_ACF = f"""{_IAT}, gp AS (SELECT user_id, count(*) AS n_iat, avg(iat) AS mean, stddev_pop(iat) AS sd, quantile_cont(iat, 0.5) AS med, quantile_cont(iat, 0.5) FILTER (iat > 0) AS medp, count(*) FILTER (iat > 0) AS n_pos FROM x GROUP BY 1),
bd AS (SELECT user_id, count(*) AS n, min(timestamp) AS t0, max(timestamp) AS t1 FROM ev GROUP BY 1),
tm AS (SELECT * FROM bd LEFT JOIN gp USING (user_id)),
wi AS (SELECT *, (t0 + greatest(medp / 2, 1.0)) - t0 AS dd, CAST(ceil((t1 + greatest(medp / 2, 1.0) - t0) / greatest(medp / 2, 1.0)) AS BIGINT) - 1 AS bins FROM tm WHERE n >= 8 AND n_pos >= 4),
wl AS (SELECT *, CASE WHEN bins < 42 THEN greatest(1, bins - 2) ELSE 40 END AS lags FROM wi WHERE bins >= 4),
bi AS (SELECT ev.user_id, bins, lags, timestamp AS t, t0, dd, CAST(floor((timestamp - t0) / dd) AS BIGINT) AS i FROM ev JOIN wl USING (user_id)),
bn AS (SELECT user_id, bins, lags, CASE WHEN t = t0 + bins * dd THEN bins - 1 WHEN t0 + i * dd > t THEN i - 1 WHEN t0 + (i + 1) * dd <= t THEN i + 1 ELSE i END AS bin FROM bi),
ct AS (SELECT user_id, bins, lags, bin, count(*) AS c FROM bn WHERE bin < bins GROUP BY ALL),
tt AS (SELECT user_id, bins, sum(c) AS s1, sum(c * c) AS s2 FROM ct GROUP BY ALL),
lg AS (SELECT *, unnest(range(1, lags + 1)) AS lag FROM ct),
eg AS (SELECT user_id, lag, sum(CASE WHEN bin < bins - lag THEN c ELSE 0 END) AS lo, sum(CASE WHEN bin >= lag THEN c ELSE 0 END) AS hi FROM lg GROUP BY ALL),
mt AS (SELECT a.user_id, a.lag, sum(a.c * b.c) AS xy FROM lg a JOIN ct b ON a.user_id = b.user_id AND b.bin = a.bin + a.lag GROUP BY ALL),
ac AS (SELECT eg.user_id, bins, eg.lag, (coalesce(xy, 0) - s1 / CAST(bins AS DOUBLE) * (lo + hi) + (bins - eg.lag) * (s1 / CAST(bins AS DOUBLE)) * (s1 / CAST(bins AS DOUBLE))) / (s2 - bins * (s1 / CAST(bins AS DOUBLE)) * (s1 / CAST(bins AS DOUBLE)) + 1e-9) AS r FROM eg LEFT JOIN mt ON eg.user_id = mt.user_id AND eg.lag = mt.lag JOIN tt ON tt.user_id = eg.user_id),
pk AS (SELECT user_id, max(r) AS acf_peak, arg_min(lag, [-r, lag]) AS acf_peak_lag FROM ac WHERE r > greatest(0.25, 1.96 / sqrt(bins)) GROUP BY 1)"""


@query(f"WITH {_ACF} SELECT user_id, bins, lag, round(r, 6) + 0.0 AS r FROM ac")
def binned_count_acf(spark, d):
    return periodicity.binned_acf(events(spark, d), "user_id", "timestamp").select("user_id", F.col("bins").cast("bigint").alias("bins"), "lag", "r")


@query(f"WITH {_ACF} SELECT user_id, round(acf_peak, 6) AS acf_peak, CAST(acf_peak_lag AS BIGINT) AS acf_peak_lag FROM pk")
def acf_peak(spark, d):
    return periodicity.acf_peak(periodicity.binned_acf(events(spark, d), "user_id", "timestamp"), "user_id")


@query(f"WITH {_ACF} SELECT user_id, CASE WHEN n_iat >= 60 AND sd > 1e-9 THEN CAST(least(n_iat, 64) AS DOUBLE) ELSE 0.0 END AS fft_period_s, CASE WHEN n_iat >= 60 AND sd > 1e-9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fft_power_ratio FROM tm")
def welch_default_closed_form(spark, d):
    return periodicity.welch_closed_form(periodicity.timing(events(spark, d), "user_id", "timestamp"), "user_id").withColumns({"fft_period_s": F.coalesce("fft_period_s", F.lit(0.0)), "fft_power_ratio": F.coalesce("fft_power_ratio", F.lit(0.0))})


@query(f"""WITH {EVENTS}, o AS (SELECT user_id, list_sort(list(timestamp)) AS t FROM ev GROUP BY user_id),
x AS (SELECT user_id, [t[i + 1] - t[i] FOR i IN range(1, len(t))] AS x, len(t) - 1 AS n, least(len(t) - 1, 64) AS size FROM o WHERE len(t) > 1),
w AS (SELECT user_id, x, size, unnest(range(0, n - size + 1, size - size // 2)) AS a FROM x WHERE n >= 8),
v AS (SELECT user_id, a, size, i, (x[a + i + 1] - list_avg(x[a + 1:a + size])) * (0.5 - 0.5 * cos(2 * pi() * i / size)) AS v FROM (SELECT *, unnest(range(0, size)) AS i FROM w)),
f AS (SELECT user_id, size, a, k, sum(v * cos(2 * pi() * k * i / size)) AS re, sum(v * sin(2 * pi() * k * i / size)) AS im FROM (SELECT *, unnest(range(1, size // 2 + 1)) AS k FROM v) GROUP BY ALL),
p AS (SELECT user_id, size, k, avg((re * re + im * im) * CASE WHEN 2 * k = size THEN 1 ELSE 2 END) AS p FROM f WHERE size / k >= 4.0 GROUP BY ALL),
q AS (SELECT user_id, arg_max(CAST(size AS DOUBLE) / k, (p, -k)) AS period, max(p) AS top, sum(p) AS total, any_value(size) AS size FROM p GROUP BY user_id)
SELECT x.user_id, coalesce(round(period, 6), 0.0) AS fft_period_s, coalesce(round(top / (total + 1e-12), 6), 0.0) AS fft_power_ratio FROM x LEFT JOIN q USING (user_id)""")
def welch_psd(spark, d):
    return rounded(periodicity.welch_psd(events(spark, d), "user_id", "timestamp", 4.0))


_PER = f"""{_ACF}, pe0 AS (SELECT tm.user_id, n AS n_observations, med, sd / (mean + 1e-9) AS iat_cv, coalesce(acf_peak, 0) AS acf_peak, coalesce(acf_peak_lag, 0) AS acf_peak_lag,
  CASE WHEN n_iat >= 60 AND sd > 1e-9 THEN CAST(least(n_iat, 64) AS DOUBLE) ELSE 0.0 END AS fft_period_s, CASE WHEN n_iat >= 60 AND sd > 1e-9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fft_power_ratio FROM tm LEFT JOIN pk USING (user_id) WHERE n >= 10),
pe1 AS (SELECT *, acf_peak_lag * med / 2 AS acf_period FROM pe0),
pe2 AS (SELECT *, CASE WHEN acf_period >= 60 THEN acf_period ELSE fft_period_s END AS dominant FROM pe1),
pe3 AS (SELECT *, coalesce(iat_cv < 0.6 AND dominant >= 60 AND ((acf_peak > 0.25 AND acf_period >= 60) OR (fft_power_ratio > 0.15 AND fft_period_s >= 60)), false) AS is_periodic FROM pe2),
pe AS (SELECT *, round(0.4 * least(greatest(acf_peak / (0.25 + 1e-9), 0), 1) + 0.3 * least(greatest(1 - iat_cv / 0.6, 0), 1) + 0.2 * least(greatest(fft_power_ratio / (0.15 + 1e-9), 0), 1) + 0.1 * CAST(is_periodic AS INT), 4) AS beacon_confidence FROM pe3)"""


def _timed(spark, d):
    return periodicity.score_channels(events(spark, d), "user_id", "timestamp")


@query(f"WITH {_PER} SELECT user_id, n_observations, round(dominant, 1) AS dominant_period_s, round(acf_peak, 4) AS acf_peak, CAST(acf_peak_lag AS BIGINT) AS acf_peak_lag, round(iat_cv, 4) AS iat_cv, is_periodic FROM pe")
def periodicity_scores(spark, d):
    return _timed(spark, d).select("user_id", "n_observations", "dominant_period_s", "acf_peak", "acf_peak_lag", "iat_cv", "is_periodic")


@query(f"WITH {_PER} SELECT user_id, beacon_confidence FROM pe")
def beacon_confidence(spark, d):
    return _timed(spark, d).select("user_id", "beacon_confidence")


@query(f"WITH {_PER}, ga AS (SELECT user_id FROM ev GROUP BY 1 HAVING user_id % 3 = 0) SELECT pe.user_id, CASE WHEN ga.user_id IS NULL THEN 0.0 ELSE round(acf_peak, 4) END AS acf_peak, CASE WHEN ga.user_id IS NULL THEN false ELSE is_periodic END AS is_periodic FROM pe LEFT JOIN ga USING (user_id)")
def sax_gate(spark, d):
    e = events(spark, d)
    gate = e.select("user_id").distinct().withColumn("sax_passes", F.col("user_id") % 3 == 0)
    return periodicity.score_channels(e, "user_id", "timestamp", gate=gate).select("user_id", "acf_peak", "is_periodic")


@query(f"WITH {_PER} SELECT user_id, beacon_confidence, beacon_confidence >= 0.45 AS is_beacon_pair FROM pe ORDER BY beacon_confidence DESC, user_id")
def score_all_channels(spark, d):
    return _timed(spark, d).select("user_id", "beacon_confidence", "is_beacon_pair").orderBy(F.desc("beacon_confidence"), F.asc_nulls_last("user_id"))


# changepoints


@query(f"WITH {_IAT} SELECT user_id, round(greatest(2 * ln(greatest(count(*), 2)) * var_pop(iat), 1.0), 3) AS penalty FROM x GROUP BY 1")
def bic_penalty(spark, d):
    return rounded(changepoint.bic_penalty(_rows(spark, d), "user_id"), 3)


@query(f"WITH {_IAT} SELECT user_id, j // 20 AS segment, round((var_pop(iat) * count(*)) / 1e6, 4) AS cost FROM x GROUP BY ALL")
def segment_cost(spark, d):
    return rounded(changepoint.segment_cost(_rows(spark, d).withColumn("segment", F.floor(F.col("j") / 20)), "user_id", "segment").withColumn("cost", F.col("cost") / 1e6), 4)


_SEG = f"""{_IAT}, sg AS (SELECT user_id, j // 20 AS segment, count(*) AS n, avg(iat) AS mean, stddev_pop(iat) / (avg(iat) + 1e-9) AS cv FROM x GROUP BY ALL),
sp AS (SELECT *, mean > 0 AND cv < 0.95 AS p FROM sg), sl AS (SELECT *, lag(mean) OVER w AS pm, lag(p) OVER w AS pp FROM sp WINDOW w AS (PARTITION BY user_id ORDER BY segment))"""


@query(f"WITH {_SEG} SELECT user_id, segment, n, round(mean, 3) AS mean, round(cv, 6) AS cv, p AS is_periodic, coalesce(p AND NOT pp, false) AS is_start, coalesce(p AND pp AND abs(mean - pm) / pm > 0.10, false) AS is_shift FROM sl")
def segment_classify(spark, d):
    e = events(spark, d)
    at = _rows(spark, d).where("j > 0 AND j % 20 = 0").select("user_id", F.col("j").alias("boundary"))
    out = changepoint.segment_table(e, "user_id", "timestamp", at, 0.95)
    return out.select("user_id", "segment", "n", F.round("mean", 3).alias("mean"), "cv", "is_periodic", "is_start", "is_shift")


# the dynamic program in SQL: a row for each prefix, which carries the costs and starts of all shorter ones
_PELT, _CV = Settings().pelt, Settings().periodicity.cv_threshold
_PELT_SQL = f"""WITH RECURSIVE {EVENTS}, o AS (SELECT user_id, list_sort(list(timestamp)) AS t FROM ev GROUP BY user_id),
x AS (SELECT user_id, t, len(t) - 1 AS n, [t[i + 1] - t[i] FOR i IN range(1, len(t))] AS x FROM o),
y AS (SELECT user_id, t, n, x, greatest(2 * ln(n) * list_var_pop(x), 1.0) AS pen, list_avg(x) AS mu FROM x WHERE n >= 10 AND len(t) >= {_PELT.min_observations}),
z AS (SELECT *, [coalesce(list_sum([v - mu FOR v IN x[1:k]]), 0.0) FOR k IN range(0, n + 1)] AS s1, [coalesce(list_sum([(v - mu) * (v - mu) FOR v IN x[1:k]]), 0.0) FOR k IN range(0, n + 1)] AS s2 FROM y),
r AS (
  SELECT user_id, 0 AS k, [-pen] AS best, [0] AS back FROM z
  UNION ALL
  SELECT user_id, k + 1, list_append(best, CASE WHEN k + 1 < {_PELT.min_segment_length} THEN 1e300 ELSE c.v END), list_append(back, CASE WHEN k + 1 < {_PELT.min_segment_length} THEN 0 ELSE c.s END)
  FROM (SELECT r.user_id, k, best, back, n, list_min([{{'v': best[s + 1] + pen + s2[k + 2] - s2[s + 1] - (s1[k + 2] - s1[s + 1]) * (s1[k + 2] - s1[s + 1]) / (k + 1 - s), 's': CAST(s AS INTEGER)}} FOR s IN range(0, greatest(k + 2 - {_PELT.min_segment_length}, 1))]) AS c FROM r JOIN z USING (user_id)) WHERE k < n),
b AS (
  SELECT r.user_id, back, back[n + 1] AS pos, n AS until FROM r JOIN z ON z.user_id = r.user_id AND r.k = z.n
  UNION ALL
  SELECT user_id, back, back[pos + 1], pos FROM b WHERE pos > 0)"""


@query(f"""{_PELT_SQL}, g AS (SELECT b.user_id, pos, s2[until + 1] - s2[pos + 1] - (s1[until + 1] - s1[pos + 1]) * (s1[until + 1] - s1[pos + 1]) / (until - pos) AS c, t FROM b JOIN z USING (user_id)),
f AS (SELECT user_id, round(sum(c), 1) AS pelt_cost, list(t[pos + 1]) FILTER (pos > 0) AS cuts FROM g GROUP BY user_id)
SELECT o.user_id, unnest(coalesce(cuts, [NULL])) AS "at", pelt_cost FROM o LEFT JOIN f USING (user_id)""")
def pelt_changepoints(spark, d):
    return changepoint.changepoints(events(spark, d), "user_id", "timestamp").select("user_id", F.explode_outer("changepoint_times").alias("at"), "pelt_cost")


@query(f"""{_PELT_SQL}, sg AS (SELECT b.user_id, pos, list_avg(x[pos + 1:until]) AS m, list_stddev_pop(x[pos + 1:until]) AS sd, t[pos + 1] AS began FROM b JOIN z USING (user_id)),
sp AS (SELECT *, m > 0 AND sd / (m + 1e-9) < {_CV} AS p FROM sg), sl AS (SELECT *, lag(p) OVER w AS pp, lag(m) OVER w AS pm FROM sp WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
f AS (SELECT user_id, count(*) - 1 AS n, min(began) FILTER (p AND NOT pp) AS start, bool_or(coalesce(p AND pp AND pm > 0 AND abs(m - pm) / pm > 0.10, false)) AS shift FROM sl GROUP BY user_id)
SELECT o.user_id, CAST(coalesce(f.n, 0) AS INTEGER) AS n_changepoints, start AS beacon_start_ts, strftime(make_timestamp(CAST(floor(start) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S UTC') AS beacon_start_dt, coalesce(shift, false) AS has_interval_shift
FROM o LEFT JOIN f USING (user_id)""")
def changepoints(spark, d):
    return changepoint.changepoints(events(spark, d), "user_id", "timestamp").select("user_id", "n_changepoints", "beacon_start_ts", "beacon_start_dt", "has_interval_shift")


# priority and leads

_PRI = f"""{FLOWS}, ag AS (SELECT src_ip, dst_ip, count(*) AS flow_count, avg(resp_bytes) AS mb, stddev_samp(resp_bytes) AS sb, count(DISTINCT floor(timestamp / 86400)) AS days, (max(timestamp) - min(timestamp)) / 86400 AS span,
  count(*) FILTER (CAST(floor(timestamp) AS BIGINT) % 86400 // 3600 < 6 OR CAST(floor(timestamp) AS BIGINT) % 86400 // 3600 >= 22) AS off FROM flows GROUP BY ALL),
cf AS (SELECT *, (flow_count % 11) / 10.0::DOUBLE AS conf, CASE WHEN flow_count % 2 = 0 THEN 300.0 ELSE 30.0 END AS period, CASE WHEN mb > 0 THEN coalesce(sb, NULL) / mb ELSE 0 END AS bcv, days / greatest(span, 1) AS pr FROM ag),
pp AS (SELECT *, CAST(round_even(conf * 4, 0) AS BIGINT) AS s1, CASE WHEN bcv < 0.10 THEN 2 WHEN bcv < 0.30 THEN 1 ELSE 0 END AS s2, CASE WHEN pr > 0.90 THEN 2 WHEN pr > 0.50 THEN 1 ELSE 0 END AS s3, CAST(conf >= 0.70 AND period >= 60 AS INT) AS s4, CAST(off > 0 AS INT) AS s5 FROM cf)"""


@query(f"WITH {_PRI} SELECT src_ip, dst_ip, flow_count, round(bcv, 6) AS bytes_cv, round(pr, 6) AS persistence_ratio, off AS off_hour_connections, s1 AS score_beacon, CAST(s1 + s2 + s3 + s4 + s5 AS BIGINT) AS priority_score FROM pp")
def priority_score(spark, d):
    f = flows(spark, d).drop("src_bytes")
    n = F.col("n")
    made = f.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("n")).select("src_ip", "dst_ip", ((n % 11) / 10).alias("beacon_confidence"), F.when(n % 2 == 0, 300.0).otherwise(30.0).alias("dominant_period_s"))
    return triage.priority_score(f, ["src_ip", "dst_ip"], made).select("src_ip", "dst_ip", "flow_count", "bytes_cv", "persistence_ratio", "off_hour_connections", "score_beacon", "priority_score")


def _orders(spark, d):
    o = table(spark, d, "orders")
    c, s = (F.col("o_orderkey") % 100) / 100, (F.col("o_custkey") % 100) / 100
    return o.select("o_orderkey", "o_orderstatus", c.alias("c"), s.alias("s"), F.col("o_totalprice").alias("p"))


_ORD = "o AS (SELECT o_orderkey, o_orderstatus, (o_orderkey % 100) / 100.0::DOUBLE AS c, (o_custkey % 100) / 100.0::DOUBLE AS s, o_totalprice AS p FROM orders)"


@query(f"WITH {_ORD} SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR (c >= 0.8 AND s >= 0.7) THEN 'CRITICAL' WHEN c >= 0.65 AND s >= 0.55 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM o")
def severity(spark, d):
    return _orders(spark, d).select("o_orderkey", triage.severity(F.col("c"), F.col("s"), F.col("o_orderstatus") == "P").alias("severity"))


@query("SELECT o_orderkey, CASE WHEN v < 1 THEN 'unknown' WHEN v < 60 THEN concat(v, 's') WHEN v < 3600 THEN printf('%.1f min', v / 60) WHEN v < 86400 THEN printf('%.1f hr', v / 3600) ELSE printf('%.1f days', v / 86400) END AS period FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 60 WHEN 1 THEN 60 + 6 * (o_orderkey % 590) WHEN 2 THEN 3600 + 360 * (o_orderkey % 220) ELSE 86400 + 8640 * (o_orderkey % 50) END AS v FROM orders)")
def fmt_period(spark, d):
    from tidewatch.functions.expr import format_period

    k = F.col("o_orderkey")
    v = F.when(k % 4 == 0, k % 60).when(k % 4 == 1, 60 + 6 * (k % 590)).when(k % 4 == 2, 3600 + 360 * (k % 220)).otherwise(86400 + 8640 * (k % 50))
    return table(spark, d, "orders").select("o_orderkey", format_period(v.cast("double")).alias("period"))


@query("SELECT CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 400000 THEN 51 ELSE CAST(floor(o_totalprice / 8000) AS BIGINT) + 1 END AS bin, count(*) AS n FROM orders GROUP BY 1")
def plot_period_hist(spark, d):
    from tidewatch.report import histogram

    return histogram(table(spark, d, "orders"), "o_totalprice", 0.0, 400000.0, 50)


@query(f"WITH {_ACF} SELECT user_id, round(acf_peak, 6) AS acf_peak, acf_peak_lag FROM (SELECT tm.user_id, coalesce(acf_peak, 0) AS acf_peak, CAST(coalesce(acf_peak_lag, 0) AS BIGINT) AS acf_peak_lag FROM tm LEFT JOIN pk USING (user_id))")
def flagship(spark, d):
    e = events(spark, d)
    times = periodicity.timing(e, "user_id", "timestamp")
    peak = periodicity.acf_peak(periodicity.binned_acf(e, "user_id", "timestamp", times=times), "user_id")
    return times.select("user_id").join(peak, "user_id", "left").select("user_id", F.coalesce("acf_peak", F.lit(0.0)).alias("acf_peak"), F.coalesce("acf_peak_lag", F.lit(0)).cast("bigint").alias("acf_peak_lag"))


# plot data


@query(f"""WITH {EVENTS}, m AS (SELECT min(value) AS a, (max(value) - min(value)) / 60 AS w, quantile_cont(value, 0.05) AS c FROM ev)
SELECT CAST(least(59, floor((value - a) / w)) AS INTEGER) AS bin, round(a + least(59, floor((value - a) / w)) * w, 6) AS lo, round(a + (least(59, floor((value - a) / w)) + 1) * w, 6) AS hi, count(*) AS n, round(any_value(c), 6) AS cutoff
FROM ev, m WHERE value IS NOT NULL GROUP BY ALL""")
def score_histogram(spark, d):
    from tidewatch.report import score_histogram as plot

    return rounded(plot(events(spark, d), "value"))


def _made_scores(spark, d):
    n = F.count("*")
    return events(spark, d).groupBy("user_id").agg((n % 11 / 10).alias("beacon_confidence"), (n * 7.5).alias("dominant_period_s")).withColumn("is_beacon_pair", F.col("beacon_confidence") > 0.5)


_TIMED = f"{EVENTS}, td AS (SELECT user_id, (count(*) % 11) / 10.0::DOUBLE AS beacon_confidence, count(*) * 7.5::DOUBLE AS period, (count(*) % 11) / 10.0::DOUBLE > 0.5 AS is_beacon_pair FROM ev GROUP BY user_id)"


@query(f"""WITH {_TIMED}, b AS (SELECT period / 60 AS v FROM td WHERE is_beacon_pair AND period > 0), m AS (SELECT min(v) AS a, (max(v) - min(v)) / 20 AS w FROM b),
h AS (SELECT CASE WHEN w > 0 THEN CAST(least(19, floor((v - a) / w)) AS INTEGER) ELSE 0 END AS bin, a, w FROM b, m)
SELECT bin, round(a + bin * w, 6) AS lo, round(a + (bin + 1) * w, 6) AS hi, count(*) AS n FROM h GROUP BY bin, a, w""")
def period_histogram(spark, d):
    from tidewatch.report import period_histogram as plot

    return rounded(plot(_made_scores(spark, d)))


@query(f"""WITH {_TIMED} SELECT CAST(row_number() OVER (ORDER BY beacon_confidence DESC, user_id) AS INTEGER) AS rank, user_id, beacon_confidence, is_beacon_pair FROM td ORDER BY rank LIMIT 50""")
def confidence_bars(spark, d):
    """A top-k report: 50 bars are the feature."""
    from tidewatch.report import confidence_bars as plot

    return plot(_made_scores(spark, d), "user_id")


@query(f"""{_PELT_SQL}, sg AS (SELECT b.user_id, pos, list_avg(x[pos + 1:until]) AS m, list_stddev_pop(x[pos + 1:until]) AS sd, t[pos + 1] AS began FROM b JOIN z USING (user_id)),
sp AS (SELECT *, m > 0 AND sd / (m + 1e-9) < {_CV} AS p FROM sg), sl AS (SELECT *, lag(p) OVER w AS pp, lag(m) OVER w AS pm FROM sp WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
f AS (SELECT user_id, min(began) FILTER (p AND NOT pp) AS start, bool_or(coalesce(p AND pp AND pm > 0 AND abs(m - pm) / pm > 0.10, false)) AS shifted FROM sl GROUP BY user_id)
SELECT user_id, start AS began, strftime(make_timestamp(CAST(floor(start) AS BIGINT) * 1000000), '%Y-%m-%d') AS day, shifted FROM f WHERE start IS NOT NULL""")
def campaign_timeline(spark, d):
    from tidewatch.report import campaign_timeline as plot

    return plot(changepoint.changepoints(events(spark, d), "user_id", "timestamp"), "user_id")
