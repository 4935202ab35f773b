"""Channel features: one row for each (source, destination, port, protocol) with enough flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.expr import resolve

ALIASES = {"dst_port": ("dst_port", "destination.port", "id.resp_p", "dst_p"), "proto": ("proto", "network.transport", "network.protocol", "service")}
MODEL_FEATURES = (
    "log_n_flows", "iat_cv", "iat_log_mean", "iat_mad_s", "iat_ratio", "missing_beat_rate", "persistence_ratio", "bytes_cv", "req_resp_asymmetry",
    "zero_payload_frac", "duration_cv", "conn_state_entropy", "sin_time_mean", "cos_time_mean",
)


def channel_key(flows: DataFrame, wanted: tuple[str, ...] = ("src_ip", "dst_ip", "dst_port", "proto")) -> list[str]:
    """The key columns the flows have, by alias, without repeats; source and destination always come first if not asked for."""
    found = [c for c in ("src_ip", "dst_ip") if c not in wanted]
    for name in wanted:
        c = resolve(flows, *ALIASES.get(name, (name,)))
        if c and c not in found:
            found.append(c)
    return found


def with_iat(flows: DataFrame, key: list[str], time: str = "timestamp") -> DataFrame:
    """Adds ``iat``, the seconds since the channel's flow before; null on the first."""
    return flows.withColumn("iat", F.col(time) - F.lag(time).over(Window.partitionBy(*key).orderBy(time)))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def categorical_entropy(flows: DataFrame, key: list[str], column: str) -> DataFrame:
    """Bits of entropy of a column's values within each key; counts are summed up before any key is gathered."""
    counts = flows.where(F.col(column).isNotNull()).groupBy(*key, column).agg(F.count("*").alias("_c"))
    total = counts.groupBy(*key).agg(F.sum("_c").alias("_n"))
    share = F.col("_c") / F.col("_n")
    return counts.join(total, key).groupBy(*key).agg((-F.sum(share * F.log2(share + 1e-12))).alias("entropy"))


def aggregate_channels(flows: DataFrame, min_flows: int = 8, wanted: tuple[str, ...] = ("src_ip", "dst_ip", "dst_port", "proto"), parity: str = "documented") -> DataFrame:
    key = channel_key(flows, wanted)
    if parity == "reference":
        key = [c for c in key if c not in ("proto", "service", "network.transport", "network.protocol")]
    size = resolve(flows, "resp_bytes", "total_bytes")
    flows = flows.dropna(subset=key).withColumn("_b", F.coalesce(F.col(size).cast("double"), F.lit(0.0)) if size else F.lit(0.0))
    own = flows.groupBy(*key).agg(F.count("*").alias("n_flows")).where(F.col("n_flows") >= min_flows)
    rows = with_iat(flows.join(own.select(*key), key, "left_semi"), key)
    good = F.when(F.col("iat") > 0, F.col("iat"))
    src = None if parity == "reference" else resolve(flows, "src_bytes")
    asked = F.abs(F.col(src) - F.col("_b")) / (F.col(src) + F.col("_b") + 1) if src else F.lit(None).cast("double")
    day = F.floor(F.col("timestamp") / 86400)
    has = {c: c in flows.columns for c in ("duration", "sin_time", "cos_time", "scenario")}
    agg = rows.groupBy(*key).agg(
        F.count("*").alias("n_flows"),
        F.count(good).alias("_k"),
        F.avg(good).alias("_mean"),
        F.stddev_pop(good).alias("_std"),
        F.percentile(good, F.lit(0.5)).alias("_median"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.count_distinct(day).alias("_days"),
        F.avg("_b").alias("bytes_mean"),
        F.stddev_samp("_b").alias("_bstd"),
        F.percentile(asked, F.lit(0.5)).alias("_asym"),
        F.avg(F.when(F.col("_b") == 0, 1.0).otherwise(0.0)).alias("zero_payload_frac"),
        *([F.stddev_samp("duration").alias("_dstd"), F.avg("duration").alias("_dmean")] if has["duration"] else [F.lit(None).cast("double").alias("_dstd"), F.lit(None).cast("double").alias("_dmean")]),
        (F.avg("sin_time") if has["sin_time"] else F.lit(0.0)).alias("sin_time_mean"),
        (F.avg("cos_time") if has["cos_time"] else F.lit(1.0)).alias("cos_time_mean"),
        (F.min_by("scenario", "timestamp") if has["scenario"] else F.lit(None).cast("string")).alias("scenario"),
    )
    # the spread round the median needs the median first
    off = rows.where("iat > 0").join(agg.select(*key, "_median"), key).groupBy(*key).agg(F.percentile(F.abs(F.col("iat") - F.col("_median")), F.lit(0.5)).alias("_mad"))
    agg = agg.join(off, key, "left")
    if "conn_state" in flows.columns and parity != "reference":
        agg = agg.join(categorical_entropy(rows, key, "conn_state").withColumnRenamed("entropy", "_entropy"), key, "left")
    else:
        agg = agg.withColumn("_entropy", F.lit(0.0))
    span, timed = F.col("last_seen") - F.col("first_seen"), F.col("_k") >= 2
    expected = F.greatest(F.bround(span / F.col("_median")), F.lit(1.0))
    return agg.select(
        F.concat_ws("→", *[F.col(c).cast("string") for c in key]).alias("channel_id"),
        F.concat_ws("→", "src_ip", "dst_ip").alias("pair_id"),
        *key,
        "n_flows",
        F.log1p("n_flows").alias("log_n_flows"),
        F.when(timed, F.col("_mean")).alias("iat_mean_s"),
        F.when(timed, F.log1p("_mean")).alias("iat_log_mean"),
        F.when(timed, F.col("_std") / F.col("_mean")).alias("iat_cv"),
        F.when(timed, F.col("_mad")).alias("iat_mad_s"),
        F.when(timed, F.col("_median") / F.col("_mean")).alias("iat_ratio"),
        F.when((F.col("_median") > 0) & (F.col("_k") >= 4), F.greatest(F.lit(0.0), expected - F.col("n_flows")) / expected).alias("missing_beat_rate"),
        (F.col("_days") / F.greatest(span / 86400, F.lit(1.0))).alias("persistence_ratio"),
        "bytes_mean",
        _ratio(F.col("_bstd"), F.col("bytes_mean")).alias("bytes_cv"),
        F.when(F.col("bytes_mean") > 0, F.col("_asym")).alias("req_resp_asymmetry"),
        "zero_payload_frac",
        (_ratio(F.col("_dstd"), F.col("_dmean")) if has["duration"] else F.lit(None).cast("double")).alias("duration_cv"),
        F.coalesce("_entropy", F.lit(0.0)).alias("conn_state_entropy"),
        "sin_time_mean",
        "cos_time_mean",
        "first_seen",
        "last_seen",
        "scenario",
    )


def fit_scaler(channels: DataFrame, features: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
    """One row with the mean and population deviation of every feature."""
    have = [c for c in features if c in channels.columns]
    return channels.agg(*[f(F.coalesce(F.col(c), F.lit(0.0))).alias(f"{n}_{c}") for c in have for n, f in (("_mu", F.avg), ("_sd", F.stddev_pop))])


def standard_scale(channels: DataFrame, features: tuple[str, ...] = MODEL_FEATURES, scaler: DataFrame | None = None) -> DataFrame:
    """Adds ``<feature>_stdz``; missing values count as 0 and a feature that does not vary scales to 0."""
    have = [c for c in features if c in channels.columns]
    scaler = fit_scaler(channels, features) if scaler is None else scaler
    joined = channels.join(F.broadcast(scaler))
    scaled = {f"{c}_stdz": F.when(F.col(f"_sd_{c}") > 0, (F.coalesce(F.col(c), F.lit(0.0)) - F.col(f"_mu_{c}")) / F.col(f"_sd_{c}")).otherwise(F.lit(0.0)) for c in have}
    return joined.withColumns(scaled).drop(*scaler.columns)
