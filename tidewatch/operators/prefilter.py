"""Removing channels of known-benign infrastructure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expr import CDN_PREFIXES, DNS_RESOLVERS, FAILED_STATES, INFRASTRUCTURE_PORTS, NTP_SERVERS, in_prefixes, is_internal, resolve


def destination_fanin(flows: DataFrame, src: str = "src_ip", dst: str = "dst_ip") -> DataFrame:
    """(dst, n_sources, fanin): the share of all sources that reach a destination."""
    pairs = flows.select(src, dst).distinct()
    total = pairs.agg(F.count_distinct(src).alias("_all"))
    per = pairs.where(F.col(dst).isNotNull()).groupBy(dst).agg(F.count(src).alias("n_sources"))
    return per.join(F.broadcast(total)).select(dst, "n_sources", (F.col("n_sources") / F.col("_all")).alias("fanin"))


def state_ratio(flows: DataFrame, src: str = "src_ip", dst: str = "dst_ip", state: str = "conn_state") -> DataFrame:
    """(src, dst, n, failed_ratio)."""
    failed = F.avg(F.when(F.col(state).isin(*FAILED_STATES), 1.0).otherwise(0.0))
    return flows.groupBy(src, dst).agg(F.count("*").alias("n"), failed.alias("failed_ratio"))


def breakdown(removed: DataFrame) -> DataFrame:
    return removed.groupBy("prefilter_reason").agg(F.count("*").alias("n"))


def classify(
    channels: DataFrame, flows: DataFrame, fanin_threshold: float = 0.5, failed_threshold: float = 0.9, allowlist: tuple[str, ...] = (), cdn_prefixes: tuple[str, ...] = CDN_PREFIXES, least_kept: float = 0.05, parity: str = "documented"
) -> DataFrame:
    """Adds ``prefilter_reason``, the first rule that holds, or null.

    If the rules would leave less than ``least_kept`` of the channels, the fan-in rule is left out.  Whether
    they would is a one-row aggregate; nothing is decided on the driver.
    """
    high = destination_fanin(flows).where(F.col("fanin") > fanin_threshold).select("dst_ip", F.lit(True).alias("_high"))
    out = channels.join(high, "dst_ip", "left")
    if "conn_state" in flows.columns and parity != "reference":
        dead = state_ratio(flows).where(F.col("failed_ratio") >= failed_threshold).select("src_ip", "dst_ip", F.lit(True).alias("_dead"))
        out = out.join(dead, ["src_ip", "dst_ip"], "left")
    else:
        out = out.withColumn("_dead", F.lit(None).cast("boolean"))
    names = ("dst_port", "destination.port", "id.resp_p", "dst_port_mode") if parity == "reference" else ("dst_port", "destination.port", "id.resp_p", "dst_port_mode", "dst_p")
    port = resolve(channels, *names)

    def reason(with_fanin: bool):
        r = F.when(is_internal("src_ip") & is_internal("dst_ip"), "both_internal")
        r = r.when(F.col("dst_ip").isin(*DNS_RESOLVERS), "known_dns_resolver").when(F.col("dst_ip").isin(*NTP_SERVERS), "known_ntp")
        if port:
            r = r.when(F.col(port).cast("int").isin(*INFRASTRUCTURE_PORTS) & is_internal("dst_ip"), "infrastructure_port_internal")
        r = r.when(in_prefixes("dst_ip", cdn_prefixes), "known_cdn")
        if with_fanin:
            r = r.when(F.col("_high"), "high_fanin_destination")
        r = r.when(F.col("_dead"), "dead_pair_failed_conns")
        return r.when(F.col("dst_ip").isin(*allowlist), "custom_allowlist") if allowlist else r

    out = out.withColumns({"_full": reason(True), "_rest": reason(False)})
    valve = out.agg(F.coalesce(F.avg(F.col("_full").isNull().cast("double")) < least_kept, F.lit(False)).alias("_open"))
    out = out.join(F.broadcast(valve)).withColumn("prefilter_reason", F.when(F.col("_open"), F.col("_rest")).otherwise(F.col("_full")))
    return out.drop("_high", "_dead", "_full", "_rest", "_open")


def apply_prefilter(channels: DataFrame, flows: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(kept, removed)."""
    tagged = classify(channels, flows, **options)
    return tagged.where("prefilter_reason IS NULL").drop("prefilter_reason"), tagged.where("prefilter_reason IS NOT NULL")
