"""The beacon pipeline: every stage on its own, or all in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import Settings
from tidewatch.operators import anomaly, changepoint, corroborate, features, periodicity, prefilter, prepare, sax, triage
from tidewatch.runtime import cut
from tidewatch.sources import logs


@dataclass
class Artifacts:
    flows: DataFrame
    channels: DataFrame
    kept: DataFrame
    removed: DataFrame
    scored: DataFrame
    anomalies: DataFrame
    sax: DataFrame
    periodicity: DataFrame
    priority: DataFrame
    changepoints: DataFrame
    corroboration: DataFrame
    leads: DataFrame
    stability: DataFrame


class Engine:
    """``settings.parity == "reference"`` narrows the later stages to (source, destination) pairs."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None):
        self.spark, self.cfg = spark, settings or Settings()

    def load(self, path: str) -> DataFrame:
        return prepare.prepare(logs.normalize_schema(logs.scan_conn(self.spark, path)))

    def scale(self, flows: DataFrame) -> DataFrame:
        channels = features.aggregate_channels(flows, self.cfg.channels.min_flows, self.cfg.channels.key, self.cfg.parity)
        return features.standard_scale(channels)

    def prefilter(self, channels: DataFrame, flows: DataFrame) -> tuple[DataFrame, DataFrame]:
        p = self.cfg.prefilter
        return prefilter.apply_prefilter(channels, flows, fanin_threshold=p.dst_fanin_threshold, failed_threshold=p.failed_conn_threshold, least_kept=p.least_kept, parity=self.cfg.parity)

    def filter(self, channels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(all with score and label, those labelled -1)."""
        i = self.cfg.isolation
        scaled = [c for c in channels.columns if c.endswith("_stdz")]
        scored = anomaly.isolation_scores(channels, scaled, "channel_id", i.n_estimators, i.max_samples, i.random_state, i.contamination)
        scored = cut(anomaly.percentile_label(anomaly.small_pool_bypass(scored, small_pool=i.small_pool), contamination=i.contamination, small_pool=i.small_pool), "scored")
        return scored, scored.where("iforest_label = -1")

    def narrow(self, flows: DataFrame, anomalies: DataFrame) -> DataFrame:
        """The flows of anomalous pairs, with their pair id."""
        pairs = anomalies.select("src_ip", "dst_ip").distinct()
        return flows.join(pairs, ["src_ip", "dst_ip"], "left_semi").withColumn("pair_id", F.concat_ws("→", "src_ip", "dst_ip"))

    def sax_screen(self, flows: DataFrame) -> DataFrame:
        return sax.screen(flows, "pair_id", "timestamp", self.cfg)

    def periodicity(self, flows: DataFrame, gate: DataFrame | None = None) -> DataFrame:
        ids = flows.groupBy("pair_id").agg(F.first("src_ip").alias("src_ip"), F.first("dst_ip").alias("dst_ip"))
        return periodicity.score_channels(flows, "pair_id", "timestamp", self.cfg, gate).join(ids, "pair_id")

    def score(self, flows: DataFrame, scored: DataFrame | None = None) -> DataFrame:
        return triage.priority_score(flows, ["pair_id"], scored, self.cfg)

    def detect_changepoints(self, scored: DataFrame, flows: DataFrame) -> DataFrame:
        beacons = scored.where("is_beacon_pair").select("pair_id", "src_ip", "dst_ip", "dominant_period_s")
        found = changepoint.changepoints(flows.join(beacons.select("pair_id"), "pair_id", "left_semi"), "pair_id", "timestamp", self.cfg)
        return found.join(beacons, "pair_id")

    def corroborate(self, scored: DataFrame, flows: DataFrame, dns=None, http=None, ssl=None) -> DataFrame:
        counts = flows.groupBy("pair_id").agg(F.count("*").alias("flow_count"))
        candidates = scored.where("is_beacon_pair").select("pair_id", "src_ip", "dst_ip", "beacon_confidence", "dominant_period_s", "is_periodic").join(counts, "pair_id")
        return corroborate.corroborate(cut(candidates, "candidates"), dns, http, ssl, self.cfg)

    def annotate(self, corroborated: DataFrame, changes: DataFrame | None = None) -> DataFrame:
        """Shifts are joined first, except under parity, where the rule that needs them never fires."""
        if changes is not None and self.cfg.parity != "reference":
            corroborated = corroborated.join(changes.select("src_ip", "dst_ip", "n_changepoints", "beacon_start_dt", "has_interval_shift"), ["src_ip", "dst_ip"], "left")
        return triage.annotate(corroborated)

    def run(self, flows: DataFrame, dns: DataFrame | None = None, http: DataFrame | None = None, ssl: DataFrame | None = None) -> Artifacts:
        channels = cut(self.scale(flows), "channels")
        kept, removed = self.prefilter(channels, flows)
        scored, anomalies = self.filter(cut(kept, "kept"))
        stability = anomaly.split_stability(scored, "iforest_score", F.pmod(F.xxhash64("channel_id"), F.lit(10)) < 7)
        narrow = cut(self.narrow(flows, anomalies), "narrow")
        screened = cut(self.sax_screen(narrow), "sax")
        timed = cut(self.periodicity(narrow, screened), "periodicity")
        priority = self.score(narrow, timed)
        changes = cut(self.detect_changepoints(timed, narrow), "changes")
        found = cut(self.annotate(self.corroborate(timed, narrow, dns, http, ssl), changes), "corroboration")
        leads = triage.next_steps(triage.triage_leads(found, changes))
        return Artifacts(flows, channels, kept, removed, scored, anomalies, screened, timed, priority, changes, found, leads, stability)


def funnel_counts(art: Artifacts) -> DataFrame:
    """One row with the size of every stage."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(art.flows, "flows")
    parts = (
        (art.channels, "channels"), (art.kept, "kept"), (art.removed, "removed"), (art.anomalies, "anomalies"), (art.sax, "sax_evaluated"), (art.sax.where("sax_passes"), "sax_passed"),
        (art.periodicity.where("is_beacon_pair"), "beacons"), (art.corroboration, "candidates"), (art.corroboration.where("corroborated"), "corroborated"),
    )
    for df, name in parts:
        out = out.join(F.broadcast(n(df, name)))
    return out
