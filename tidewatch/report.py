"""Plot data, text briefs and a self-contained HTML report of the leads."""

from __future__ import annotations

import html
import time
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.engine import Artifacts, funnel_counts
from tidewatch.sources import logs, synth


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n): rows by equal bins of [lo, hi]; 0 and bins + 1 hold what lies outside."""
    width = (hi - lo) / bins
    v = F.col(value)
    at = F.when(v < lo, 0).when(v >= hi, bins + 1).otherwise(F.floor((v - lo) / width).cast("int") + 1)
    return df.where(v.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def hypothesis_pass_rates(corroborated: DataFrame) -> DataFrame:
    """(hypothesis, passed, total)."""
    flags = ["h1_dns_regularity", "h2_dns_anomaly", "h3_http_consistency", "h4_evasion_indicators", "h5_tls_consistency", "h6_tls_anomaly"]
    wide = corroborated.agg(F.count("*").alias("total"), *[F.count_if(c).alias(c) for c in flags])
    return wide.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("hypothesis"), F.col(c).alias("passed")) for c in flags])).alias("x")).select("x.hypothesis", "x.passed", "total")


def even_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n): rows by equal bins from the least to the greatest value; the last bin holds the greatest."""
    ends = df.agg(F.min(value).cast("double").alias("_a"), F.max(value).cast("double").alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_a")) / width))).otherwise(F.lit(0)).cast("int")
    counts = df.where(F.col(value).isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin"), "_a", width.alias("_w")).agg(F.count("*").alias("n"))
    return counts.select("bin", (F.col("_a") + F.col("bin") * F.col("_w")).alias("lo"), (F.col("_a") + (F.col("bin") + 1) * F.col("_w")).alias("hi"), "n")


def score_histogram(scored: DataFrame, value: str = "iforest_score", share: float = 0.05, bins: int = 60) -> DataFrame:
    """:func:`even_histogram` with the cutoff below which the lowest ``share`` of the scores lie."""
    return even_histogram(scored, value, bins).join(F.broadcast(scored.agg(F.percentile(value, F.lit(share)).alias("cutoff"))))


def confidence_bars(periodicity: DataFrame, entity: str = "pair_id", top: int | None = 50) -> DataFrame:
    """(rank, entity, beacon_confidence, is_beacon_pair), most confident first; ``top=None``: all, unranked."""
    rows = periodicity.select(entity, "beacon_confidence", "is_beacon_pair")
    if top is None:
        return rows
    best = rows.orderBy(F.desc("beacon_confidence"), entity).limit(top)
    return best.select(F.row_number().over(Window.orderBy(F.desc("beacon_confidence"), entity)).alias("rank"), entity, "beacon_confidence", "is_beacon_pair")


def period_histogram(periodicity: DataFrame, bins: int = 20) -> DataFrame:
    """:func:`even_histogram` of the beacons' periods in minutes."""
    return even_histogram(periodicity.where("is_beacon_pair AND dominant_period_s > 0").select((F.col("dominant_period_s") / 60).alias("minutes")), "minutes", bins)


def campaign_timeline(changes: DataFrame, *names: str) -> DataFrame:
    """(names, began, day, shifted) of all that have a start."""
    rows = changes.where(F.col("beacon_start_ts").isNotNull())
    return rows.select(*names, F.col("beacon_start_ts").alias("began"), F.substring("beacon_start_dt", 1, 10).alias("day"), F.col("has_interval_shift").alias("shifted"))


def evidence_points(corroborated: DataFrame) -> DataFrame:
    """What the panels of corroboration show of each pair."""
    return corroborated.select("pair_id", "beacon_confidence", "dns_score", "http_score", "tls_score", "corroboration_score", "corroborated")


def sax_points(screened: DataFrame, entity: str = "pair_id") -> DataFrame:
    """Observations, peak and motif share of each entity, and whether it passes."""
    return screened.select(entity, "n_observations", "sax_acf_peak", "sax_motif_fraction", "sax_passes")


def analyst_brief(leads: DataFrame, top: int = 5) -> str:
    rows = leads.orderBy("rank").limit(top).collect()
    out = [f"{len(rows)} leads"]
    for r in rows:
        out.append(f"{r['rank']}. {r['src_ip']} → {r['dst_ip']} every {r['period']} ({r['severity']}, confidence {r['beacon_confidence']:.2f}, corroboration {r['corroboration_score']:.2f})")
        out += [f"   - {t['technique_id']} {t['name']}: {t['evidence']}" for t in r["mitre_techniques"]]
        out += [f"   > {s}" for s in r["next_steps"]]
    return "\n".join(out)


def funnel_brief(counts: dict) -> str:
    return "\n".join(f"{k:>14}: {v:,}" for k, v in counts.items())


def prefilter_brief(removed: DataFrame) -> str:
    """How many channels each rule took out."""
    rows = removed.groupBy("prefilter_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefilter_reason").collect()
    return "\n".join([f"{sum(r.n for r in rows):,} channels taken out before scoring", *[f"{r.n:>12,}  {r.prefilter_reason}" for r in rows]])


def changepoint_brief(changes: DataFrame, top: int = 20) -> str:
    """Start and shifts of the beacons that began first."""
    rows = changes.orderBy(F.asc_nulls_last("beacon_start_ts"), "src_ip", "dst_ip").limit(top).collect()
    out = [f"Timing of {len(rows)} beacons"]
    for r in rows:
        out.append(f"{r['src_ip']} → {r['dst_ip']}: {'since ' + r['beacon_start_dt'] if r['beacon_start_dt'] else 'no start found'}")
        out += [f"   {x['old_period_s']:.0f} s became {x['new_period_s']:.0f} s ({x['delta_pct']:+.1f} %)" for x in r["interval_shifts"]]
    return "\n".join(out)


def technique_counts(leads: DataFrame) -> DataFrame:
    """(technique_id, name, leads): in how many leads each technique occurs."""
    return leads.select("src_ip", "dst_ip", F.explode("mitre_techniques").alias("t")).groupBy("t.technique_id", "t.name").agg(F.count_distinct("src_ip", "dst_ip").alias("leads"))


def technique_brief(leads: DataFrame) -> str:
    rows = technique_counts(leads).orderBy("technique_id").collect()
    return "\n".join([f"{len(rows)} techniques", *[f"{r.technique_id:>12}  {r.name} ({r.leads} leads)" for r in rows]])


def detection_brief(detected: DataFrame, labels: DataFrame, target: float = 0.75) -> str:
    """Each scenario found or missed, precision, recall and F1."""
    found = {r.scenario for r in synth.matches_truth(detected, labels).select("scenario").distinct().collect()}
    out = [f"{r.scenario:<28} {'malicious' if r.malicious else 'harmless':<10} {'found' if r.scenario in found else 'not found'}" for r in labels.orderBy("scenario").collect()]
    r = synth.evaluate(detected, labels).first()
    return "\n".join([*out, f"precision {r.precision:.3f}, recall {r.recall:.3f}, F1 {r.f1:.3f}; recall is {'at' if r.recall >= target else 'below'} the target of {target}"])


def _bars(rows: list[tuple], title: str) -> str:
    """A bar chart of (label, height, marked) as inline SVG."""
    top = max((h for _, h, _ in rows), default=0) or 1
    bars = "".join(f"<rect x='{10 * i}' y='{100 - 100 * h / top:.1f}' width='8' height='{100 * h / top:.1f}' fill='{'#b33' if m else '#47a'}'><title>{html.escape(str(x))}: {h}</title></rect>" for i, (x, h, m) in enumerate(rows))
    return f"<figure><figcaption>{html.escape(title)}</figcaption><svg viewBox='0 0 {max(10, 10 * len(rows))} 100' width='600' height='120' preserveAspectRatio='none'>{bars}</svg></figure>"


def charts(art: Artifacts) -> str:
    """The plot frames drawn; each has a bounded number of rows."""
    scores = score_histogram(art.scored).orderBy("bin").collect()
    best = confidence_bars(art.periodicity).orderBy("rank").collect()
    periods = period_histogram(art.periodicity).orderBy("bin").collect()
    rates = hypothesis_pass_rates(art.corroboration).orderBy("hypothesis").collect()
    days = campaign_timeline(art.changepoints).groupBy("day").agg(F.count("*").alias("n"), F.max("shifted").alias("shifted")).orderBy("day").limit(400).collect()
    return "".join(
        (
            _bars([(f"{r.lo:.3f}", r.n, r.hi <= r.cutoff) for r in scores], "Anomaly scores (marked: up to the cutoff)"), _bars([(r.pair_id, r.beacon_confidence, r.is_beacon_pair) for r in best], "Confidence of the first pairs (marked: beacons)"),
            _bars([(f"{r.lo:.1f} min", r.n, False) for r in periods], "Periods of beacons"), _bars([(r.hypothesis, r.passed, False) for r in rates], "Pairs that show each kind of evidence"), _bars([(r.day, r.n, r.shifted) for r in days], "Beacons by first day (marked: with a shift of the interval)"),
        )
    )


def write_report(art: Artifacts, folder: str, title: str = "Beacon leads", most_leads: int = 1000) -> str:
    """CSV folders, the run's summary and one HTML page with charts and leads.

    The CSV hold all rows and are linked.  The page lists the first ``most_leads`` leads and says so if there are more.
    """
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    began = time.time()
    links = []
    for name, df in (("priority", art.priority), ("periodicity", art.periodicity), ("changepoints", art.changepoints), ("corroboration", art.corroboration), ("sax_screening", art.sax), ("leads", art.leads)):
        logs.write_csv(df, str(out / name))
        links += [f'<a href="{name}/{f.name}">{name} ({i + 1})</a>' for i, f in enumerate(sorted((out / name).glob("*.csv")))]
    counts = logs.write_summary(funnel_counts(art), str(out / "run_summary.json"), runtime_s=round(time.time() - began, 1))
    total, leads = art.leads.count(), art.leads.orderBy("rank").limit(most_leads).collect()
    e = lambda x: html.escape(str(x))
    rows = "".join(f"<tr><td>{r['rank']}</td><td>{e(r['src_ip'])} → {e(r['dst_ip'])}</td><td>{e(r['period'])}</td><td>{r['severity']}</td><td>{r['beacon_confidence']:.2f}</td><td>{r['corroboration_score']:.2f}</td></tr>" for r in leads)
    cards = "".join(
        f"<section><h3>{e(r['src_ip'])} → {e(r['dst_ip'])}</h3><p>DNS {r['dns_score']:.2f}, HTTP {r['http_score']:.2f}, TLS {r['tls_score']:.2f}; names: {e(', '.join(r['matched_domains'][:5])) or '-'}; agents: {e(', '.join(r['unique_user_agents'][:3])) or '-'}; server names: {e(', '.join(r['observed_snis'][:3])) or '-'}</p>"
        f"<ul>{''.join(f'<li>{e(t['technique_id'])} {e(t['name'])}: {e(t['evidence'])}</li>' for t in r['mitre_techniques'])}</ul><ol>{''.join(f'<li>{e(s)}</li>' for s in r['next_steps'])}</ol></section>"
        for r in leads
    )
    note = f"<p>The first {len(leads):,} of {total:,} leads; all are in the CSV.</p>" if total > len(leads) else ""
    briefs = "".join(f"<pre>{e(x)}</pre>" for x in (funnel_brief(counts), prefilter_brief(art.removed), changepoint_brief(art.changepoints), technique_brief(art.leads)))
    page = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}</h1>{briefs}<p>{' '.join(links)}</p>{charts(art)}{note}<table><tr><th>#</th><th>Pair</th><th>Period</th><th>Severity</th><th>Confidence</th><th>Score</th></tr>{rows or '<tr><td colspan=6>No leads</td></tr>'}</table>{cards}</body></html>"
    (out / "report.html").write_text(page)
    return str(out / "report.html")
