"""``python -m tidewatch.evaluate [--days 30] [--rows 30000] [--noisy 1000] [--output folder]``: generated telemetry through the whole engine, against its own truth."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidewatch.config import Channels, Isolation, Settings
from tidewatch.engine import Artifacts, Engine, funnel_counts
from tidewatch.operators import prepare
from tidewatch.report import analyst_brief, changepoint_brief, detection_brief, funnel_brief, prefilter_brief, technique_brief, write_report
from tidewatch.runtime import cut
from tidewatch.sources import synth


def run(spark: SparkSession, days: int = 30, rows: int = 30_000, noisy: int = 1000, seed: int = 42, settings: Settings | None = None) -> tuple[Artifacts, dict]:
    """The artifacts and the generated tables."""
    data = {k: cut(v, k) for k, v in synth.generate(spark, days=days, bg_rows_per_day=rows, noisy_rows_per_day=noisy, seed=seed).items()}
    cfg = settings or Settings(isolation=Isolation(contamination=0.10), channels=Channels(max_channels=500))
    return Engine(spark, cfg).run(prepare.prepare(data["conn"]), data["dns"], data["http"], data["ssl"]), data


def briefs(art: Artifacts, labels) -> str:
    found = art.corroboration.where("corroborated")
    return "\n\n".join((funnel_brief(funnel_counts(art).first().asDict()), prefilter_brief(art.removed), changepoint_brief(art.changepoints), technique_brief(art.leads), analyst_brief(art.leads), detection_brief(found, labels)))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidewatch.evaluate")
    for name, value in (("--days", 30), ("--rows", 30_000), ("--noisy", 1000), ("--seed", 42)):
        p.add_argument(name, type=int, default=value)
    p.add_argument("--output")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tidewatch-evaluate").getOrCreate()
    art, data = run(spark, a.days, a.rows, a.noisy, a.seed)
    print(briefs(art, data["labels"]))
    if a.output:
        print(write_report(art, a.output))


if __name__ == "__main__":
    main()
