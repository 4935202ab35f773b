"""``python -m tidewatch --input conn.csv [--dns f] [--http f] [--ssl f] [--config f] [--output folder]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidewatch.config import Settings
from tidewatch.engine import Engine
from tidewatch.report import analyst_brief, write_report
from tidewatch.sources import logs


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidewatch")
    p.add_argument("--input", required=True)
    for name in ("--dns", "--http", "--ssl", "--config"):
        p.add_argument(name)
    p.add_argument("--output", default="output")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tidewatch").getOrCreate()
    engine = Engine(spark, Settings.from_json(a.config) if a.config else None)
    read = lambda f, path: f(spark, path) if path else None
    art = engine.run(engine.load(a.input), read(logs.read_dns, a.dns), read(logs.read_http, a.http), read(logs.read_ssl, a.ssl))
    print(analyst_brief(art.leads))
    print(write_report(art, a.output))


if __name__ == "__main__":
    main()
