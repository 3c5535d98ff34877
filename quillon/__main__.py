"""Command line: python -m quillon --input FILE, FOLDER OR TEXT --out PATH [--save jsonl|json|parquet] [--conf FOLDER] [--pattern GLOB]."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from quillon.config import CONF, Settings
from quillon.plans.analyze import analyze, batch_summary, classify_folder
from quillon.sources import readers, sinks


def main(arguments: list[str] | None = None) -> int:
    """0 where something was analysed; 1 where files failed and none succeeded, and for input that can't be read."""
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--save", default="jsonl", choices=sorted(sinks.SINKS))
    p.add_argument("--conf", default=str(CONF))
    p.add_argument("--pattern", default="*")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    settings = Settings.load(a.conf)
    if not Path(a.input).is_dir():
        try:
            records = analyze(readers.route(spark, a.input), settings)
        except readers.IngestionError as e:
            print(f"{type(e).__name__}: {e}", file=sys.stderr)
            return 1
        sinks.sink({"format": a.save})(records, a.out)
        return 0
    records, failed = classify_folder(spark, a.input, a.pattern, settings)
    sinks.sink({"format": a.save})(records, a.out)
    sinks.failures(failed, f"{a.out.rstrip('/')}-errors.jsonl")
    row = batch_summary(records, failed).first()
    print(f"{row.processed} processed, {row.failed} failed: {row.gate}")
    return int(row.failed > 0 and row.processed == 0)


if __name__ == "__main__":
    sys.exit(main())
