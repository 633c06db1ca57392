"""Corpus build from the command line.

    spark-submit ... -m pairloom build SOURCE DESTINATION
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.plans.corpus_build import CorpusOptions, run_corpus_build
from pairloom.session import builder
from pairloom.sources.files import FILE_COLUMNS

READ_BATCH = "spark.sql.parquet.columnarReaderBatchSize"


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="pairloom")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="clean and merge dataset folders")
    build.add_argument("source", help="folder of dataset folders")
    build.add_argument("destination", help="folder for the corpus")
    build.add_argument("--batch-size", type=int, default=8192, help="Parquet rows per batch")
    build.add_argument("--unordered", action="store_true", help="leave the order of records open")
    build.add_argument("--grammar-habits", action="store_true", help="see the README")
    build.add_argument("--staging", help="shared folder for intermediate tables")
    return parser.parse_args(argv)


def _print_totals(kind: str, report: DataFrame | None) -> None:
    """Sums over all files; the row of each file is in the report table beside the corpus."""
    if report is not None:
        counters = [c for c in report.columns if c not in FILE_COLUMNS]
        sums = report.agg(*(F.sum(c).alias(c) for c in counters)).first()
        print(kind, *(f"{c}={sums[c] or 0}" for c in counters))


def main(argv: list[str] | None = None) -> int:
    args = _arguments(argv)
    spark = builder("pairloom").getOrCreate()
    spark.conf.set(READ_BATCH, args.batch_size)
    options = CorpusOptions(
        grammar_habits=args.grammar_habits, ordered=not args.unordered, staging=args.staging
    )
    try:
        report = run_corpus_build(spark, args.source, args.destination, options)
    except FileNotFoundError as error:
        print(error, file=sys.stderr)
        return 1
    if report.total_files == 0:
        print("nothing to read: no dataset folder holds Parquet or JSON lines")
        return 0
    print(f"files={report.total_files} staging={report.staging}")
    _print_totals("parquet", report.parquet_files)
    _print_totals("jsonl", report.jsonl_files)
    return 0


if __name__ == "__main__":
    sys.exit(main())
