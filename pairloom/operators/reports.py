"""Per-file counters of the corpus build."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_report(
    df: DataFrame, file: Sequence[str], digest: Column, file_order: Sequence[str] | None = None
) -> DataFrame:
    """Lines read, rows with both sides, unique rows written, duplicates - per file.

    ``digest`` identifies a complete pair and is null for every other line.  Files are
    read in ``file_order``, so a pair is written by the first file that holds it.
    Counting happens before each shuffle: lines are folded to one row per file and pair,
    and only these small rows meet in the window.
    """
    file = list(file)
    per_pair = (
        df.select(*file, digest.alias("__digest"))
        .groupBy(*file, "__digest")
        .agg(F.count("*").alias("__rows"))
    )
    # incomplete lines have no digest: each file's row is a group of its own, as the number of
    # files is not bounded.  The lines are read once for both kinds.
    both = F.col("__digest").isNotNull()
    alone = F.when(~both, F.struct(*file))
    place = F.row_number().over(
        Window.partitionBy("__digest", alone).orderBy(*(file_order or file))
    )
    report = (
        per_pair.withColumn("__place", place)
        .groupBy(*file)
        .agg(
            F.sum("__rows").alias("lines_read"),
            F.sum(F.when(both, F.col("__rows")).otherwise(0)).alias("with_both"),
            F.count_if(both & (F.col("__place") == 1)).alias("written"),
        )
    )
    return report.withColumn("duplicates", F.col("with_both") - F.col("written"))


def rows_per_file(df: DataFrame, file: Sequence[str]) -> DataFrame:
    return df.groupBy(*file).agg(F.count("*").alias("written"))


def files_processed(df: DataFrame, file: Sequence[str]) -> DataFrame:
    return df.select(*file).distinct().agg(F.count("*").alias("total_files"))


def with_all_files(report: DataFrame, listing: DataFrame, file: Sequence[str]) -> DataFrame:
    """The report with a row of zeros for every listed file it lacks."""
    counters = [c for c in report.columns if c not in file]
    joined = listing.select(*file).distinct().join(report, list(file), "left")
    return joined.select(*file, *(F.coalesce(c, F.lit(0)).alias(c) for c in counters))
