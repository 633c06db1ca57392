"""Corpus build over JSONL files that keep arriving.

Which pairs were seen is a table of digests beside the output, one part per micro-batch; a
batch is held against the parts before it.  So nothing is kept in memory between batches, a
batch that is run again gives the same output, and of equal pairs the first wins: in an
earlier batch, or earlier in source order within one.  Files that arrive in name order give the
corpus of the batch job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.filters import non_blank
from pairloom.plans.corpus_build import CorpusOptions, cleaned_lines, first_keys
from pairloom.sources.files import ORDER_COLUMNS, file_glob, file_system, path_or_none, path_part
from pairloom.sources.sinks import record_line

BATCH_DIGITS = 12


def stream_lines(spark: SparkSession, root: str, max_files_per_batch: int) -> DataFrame:
    raw = (
        spark.readStream.option("maxFilesPerTrigger", max_files_per_batch)
        .format("text")
        .load(file_glob(root, "jsonl"))
    )
    lines = raw.select(
        "value",
        path_part(-2).alias("folder"),
        path_part(-1).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    return non_blank(lines, "value")


def _part(number: int) -> str:
    """Name of a batch's part; parts in name order are batches in order."""
    return f"batch={number:0{BATCH_DIGITS}d}"


def seen_before(spark: SparkSession, seen: str, number: int) -> DataFrame | None:
    """Digests of all batches before this one."""
    found = path_or_none(lambda: spark.read.schema("digest STRING, batch BIGINT").parquet(seen))
    return None if found is None else found.where(F.col("batch") < number).select("digest")


def new_keys(spark: SparkSession, cleaned: DataFrame, seen: str, number: int) -> DataFrame:
    """Digest and place of the first record of every pair that no earlier batch had.

    The table of digests is the large side: it is only read past the batch's own digests, and what
    both have in common is no more than the batch.
    """
    own = first_keys(cleaned, "digest")
    known = seen_before(spark, seen, number)
    if known is None:
        return own
    again = known.join(own.select("digest"), "digest", "left_semi")
    return own.join(again, "digest", "left_anti")


def append_batch(
    batch: DataFrame, number: int, output: str, state: str, options: CorpusOptions
) -> None:
    """Write the new pairs of one micro-batch and the digests that go with them.

    Parts are overwritten, so a batch that failed half way is made good when it runs again.
    """
    spark = batch.sparkSession
    ordered = batch.withColumn("row", F.monotonically_increasing_id())
    stage = f"{state}/_batch-{uuid.uuid4().hex}"
    cleaned_lines(ordered, options).where(F.col("digest").isNotNull()).write.parquet(stage)
    cleaned = spark.read.parquet(stage)
    seen = f"{state}/seen"
    keys = new_keys(spark, cleaned, seen, number)
    mine = f"{seen}/{_part(number)}"
    keys.write.mode("overwrite").parquet(mine)
    fresh = spark.read.parquet(mine).select(*ORDER_COLUMNS)
    lines = record_line(cleaned.join(fresh, list(ORDER_COLUMNS), "left_semi"), *ORDER_COLUMNS)
    lines = lines.sortWithinPartitions(*ORDER_COLUMNS).select("value")
    lines.write.mode("overwrite").text(f"{output}/{_part(number)}")
    folder, files = file_system(spark, stage)
    files.delete(folder, True)


def start_corpus_stream(
    spark: SparkSession,
    root: str,
    output: str,
    checkpoint: str,
    options: CorpusOptions | None = None,
    max_files_per_batch: int = 1000,
) -> StreamingQuery:
    """Append the corpus lines of all files not yet processed, then stop.

    Every micro-batch is a folder of ``output``; the digests are in ``<checkpoint>/pairs``, beside
    the progress of the stream itself.
    """
    chosen, state = options or CorpusOptions(), f"{checkpoint.rstrip('/')}/pairs"
    target = output.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        append_batch(batch, number, target, state, chosen)

    return (
        stream_lines(spark, root, max_files_per_batch)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{checkpoint.rstrip('/')}/progress")
        .trigger(availableNow=True)
        .start()
    )
