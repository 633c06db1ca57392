"""Positions of records in source order, decided on their keys alone.

A record is known by its chunk - the file, the block of it that one task read, and for records
ordered by name the beginning of the name - and by its place in the chunk.  Chunks are as
small as a block of a file, so what belongs to one fits in a task, and counting them gives
every chunk its first position.  Text is moved once, to its chunk; nothing is sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.arrays import running_total

FILE = ("folder", "file")
CHUNK = (*FILE, "block", "part")
PLACE = ("row", "task_order")
# Characters of the name that chunks of named records share.
PART_LETTERS = 2


def first_positions(
    counts: DataFrame,
    size: str,
    within: Sequence[str],
    file_order: Sequence[Column] = (),
    out: str = "first",
) -> DataFrame:
    """``counts`` (one row per chunk) with the number of records in all chunks before.

    Chunks are summed up file by file; one number per file is gathered to place the files,
    in ``file_order`` and then by name.
    """
    own = Window.partitionBy(*FILE).orderBy(*within)
    before = F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, -1))
    chunks = counts.withColumn("__before", F.coalesce(before, F.lit(0)))
    ordered = [c.alias(f"__o{i}") for i, c in enumerate(file_order)]
    files = counts.groupBy(*FILE).agg(F.sum(size).alias("__n"))
    listed = files.select(F.struct(*ordered, *FILE, "__n").alias("f"))
    gathered = listed.agg(F.sort_array(F.collect_list("f")).alias("f")).select(
        "f", running_total(F.transform("f", lambda x: x["__n"]), "bigint").alias("ends")
    )
    starts = gathered.select(F.inline(F.arrays_zip("f", "ends"))).select(
        "f.folder", "f.file", (F.col("ends") - F.col("f.__n")).alias("__file_start")
    )
    joined = chunks.join(starts, list(FILE))
    return joined.withColumn(out, F.col("__file_start") + F.col("__before")).drop("__file_start", "__before")


def with_part(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.substring("task_order", 1, PART_LETTERS))


def positions(keys: DataFrame) -> DataFrame:
    """``keys`` (chunk and place of every record that is kept) with ``position``, from 0, and
    ``first``, that of the chunk."""
    counts = keys.groupBy(*CHUNK).agg(F.count("*").alias("__size"))
    starts = first_positions(counts, "__size", ["block", "part"]).drop("__size")
    place = F.row_number().over(Window.partitionBy(*CHUNK).orderBy(*PLACE))
    ranked = keys.withColumn("__place", place).join(starts, list(CHUNK))
    return ranked.withColumn("position", F.col("first") + F.col("__place") - 1).drop("__place")


def in_order(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose chunk and place are among ``keys``, with ``position`` and ``first``.

    Positions travel to the chunks along with the rows: in the order of a chunk each stands
    right before its row, so one look back brings both together, and rows without one (later
    copies) go.  The result is spread by chunk, and each chunk is in order.
    """
    at = [*CHUNK, *PLACE]
    marks = positions(with_part(keys)).select(
        *at, F.lit(0).alias("__kind"), F.struct(*PLACE, "position", "first").alias("__mark")
    )
    both = with_part(rows).withColumn("__kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    own = Window.partitionBy(*CHUNK).orderBy(*PLACE, "__kind")
    mark = F.lag("__mark").over(own)
    found = both.withColumn("__mark", mark).where("__kind = 1 AND __mark IS NOT NULL")
    same = [F.col(f"__mark.{c}") == F.col(c) for c in PLACE]
    return (
        found.where(same[0] & same[1])
        .withColumns({"position": F.col("__mark.position"), "first": F.col("__mark.first")})
        .drop("__mark", "__kind", "part")
    )
