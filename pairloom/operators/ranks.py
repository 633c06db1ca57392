"""Exact ranks over a whole table without a one-task sort.

``row_number()`` over no partition runs in one task.  Here rows are put into ordered
buckets, bucket sizes give every bucket its first rank, and only rows inside a bucket are
sorted.  Where a split needs just a few cut points, only the buckets that hold a cut are
sorted at all, and the answer is a handful of key values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Leading hex digits of a digest used as bucket: 16 ** 3 = 4,096 buckets per group.
HASH_BUCKET_DIGITS = 3
# Ordinal buckets: ranges of equal width, the fuller ones cut again, level by level.
ORDINAL_RANGES = 4096
LEVELS = 3


def hash_key(seed: Column, key: Column) -> Column:
    """Pseudo-random sort key of a row under a seed; does not depend on partitioning."""
    return F.md5(F.concat(seed.cast("string"), F.lit("|"), key.cast("string")))


def hash_bucket(digest: Column, digits: int = HASH_BUCKET_DIGITS) -> Column:
    return F.substring(digest, 1, digits)


def with_ordinal_bucket(
    df: DataFrame,
    ordinal: str,
    out: str,
    tie: Sequence[str] = (),
    ranges: int = ORDINAL_RANGES,
    population: DataFrame | None = None,
) -> DataFrame:
    """Number the rows' value ranges, in order, so that no bucket holds many rows.

    The span between the least and the greatest ordinal is cut into ``ranges`` of equal width.
    Each of them is cut again, into as many parts as its share of the rows asks for, between
    its own least and greatest ordinal; and once more.  Where all ordinals of a range are equal
    the ``tie`` columns cut it, by their hash: order such rows by :func:`tie_order`.

    Bounds are exact aggregates, so every plan that uses them puts a row into the same
    bucket, and nothing runs while the plan is made.  A level has at most ``LEVELS`` x ``ranges``
    rows, whatever the table, which is what may be broadcast.  ``population`` stands for the
    table in these aggregates: the same rows with nothing but the columns named here.
    """
    source = df if population is None else population
    slim = source.select(*dict.fromkeys([ordinal, *tie]))
    whole = slim.agg(_span(ordinal).alias("s"))
    bounds: list[DataFrame] = []
    for _ in range(LEVELS - 1):
        placed = _placed(slim, ordinal, tie, whole, bounds, ranges)
        bounds.append(placed.groupBy("__b").agg(_span(ordinal).alias("__s")))
    return _placed(df, ordinal, tie, whole, bounds, ranges).withColumnRenamed("__b", out)


def _span(ordinal: str) -> Column:
    x = F.col(ordinal).cast("double")
    return F.struct(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))


def _placed(
    df: DataFrame,
    ordinal: str,
    tie: Sequence[str],
    whole: DataFrame,
    bounds: Sequence[DataFrame],
    ranges: int,
) -> DataFrame:
    """``__b``: the number of a row's bucket after as many levels as there are bounds, plus one."""
    x = F.col(ordinal).cast("double")
    all_rows = whole.scalar()

    def part(span: Column, parts: Column) -> Column:
        along = (x - span["low"]) / (span["high"] - span["low"])
        share = F.when(span["high"] > span["low"], along).otherwise(_spread(tie))
        at = F.least(F.floor(share * parts), parts - 1)
        return F.coalesce(F.greatest(at, F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))

    # rows without an ordinal come first, in a bucket of their own
    number = F.when(x.isNull(), F.lit(-1).cast("bigint"))
    out = df.withColumn("__b", number.otherwise(part(all_rows, F.lit(ranges).cast("bigint"))))
    for bound in bounds:
        joined = out.join(F.broadcast(bound), "__b", "left")
        share = F.ceil(F.col("__s.n") * ranges / all_rows["n"])
        parts = F.coalesce(F.least(F.greatest(share, F.lit(1)), F.lit(ranges)), F.lit(1)).cast("bigint")
        out = joined.withColumn("__b", F.col("__b") * (ranges + 1) + part(F.col("__s"), parts)).drop("__s")
    return out


def _spread(tie: Sequence[str]) -> Column:
    """A number in [0, 1) that grows with :func:`tie_order`."""
    if not tie:
        return F.lit(0.0)
    return F.shiftrightunsigned(F.xxhash64(*tie), 1).cast("double") / float(2**63)


def tie_order(tie: Sequence[str]) -> list[Column]:
    """Sort columns for rows of equal ordinals."""
    return [F.shiftrightunsigned(F.xxhash64(*tie), 1), *map(F.col, tie)] if tie else []


def _bucket_spans(df: DataFrame, group: Sequence[str], bucket: str) -> DataFrame:
    """First rank and size of every bucket, and the size of its group.

    One row per group and bucket: as many as there are buckets, whatever the table size.
    """
    sizes = df.groupBy(*group, bucket).agg(F.count("*").alias("__size"))
    within = Window.partitionBy(*group)
    before = F.sum("__size").over(
        within.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    return sizes.select(
        *group,
        bucket,
        "__size",
        F.coalesce(before, F.lit(0)).alias("__start"),
        F.sum("__size").over(within).alias("__n"),
    )


def rank_cuts(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    bucket: str,
    ranks: Callable[[Column], Column],
    out: str = "cuts",
    size: str | None = None,
) -> DataFrame:
    """Sort-key values at chosen ranks: one row per group, ``cuts`` sorted; equal ranks give
    one cut.  ``size`` names a column for the number of rows of the group.

    ``ranks(n)`` gives the 0-based ranks (an array) for a group of n rows; a rank the group
    does not reach has no cut.  ``place_by_cuts`` then tells for any row how many cuts it
    has passed.  Only buckets containing a wanted rank are shuffled and sorted.
    """
    group, order = list(group), list(order)
    spans = _bucket_spans(df, group, bucket).withColumn("__rank", F.explode(ranks(F.col("__n"))))
    holding = spans.where(
        (F.col("__rank") >= F.col("__start"))
        & (F.col("__rank") < F.col("__start") + F.col("__size"))
    )
    targets = holding.groupBy(*group, bucket).agg(
        F.min("__start").alias("__start"),
        F.collect_set("__rank").alias("__ranks"),
        F.first("__n").alias("__n"),
    )
    # as many rows as there are cuts, so broadcasting it has a fixed bound
    inside = df.select(*group, bucket, *order).join(F.broadcast(targets), [*group, bucket])
    ranked = inside.withColumn(
        "__at",
        F.col("__start")
        + F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order))
        - 1,
    )
    cuts = ranked.where(F.array_contains("__ranks", F.col("__at")))
    found = [F.sort_array(F.collect_list(F.struct(*order))).alias(out)]
    return cuts.groupBy(*group).agg(*found, *([F.first("__n").alias(size)] if size else []))


def place_by_cuts(
    df: DataFrame,
    cuts: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    out: str,
    n_cuts: int = 1,
) -> DataFrame:
    """Number of cuts at or before each row (0 = before the first cut).

    ``cuts`` has one small row per group, so it is broadcast.  The comparisons are written
    out one by one: as plain expressions they are compiled, a lambda would not be.
    """
    key = F.struct(*order)
    joined = df.join(F.broadcast(cuts), list(group), "left")
    passed = F.lit(0)
    for i in range(n_cuts):
        passed = passed + F.when(F.get(F.col("cuts"), F.lit(i)) <= key, 1).otherwise(0)
    return joined.withColumn(out, passed).drop("cuts")


def global_rank(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], bucket: str, out: str
) -> DataFrame:
    """0-based rank of every row in its group, as ``row_number() - 1`` would give it."""
    group = list(group)
    spans = _bucket_spans(df, group, bucket).select(*group, bucket, "__start")
    within = Window.partitionBy(*group, bucket).orderBy(*order)
    ranked = df.withColumn("__place", F.row_number().over(within))
    # Without a group there is one row per bucket, a fixed number; how many groups there are
    # is not known here, so with groups Spark sizes the table itself.
    joined = ranked.join(spans if group else F.broadcast(spans), [*group, bucket])
    return joined.withColumn(out, F.col("__start") + F.col("__place") - 1).drop(
        "__start", "__place"
    )
