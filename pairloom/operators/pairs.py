"""Pairing by key, exact dedup, merging of sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_last_wins(
    df: DataFrame,
    keys: Sequence[str],
    category: str,
    value: Column,
    ordinal: Column,
    slots: dict[str, str],
) -> DataFrame:
    """One row per key with the last value of each category.

    ``slots`` maps category -> output column.  A later null overwrites an earlier value:
    ``max_by`` skips rows without an ordinal, not rows without a value.  One shuffle, and
    the partial aggregation leaves at most one row per key and task, so a key that holds a
    large part of the table does not travel whole to one reducer.
    """
    wanted = df.where(F.col(category).isin(*slots))
    picks = [
        F.max_by(
            F.when(F.col(category) == name, value), F.when(F.col(category) == name, ordinal)
        ).alias(out)
        for name, out in slots.items()
    ]
    return wanted.groupBy(*keys).agg(*picks)


def pair_digest(columns: Sequence[str]) -> Column:
    """Digest of the dedup key.  Lengths stand before the values, so no two keys read alike."""
    parts = [
        F.coalesce(F.concat(F.length(c), F.lit(":"), F.col(c)), F.lit("-")) for c in columns
    ]
    return F.sha2(F.concat(*parts), 256)


def dedup_keep_first(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    digest: Column | None = None,
) -> DataFrame:
    """Keep the first row, by ``order``, of every distinct key.

    The digest leads the sort so that most comparisons end early; the key columns follow
    it because equality is on the text.  The rank filter is pushed below the shuffle
    (one surviving row per key and task), which is also what keeps hot keys small.
    ``digest``: the keys' :func:`pair_digest` where it is known already.
    """
    ranked = df.withColumn("__digest", pair_digest(keys) if digest is None else digest).withColumn(
        "__rank",
        F.row_number().over(Window.partitionBy("__digest", *keys).orderBy(*order)),
    )
    return ranked.where("__rank = 1").drop("__digest", "__rank")


def merge_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column some source lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
