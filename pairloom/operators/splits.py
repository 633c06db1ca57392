"""Reproducible splits: repeated k-fold, and train / validation / test by shares.

Membership depends on (seed, row key) through a digest, never on partitioning or on the
order of arrival.  Sizes follow the usual rules exactly; which rows fall where differs
from a NumPy permutation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.constants import (
    HOLDOUT_SHARE,
    NUM_FOLDS,
    SEEDS,
    TEST_SHARE_OF_HOLDOUT,
    TRAIN_SHARE,
)
from pairloom.operators.ranks import (
    hash_bucket,
    hash_key,
    place_by_cuts,
    rank_cuts,
    with_ordinal_bucket,
)
from pairloom.session import staged


def _seeded(df: DataFrame, key: str, seeds: Sequence[int]) -> DataFrame:
    """Every row once per seed, with its sort key.

    The digest comes out of the generator, so that filters and joins on its bucket do not
    compute it again.
    """
    per_seed = [
        F.struct(F.lit(s).alias("seed"), hash_key(F.lit(s), F.col(key)).alias("__hash"))
        for s in seeds
    ]
    hashed = df.select("*", F.inline(F.array(*per_seed)))
    return hashed.withColumn("__bucket", hash_bucket(F.col("__hash")))


def _fold_starts(n: Column, k: int) -> Column:
    """First rank of folds 1 .. k-1; the first n % k folds are one row larger."""
    small = F.floor(n / k)
    return F.array(
        *[i * small + F.least(F.lit(i).cast("bigint"), n % k) for i in range(1, k)]
    )


def kfold_cuts(
    rows: DataFrame, key: str, seeds: Sequence[int] = SEEDS, k: int = NUM_FOLDS
) -> DataFrame:
    """Where the folds of every seed begin: one row per seed.  Only the key is looked at."""
    if k < 2:
        raise ValueError("k must be at least 2")
    order = ["__hash", key]
    source = _seeded(rows.select(key), key, seeds)
    return rank_cuts(source, ["seed"], order, "__bucket", lambda n: _fold_starts(n, k))


def kfold_split(
    df: DataFrame,
    key: str,
    seeds: Sequence[int] = SEEDS,
    k: int = NUM_FOLDS,
    population: DataFrame | None = None,
    cuts: DataFrame | None = None,
) -> DataFrame:
    """Every row once per seed, with the ``fold`` in which it is a test row.

    The cut points come from ``population``: the same rows with nothing but the key, where
    ``df`` carries columns that are costly to compute.  ``cuts``: its :func:`kfold_cuts` where
    they are there already.
    """
    order = ["__hash", key]
    if cuts is None:
        cuts = kfold_cuts(df if population is None else population, key, seeds, k)
    placed = place_by_cuts(_seeded(df, key, seeds), cuts, ["seed"], order, "fold", k - 1)
    return placed.drop("__hash", "__bucket")


def kfold_train_val(
    df: DataFrame,
    key: str,
    ordinal: str,
    seeds: Sequence[int] = SEEDS,
    k: int = NUM_FOLDS,
    train_share: float = TRAIN_SHARE,
    population: DataFrame | None = None,
) -> DataFrame:
    """Train / validation / test membership for every (seed, fold).

    Validation is the tail of the non-test rows in corpus order (``ordinal``), not a
    random share of them.  ``population``: see ``kfold_split``; it needs both columns.  The cut
    points of the folds are written once (:func:`pairloom.session.staged`).
    """
    rows = df if population is None else population
    folds = staged(kfold_cuts(rows, key, seeds, k), "folds")
    order = [ordinal] if key == ordinal else [ordinal, key]
    run = ["seed", "fold"]

    def per_run(table: DataFrame) -> DataFrame:
        members = kfold_split(table, key, seeds, k, cuts=folds)
        return members.withColumnRenamed("fold", "__test_fold").withColumn(
            "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        )

    is_test = F.col("__test_fold") == F.col("fold")
    bare = rows.select(*dict.fromkeys([key, ordinal]))
    ranged = with_ordinal_bucket(bare, ordinal, "__range")
    cuts = rank_cuts(
        per_run(ranged).where(~is_test),
        run,
        order,
        "__range",
        lambda n: F.array((n * F.lit(train_share)).cast("bigint")),
    )
    placed = place_by_cuts(per_run(df), cuts, run, order, "__passed")
    split = (
        F.when(is_test, "test").when(F.col("__passed") == 0, "train").otherwise("val")
    )
    return placed.withColumn("split", split).drop("__passed", "__test_fold")


def split_by_shares(
    df: DataFrame,
    key: str,
    seed: int,
    holdout_share: float = HOLDOUT_SHARE,
    test_share: float = TEST_SHARE_OF_HOLDOUT,
) -> DataFrame:
    """Hold out a share of the rows, and a share of these for the test.

    Held-out and test sizes round up.  One uniform ranking with two cuts: the test rows come
    first, then validation, then training.
    """
    rows = _seeded(df, key, [seed])
    order = ["__hash", key]

    def ranks(n: Column) -> Column:
        held = F.ceil(n * F.lit(holdout_share))
        return F.array(F.ceil(held * F.lit(test_share)), held)

    cuts = rank_cuts(rows, ["seed"], order, "__bucket", ranks, size="__n")
    joined = rows.join(F.broadcast(cuts), "seed", "left")
    here = F.struct(*order)
    # no cut is reached: all rows are test rows; no row beyond the held-out ones: none trains
    in_test = F.col("cuts").isNull() | (here < F.get("cuts", F.lit(0)))
    all_held = F.ceil(F.col("__n") * F.lit(holdout_share)) >= F.col("__n")
    in_val = all_held | (here < F.element_at("cuts", -1))
    split = F.when(in_test, "test").when(in_val, "val").otherwise("train")
    return joined.withColumn("split", split).drop("__hash", "__bucket", "cuts", "__n", "seed")


def split_sizes(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"))


def select_by_index(df: DataFrame, index: DataFrame, ordinal: str) -> DataFrame:
    """Rows whose ordinal is in ``index``; Spark sizes the two sides itself."""
    return df.join(index.select(ordinal), ordinal, "left_semi")
