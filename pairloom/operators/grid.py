"""The run grid and the runs still to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.constants import MODEL_TYPES, NUM_FOLDS, SEEDS

RUN_KEYS = ("model_type", "seed", "fold")


def over_models(df: DataFrame, models: Sequence[str] = MODEL_TYPES) -> DataFrame:
    """Every row once per model; all models see the same splits."""
    return df.withColumn("model_type", F.explode(F.array(*[F.lit(m) for m in models])))


def run_grid(
    spark: SparkSession,
    models: Sequence[str] = MODEL_TYPES,
    seeds: Sequence[int] = SEEDS,
    k: int = NUM_FOLDS,
) -> DataFrame:
    one = spark.range(1)
    grid = over_models(one, models)
    grid = grid.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    grid = grid.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return grid.select(*RUN_KEYS)


def pending_runs(
    runs: DataFrame, done: DataFrame, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """Runs without finished output.  ``done`` may be a whole prediction table."""
    keys = list(keys)
    return runs.join(done.select(*keys).distinct(), keys, "left_anti")
