"""Experiment tables: repeated cross-validation and the single 80/10/10 run.

Split membership is decided by a few broadcast cut points, so corpus text is labelled in
place: no text is shuffled between reading the corpus and writing predictions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from pairloom.constants import (
    INFERENCE_BATCH_SIZE,
    MAX_SEQ_LENGTH,
    MODEL_TYPES,
    NUM_FOLDS,
    SEEDS,
    SINGLE_RUN_SEED,
    SYSTEM_PROMPT,
)
from pairloom.functions.chat import (
    messages_by_model,
    messages_inference,
    messages_instructed,
    prompt_only,
    render_chat,
)
from pairloom.functions.text import extract_fenced_code
from pairloom.functions.tokens import attention_mask, encode_truncate
from pairloom.operators.batches import first_batches
from pairloom.operators.grid import RUN_KEYS, pending_runs, run_grid
from pairloom.operators.scoring import Scorer, prediction_records, score, score_by_run
from pairloom.operators.shape import computed_once
from pairloom.operators.splits import kfold_split, kfold_train_val, split_by_shares
from pairloom.session import checkpoint_dir
from pairloom.sources.sinks import RUN_SCHEMA, commit_runs, finished_runs, stage_predictions

SOURCE, TARGET = "c_code", "safe_rust_code"


def training_examples(
    members: DataFrame,
    keep: Sequence[str] = (),
    max_length: int = MAX_SEQ_LENGTH,
    encoder: Callable[[Column], Column] | None = None,
    system_prompt: str = SYSTEM_PROMPT,
) -> DataFrame:
    """Instructed messages -> chat text -> ids and mask; source columns are dropped."""
    text = render_chat(messages_instructed(F.col(SOURCE), F.col(TARGET), system_prompt))
    ids = encoder(text) if encoder else encode_truncate(text, max_length)
    encoded = computed_once(members, {"input_ids": ids})
    return encoded.select(
        *keep, "input_ids", attention_mask(F.col("input_ids")).alias("attention_mask")
    )


def prompts(members: DataFrame, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    messages = messages_by_model(
        F.col("model_type"), F.col(SOURCE), F.col(TARGET), system_prompt
    )
    return members.withColumn(
        "prompt", render_chat(prompt_only(messages), add_generation_prompt=True)
    )


def cross_validation_tests(
    corpus: DataFrame, runs: DataFrame, key: str, seeds: Sequence[int], k: int = NUM_FOLDS
) -> DataFrame:
    """Test rows of all the runs: one scan of the corpus, every row once per run that tests it.

    The cut points of the seeds come from the key column alone; ``runs`` is a part of the grid.
    """
    members = kfold_split(corpus, key, seeds, k, population=corpus.select(key))
    return members.join(F.broadcast(runs), ["seed", "fold"])


def run_cross_validation(
    spark: SparkSession,
    corpus: DataFrame,
    key: str,
    factory: Callable[[], Scorer],
    output: str,
    models: Sequence[str] = MODEL_TYPES,
    seeds: Sequence[int] = SEEDS,
    k: int = NUM_FOLDS,
    batch_size: int = INFERENCE_BATCH_SIZE,
    dry_run: bool = False,
) -> None:
    """Score the test rows of every run that has no output yet: one job, saved run by run.

    A run in which the model fails is not saved and is named in the error raised at the end;
    all others are, and the next call goes on with those that are missing.  Records keep the
    row's ``key`` as ``position``: sorted by it, the records of two models for one seed and fold
    stand side by side.  ``dry_run`` scores the first batch of each run only.
    """
    grid = run_grid(spark, models, seeds, k)
    runs = pending_runs(grid, finished_runs(spark, output)).orderBy(*RUN_KEYS).collect()
    if not runs:  # as many as models x seeds x folds
        return
    wanted = spark.createDataFrame(runs, RUN_SCHEMA)
    tests = cross_validation_tests(corpus, wanted, key, sorted({r["seed"] for r in runs}), k)
    _score_and_save(tests, key, factory, output, RUN_KEYS, runs, batch_size, dry_run)


def _score_and_save(
    tests: DataFrame,
    key: str,
    factory: Callable[[], Scorer],
    output: str,
    run_keys: Sequence[str],
    runs: Sequence[Row],
    batch_size: int,
    dry_run: bool,
) -> None:
    rows = first_batches(tests, run_keys, [key], batch_size) if dry_run else tests
    # rows of a run follow one another in each task, in the order of the key
    ready = prompts(rows).sortWithinPartitions(*run_keys, key)
    run = F.to_json(F.struct(*run_keys))
    scored = ready.withColumn("__s", score_by_run(F.col("prompt"), run, factory, batch_size))
    answered = scored.withColumn("answer", F.col("__s.answer")).withColumn("position", F.col(key))
    failures = {
        f"run_{i}": F.max(F.when(_is_run(r, run_keys), F.col("__s.error"))) for i, r in enumerate(runs)
    }
    seen = Observation()
    watched = answered.observe(seen, *(c.alias(name) for name, c in failures.items()))
    good = watched.where(F.col("__s.error").isNull())
    records = prediction_records(good, SOURCE, TARGET, "answer", [*run_keys, "position"])
    stage = stage_predictions(records, output, run_keys)
    found = [seen.get[name] for name in failures]
    commit_runs(tests.sparkSession, stage, output, [r for r, e in zip(runs, found) if e is None], run_keys)
    failed = [f"{r.asDict()}: {e}" for r, e in zip(runs, found) if e is not None]
    if failed:
        raise RuntimeError("runs that failed and were not saved: " + "; ".join(failed))


def _is_run(run: Row, run_keys: Sequence[str]) -> Column:
    same = [F.col(name) == F.lit(run[name]) for name in run_keys]
    return reduce(lambda a, b: a & b, same)


@dataclass
class TrainingTables:
    """Encoded rows, each stored once, and which run trains or validates on which of them."""

    encoded: DataFrame  # key, input_ids, attention_mask
    members: DataFrame  # key, split, and the run as partition columns seed, fold
    key: str

    def rows(self, *keep: str) -> DataFrame:
        """Training and validation rows of all runs; filters on the run reach the folders."""
        joined = self.members.join(self.encoded, self.key)
        return joined.select(*keep, "seed", "fold", "split", "input_ids", "attention_mask")

    def run(self, seed: int, fold: int, split: str) -> DataFrame:
        """Rows of one run and split."""
        wanted = (F.col("seed") == seed) & (F.col("fold") == fold) & (F.col("split") == split)
        return self.rows(self.key).where(wanted).select(self.key, "input_ids", "attention_mask")


def write_training_tables(
    corpus: DataFrame,
    key: str,
    ordinal: str,
    destination: str,
    seeds: Sequence[int] = SEEDS,
    k: int = NUM_FOLDS,
    encoder: Callable[[Column], Column] | None = None,
) -> TrainingTables:
    """Write ``<destination>/encoded`` and ``/members``: one encoding of every row, and a slim
    table of (key, split) for every seed and fold.  Only keys are scanned for the second."""
    spark, base = corpus.sparkSession, destination.rstrip("/")
    encoded = training_examples(corpus, [key], encoder=encoder)
    encoded.write.mode("overwrite").parquet(f"{base}/encoded")
    bare = corpus.select(*dict.fromkeys([key, ordinal]))
    members = kfold_train_val(bare, key, ordinal, seeds, k).where("split <> 'test'")
    slim = members.select(key, "split", "seed", "fold")
    slim.write.mode("overwrite").partitionBy("seed", "fold").parquet(f"{base}/members")
    return training_tables(spark, destination, key)


def training_tables(spark: SparkSession, destination: str, key: str) -> TrainingTables:
    base = destination.rstrip("/")
    read = spark.read.parquet
    return TrainingTables(read(f"{base}/encoded"), read(f"{base}/members"), key)


def cross_validation_training(
    corpus: DataFrame,
    key: str,
    ordinal: str,
    seeds: Sequence[int] = SEEDS,
    k: int = NUM_FOLDS,
    encoder: Callable[[Column], Column] | None = None,
    destination: str | None = None,
) -> DataFrame:
    """Encoded train and validation rows of every (seed, fold), from the two tables of
    :func:`write_training_tables` (by default below the shared folder of the session)."""
    folder = destination or f"{checkpoint_dir(corpus.sparkSession)}/training-{uuid.uuid4().hex}"
    return write_training_tables(corpus, key, ordinal, folder, seeds, k, encoder).rows()


def single_run_splits(
    corpus: DataFrame, key: str, seed: int = SINGLE_RUN_SEED
) -> DataFrame:
    return split_by_shares(corpus, key, seed)


def run_single(
    spark: SparkSession,
    corpus: DataFrame,
    key: str,
    factory: Callable[[], Scorer],
    output: str,
    seed: int = SINGLE_RUN_SEED,
    batch_size: int = INFERENCE_BATCH_SIZE,
    dry_run: bool = False,
) -> bool:
    """Score the test split under ``seed``; False where that was done before.  Records and
    ``dry_run`` are as in :func:`run_cross_validation`."""
    done = finished_runs(spark, output, "seed INT").where(F.col("seed") == seed)
    if not done.isEmpty():
        return False
    tests = single_run_splits(corpus, key, seed).where("split = 'test'")
    tests = tests.withColumn("model_type", F.lit("Proposed")).withColumn("seed", F.lit(seed))
    _score_and_save(tests, key, factory, output, ["seed"], [Row(seed=seed)], batch_size, dry_run)
    return True


def single_run_training(
    corpus: DataFrame,
    key: str,
    seed: int = SINGLE_RUN_SEED,
    encoder: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Encoded train and validation rows of the single run."""
    members = single_run_splits(corpus, key, seed).where("split <> 'test'")
    return training_examples(members, ["split"], encoder=encoder)


def translate(
    df: DataFrame,
    snippet: str,
    factory: Callable[[], Scorer],
    out: str = "translation",
    batch_size: int = INFERENCE_BATCH_SIZE,
) -> DataFrame:
    """Snippets -> prompts -> model -> code of the first fenced block."""
    prompt = render_chat(messages_inference(F.col(snippet)), add_generation_prompt=True)
    return df.withColumn(out, extract_fenced_code(score(prompt, factory, batch_size)))
