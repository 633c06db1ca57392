"""The places where the caller's Python runs: tokenizers and models.

Both are given as factories.  A factory is called once per task, on the executor, so a
model is loaded once and not shipped with the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.constants import INFERENCE_BATCH_SIZE, MAX_SEQ_LENGTH
from pairloom.functions.text import strip_whitespace

Scorer = Callable[[list[str]], Sequence[str]]
Encoder = Callable[[list[str]], Sequence[Sequence[int]]]


def _batch_caller(size: int) -> Callable[[pd.Series, Callable], list]:
    """Call a function on slices of ``size``.

    A local function is shipped to the executors with the plan, so they need not have
    this package installed.
    """

    def run(series: pd.Series, call: Callable) -> list:
        out: list = []
        values = series.tolist()
        for at in range(0, len(values), size):
            part = values[at : at + size]
            answers = list(call(part))
            if len(answers) != len(part):
                raise ValueError(f"got {len(answers)} answers for {len(part)} inputs")
            out.extend(answers)
        return out

    return run


def score(
    prompt: Column, factory: Callable[[], Scorer], batch_size: int = INFERENCE_BATCH_SIZE
) -> Column:
    """Apply a model to a prompt column, ``batch_size`` prompts per call; trimmed."""
    in_batches = _batch_caller(batch_size)

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for prompts in batches:
            yield pd.Series(in_batches(prompts, model), dtype="object")

    return strip_whitespace(apply(prompt))


def score_by_run(
    prompt: Column,
    run: Column,
    factory: Callable[[], Scorer],
    batch_size: int = INFERENCE_BATCH_SIZE,
) -> Column:
    """Apply a model to the prompts of many runs: STRUCT<answer STRING, error STRING>.

    Prompts of one run that follow one another go through together, ``batch_size`` per call.
    Where a call fails, its rows and the task's further rows of that run have the error instead
    of an answer; other runs go on.
    """

    @F.pandas_udf("answer STRING, error STRING")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = factory()
        failed: dict[str, str] = {}
        for prompts, runs in batches:
            texts, keys = prompts.tolist(), runs.tolist()
            answers: list[str | None] = []
            while len(answers) < len(texts):
                at = len(answers)
                key, end = keys[at], at + 1
                while end < len(texts) and end - at < batch_size and keys[end] == key:
                    end += 1
                part: list = [None] * (end - at)
                if key not in failed:
                    try:
                        part = list(model(texts[at:end]))
                        if len(part) != end - at:
                            raise ValueError(f"got {len(part)} answers for {end - at} inputs")
                    except Exception as error:  # the run is reported as failed
                        part = [None] * (end - at)
                        failed[key] = f"{type(error).__name__}: {error}"
                answers.extend(part)
            errors = [failed.get(k) if a is None else None for a, k in zip(answers, keys)]
            yield pd.DataFrame({"answer": answers, "error": errors}, dtype="object")

    scored = apply(prompt, run)
    return F.struct(strip_whitespace(scored["answer"]).alias("answer"), scored["error"].alias("error"))


def encode_with(
    text: Column,
    factory: Callable[[], Encoder],
    max_length: int = MAX_SEQ_LENGTH,
    batch_size: int = 256,
) -> Column:
    """Encode with the caller's tokenizer, truncated; ARRAY<INT>."""
    in_batches = _batch_caller(batch_size)

    @F.pandas_udf("array<int>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = factory()
        for texts in batches:
            ids = in_batches(texts, encoder)
            yield pd.Series([list(x)[:max_length] for x in ids], dtype="object")

    return apply(text)


def map_rows(
    df: DataFrame,
    factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: str,
) -> DataFrame:
    """Row-wise map by the caller's function, one Arrow batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        function = factory()
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


def prediction_records(
    df: DataFrame, source: str, target: str, predicted: str, keep: Sequence[str] = ()
) -> DataFrame:
    return df.select(
        *keep,
        F.col(source).alias("original_c"),
        F.col(target).alias("true_rust"),
        strip_whitespace(F.col(predicted)).alias("predicted_rust"),
    )


def zip_predictions(
    examples: DataFrame, predictions: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Bring examples and predictions made elsewhere together by row key."""
    return examples.join(predictions, list(keys), "inner")
