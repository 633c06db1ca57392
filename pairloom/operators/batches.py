"""Consecutive batches and padding to the longest row of a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.constants import INFERENCE_BATCH_SIZE
from pairloom.functions.tokens import left_padded, left_padded_mask
from pairloom.operators.ranks import global_rank, tie_order, with_ordinal_bucket
from pairloom.operators.shape import computed_once
from pairloom.session import staged


def batch_ids(
    df: DataFrame,
    ordinal: str,
    batch_size: int = INFERENCE_BATCH_SIZE,
    group: Sequence[str] = (),
    tie: Sequence[str] = (),
    population: DataFrame | None = None,
) -> DataFrame:
    """Number consecutive batches in ``ordinal`` order; the last one may be short.

    Rows of equal ordinals go by the hash of the ``tie`` columns.
    """
    bucketed = with_ordinal_bucket(df, ordinal, "__range", tie, population=population)
    order = [F.col(ordinal), *tie_order(tie)]
    ranked = global_rank(bucketed, group, order, "__range", "__rank")
    return ranked.withColumn("batch_id", F.floor(F.col("__rank") / batch_size)).drop(
        "__rank", "__range"
    )


def left_pad(
    df: DataFrame, ids: str, pad: Column, batch: Sequence[str] = ("batch_id",)
) -> DataFrame:
    """Pad every row on the left to the longest row of its batch; mask 0 over padding."""
    width = F.max(F.size(ids)).over(Window.partitionBy(*batch))
    sized = df.withColumn("__width", width)
    return sized.withColumn(
        "attention_mask", left_padded_mask(F.col(ids), F.col("__width"))
    ).withColumn(ids, left_padded(F.col(ids), F.col("__width"), pad)).drop("__width")


def padded_batches(
    df: DataFrame,
    key: str,
    ids: Column,
    pad: Column,
    batch_size: int = INFERENCE_BATCH_SIZE,
) -> DataFrame:
    """Rows in batches by ``key`` (unique), with whole ``input_ids`` padded to the batch's longest.

    Every text is encoded once: rows are written with their ids and sizes.  Only (key, size) is
    ranked and gathered by batch; the rows meet their batch number and width in one join.
    """
    encoded = staged(
        computed_once(df, {"input_ids": ids}).withColumn("__size", F.size("input_ids")), "encoded"
    )
    slim = batch_ids(encoded.select(key, "__size"), key, batch_size)
    widths = slim.groupBy("batch_id").agg(F.max("__size").alias("__width"))
    placed = slim.join(widths, "batch_id").select(key, "batch_id", "__width")
    width = F.col("__width")
    joined = encoded.drop("__size").join(placed, key)
    return joined.withColumn("attention_mask", left_padded_mask(F.col("input_ids"), width)).withColumn(
        "input_ids", left_padded(F.col("input_ids"), width, pad)
    ).drop("__width")


def first_batches(
    df: DataFrame, group: Sequence[str], order: Sequence[str], batch_size: int = INFERENCE_BATCH_SIZE
) -> DataFrame:
    """Dry run of many runs: the first batch of each (each task keeps that many rows at most)."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= batch_size).drop("__place")


def first_batch(
    df: DataFrame, order: Sequence[str], batch_size: int = INFERENCE_BATCH_SIZE
) -> DataFrame:
    """Dry run: the first batch only (each task keeps ``batch_size`` rows at most)."""
    return df.orderBy(*order).limit(batch_size)
