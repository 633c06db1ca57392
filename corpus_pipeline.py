"""A training corpus from the documents table, stage by stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import decontamination, pieces, secrets, simhash, toxicity
from pairloom.llm.common import shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go."""
    return toxicity.not_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 4-word fingerprints link at 4 bits or fewer stays."""
    return simhash.one_of_each(docs, words=4, most=4)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with other numbers and names, go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; no document goes."""
    return secrets.without_secrets(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with merge-dropout; each is decoded again and compared."""
    return pieces.with_pieces(docs, pieces.model_path(), dropout=0.1, seed=42)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic),
    ("near_copies", no_near_copies),
    ("benchmark", no_benchmark),
    ("secrets", no_secrets),
    ("pieces", encoded),
]

#: SQL cannot express the trained stages; the tests compare each stage with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
