"""Helpers that the operators of this subpackage share: column picking and staged tables."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where none is set and executors
    run in the driver (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="pairloom-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read from there.

    This cuts the lineage in a way that outlives executors, fixes generated row numbers, and
    gives the optimizer real sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under new names: ``pick(docs, id="doc_id", text="text")``.

    Columns are found by exact name and first position, so further columns whose names differ
    in case only, or that repeat a name, do no harm.
    """
    names = df.columns
    flat = df.toDF(*(f"_{i}" for i in range(len(names))))
    return flat.select(*(F.col(f"_{names.index(old)}").alias(new) for new, old in wanted.items()))


def with_columns_of(df: DataFrame, **wanted: str) -> tuple[DataFrame, list[str]]:
    """All columns under positional names, plus the wanted ones again under the given names."""
    names = df.columns
    flat = df.toDF(*(f"_{i}" for i in range(len(names))))
    own = [f"_{i}" for i in range(len(names))]
    return flat.select(*own, *(F.col(f"_{names.index(old)}").alias(new) for new, old in wanted.items())), own


def renamed_back(df: DataFrame, own: list[str], names: list[str]) -> DataFrame:
    """The positional columns of :func:`with_columns_of` under their first names again."""
    return df.select(*own).toDF(*names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast(T.StringType()), F.lit(""))


def give_back_memory() -> None:
    """Return what this Python process has freed to the system. Workers stay idle beside the
    tasks of later stages, and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library, which has no such call


def kept_in_worker(name: str, make):
    """What ``make()`` gives, made once per Python process, so that it outlives a task."""
    kept = sys.modules.setdefault("_pairloom_kept", types.ModuleType("_pairloom_kept"))
    if name not in vars(kept):
        vars(kept)[name] = make()
    return vars(kept)[name]
