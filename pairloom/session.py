"""Session helpers: settings the jobs rely on, and the checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def builder(app: str = "pairloom", master: str | None = None) -> SparkSession.Builder:
    """Session builder with the settings that matter for these jobs.

    ``shuffle.partitions`` is left alone: set it from the data size (about one per
    200 MB of shuffled text) and let adaptive execution merge the small ones.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return b.master(master) if master else b


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only where the session names none (tests, a laptop) a temporary one is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="pairloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    spark.sparkContext.setCheckpointDir(named)
    return named


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder, and read from there.

    Later steps read what is there instead of computing it again, and a lost executor costs
    no more than that.  ``inputFiles()`` of the result tells where it lies.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
