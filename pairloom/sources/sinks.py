"""Corpus and prediction output."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.records import record_json
from pairloom.operators.grid import RUN_KEYS
from pairloom.sources.files import ORDER_COLUMNS, corpus_table_path, file_system, path_or_none

PREDICTION_SCHEMA = "original_c STRING, true_rust STRING, predicted_rust STRING"
RUN_SCHEMA = "model_type STRING, seed INT, fold INT"
# The escapes of JSON that are shorter than a code, the backslash first.
_SHORT_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
# Digits of a position in a folder name.
POSITION_DIGITS = 15


def record_line(corpus: DataFrame, *keep: str) -> DataFrame:
    """JSON lines; explicit nulls among the extras and non-ASCII text stay as they are."""
    columns = {name: F.col(name) for name in ("c_code", "safe_rust_code")}
    line = record_json(F.col("label"), F.col("extras"), columns)
    return corpus.select(line.alias("value"), *keep)


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Overwrite the corpus folder at ``path`` and the Parquet table ``<path>.table``.

    ``corpus`` comes from :func:`pairloom.operators.placing.in_order`.  Both have one folder per
    chunk, ``first=<position of its first record>``, padded so that paths in name order hold the
    records in source order, however many there are.  The table has the same records with
    their ``position``: it is what later steps read, and may read in part.
    """
    padded = F.lpad(F.col("first").cast("string"), POSITION_DIGITS, "0")
    table = corpus.withColumn("first", padded).drop(*ORDER_COLUMNS, "task_order")
    in_place = table.sortWithinPartitions("first", "position")
    in_place.write.mode("overwrite").partitionBy("first").parquet(corpus_table_path(path))
    written = corpus.sparkSession.read.schema(table.schema).parquet(corpus_table_path(path))
    lines = record_line(written, "first", "position").sortWithinPartitions("first", "position")
    lines.drop("position").write.mode("overwrite").partitionBy("first").text(path)


def write_corpus_lines(corpus: DataFrame, path: str) -> None:
    """Overwrite the corpus folder at ``path`` with records in any order."""
    record_line(corpus).write.mode("overwrite").text(path)


def write_predictions(
    predictions: DataFrame, path: str, keys: Sequence[str] = RUN_KEYS, mode: str = "append"
) -> None:
    """One folder per run.  Finished runs are left alone, new ones are added."""
    (
        predictions.write.mode(mode)
        .partitionBy(*keys)
        .option("ignoreNullFields", "false")
        .json(path)
    )


def stage_predictions(predictions: DataFrame, output: str, keys: Sequence[str] = RUN_KEYS) -> str:
    """Write the predictions of many runs to a folder of their own, hidden below ``output``."""
    stage = f"{output.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    write_predictions(predictions, stage, keys)
    return stage


def commit_runs(
    spark: SparkSession, stage: str, output: str, runs: Sequence[Row], keys: Sequence[str] = RUN_KEYS
) -> None:
    """Move the folders of the given runs from ``stage`` to ``output``, one rename each, and
    delete the rest of the stage.  A run's folder is there as a whole or not at all."""
    source, files = file_system(spark, stage)
    for run in runs:
        name = "/".join(f"{key}={run[key]}" for key in keys)
        folder, _ = file_system(spark, f"{stage}/{name}")
        target, _ = file_system(spark, f"{output.rstrip('/')}/{name}")
        if files.exists(folder):  # a run without test rows has none
            files.mkdirs(target.getParent())
            if not files.rename(folder, target):
                raise OSError(f"could not move the predictions of {name}")
    files.delete(source, True)


def write_prediction_arrays(
    predictions: DataFrame, path: str, keys: Sequence[str] = RUN_KEYS
) -> None:
    """Every run as one indented JSON array, all characters beyond ASCII escaped.

    The array of a run lies in the part files of its folder: joined in name order they are the
    text of the array, so no run has to pass through one task.  ``position`` orders its records.
    """
    ends = predictions.groupBy(*keys).agg(
        F.min("position").alias("__low"), F.max("position").alias("__high")
    )
    at, low, high = F.col("position"), F.col("__low"), F.col("__high")
    names = [part.split()[0] for part in PREDICTION_SCHEMA.split(", ")]
    fields = [F.concat(F.lit(f'    "{n}": '), _json_string(F.col(n))) for n in names]
    record = F.concat(F.lit("  {\n"), F.concat_ws(",\n", *fields), F.lit("\n  }"))
    text = F.concat(
        F.when(at == low, "[\n").otherwise(""), record, F.when(at == high, "\n]").otherwise(",")
    )
    placed = predictions.join(ends, list(keys)).select(*keys, "position", text.alias("value"))
    ordered = placed.orderBy(*keys, "position").drop("position")
    ordered.write.mode("overwrite").partitionBy(*keys).text(path)


def _json_string(text: Column) -> Column:
    """A JSON string in printable ASCII, or null."""
    escaped = text
    for plain, code in _SHORT_ESCAPES.items():
        escaped = F.replace(escaped, F.lit(plain), F.lit(code))
    units = F.transform(
        F.split(escaped, ""),
        lambda c: F.when(F.ascii(c).between(0x20, 0x7E), c).otherwise(
            F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
        ),
    )
    inside = F.when(F.rlike(escaped, F.lit("[^ -~]")), F.array_join(units, "")).otherwise(escaped)
    return F.coalesce(F.concat(F.lit('"'), inside, F.lit('"')), F.lit("null"))


def read_predictions(
    spark: SparkSession, path: str, keys: str = RUN_SCHEMA, position: str = "BIGINT"
) -> DataFrame:
    """Predictions of all runs; ``position`` orders those of a run (its type is the key's)."""
    return spark.read.schema(f"position {position}, {PREDICTION_SCHEMA}, {keys}").json(path)


def read_prediction_array(spark: SparkSession, path: str) -> DataFrame:
    """Predictions kept as one JSON array per file."""
    return spark.read.schema(PREDICTION_SCHEMA).option("multiLine", True).json(path)


def read_prediction_arrays(spark: SparkSession, path: str, keys: str = RUN_SCHEMA) -> DataFrame:
    """Predictions of runs kept as indented arrays, in one part or many.

    A record ends where a line begins with its closing bracket, so files of any size are read
    in parts: no string in JSON holds a line break.
    """
    names = [part.split()[0] for part in keys.split(", ")]
    parts = spark.read.schema(f"value STRING, {keys}").option("lineSep", "\n  }").text(path)
    body = F.regexp_replace("value", r"^[\s,\[\]]+", "")
    record = F.from_json(F.concat(body, F.lit("}")), PREDICTION_SCHEMA, {"mode": "FAILFAST"})
    return parts.where(body != "").select(record.alias("r"), *names).select("r.*", *names)


def finished_runs(spark: SparkSession, path: str, schema: str = RUN_SCHEMA) -> DataFrame:
    """Runs that have output: the partition values present under ``path``.

    Only the file listing is used (``binaryFile`` does not open files whose content is
    not asked for), so the cost does not grow with the predictions.
    """
    keys = [part.split() for part in schema.split(", ")]
    listing = path_or_none(
        lambda: spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    )
    if listing is None or any(name not in listing.columns for name, _ in keys):
        return spark.createDataFrame([], schema)
    return listing.select(*[F.col(name).cast(kind) for name, kind in keys]).distinct()
