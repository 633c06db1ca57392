"""Dataset folders: ``root/<dataset>/<file>.parquet | .jsonl``.

Files lie directly in a dataset folder; suffixes match in any case; deeper levels are not
read.  Names starting with ``_`` or ``.`` are hidden files to Spark and are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from pairloom.operators.filters import non_blank
from pairloom.operators.placing import first_positions

RAW_PAIR_SCHEMA = "task_name STRING, language_name STRING, code STRING"
CORPUS_SCHEMA = "task_name STRING, c_code STRING, safe_rust_code STRING"
FILE_COLUMNS = ("folder", "file")
# folder, file, then the place inside the file
ORDER_COLUMNS = ("folder", "file", "block", "row")


def file_glob(root: str, suffix: str) -> str:
    any_case = "".join(f"[{c}{c.upper()}]" for c in suffix)
    return f"{root.rstrip('/')}/*/*.{any_case}"


def path_part(index: int) -> Column:
    """Part of the file path, with the URL escapes of the metadata column undone."""
    path = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.element_at(F.split(F.url_decode(path), "/"), index)


def part_number(file: Column) -> Column:
    """Number of a part file; names alone sort part-100000 before part-99999."""
    return F.regexp_extract(file, r"^part-(\d+)", 1).try_cast("bigint")


def path_or_none(load) -> DataFrame | None:
    try:
        return load()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def file_system(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def root_exists(spark: SparkSession, root: str) -> bool:
    """Whether ``root`` is a folder, asked of the file system of its path; nothing is listed."""
    path, files = file_system(spark, root)
    return bool(files.exists(path) and files.getFileStatus(path).isDirectory())


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` with scheme and all parts, so that the depth of a path below it can be told."""
    path, files = file_system(spark, root)
    return files.makeQualified(path).toString()


def listed_files(spark: SparkSession, root: str, suffix: str) -> DataFrame | None:
    """Folder and file of every file with the suffix, empty ones too; None when there is none.

    The listing is a table of Spark's own: ``binaryFile`` opens no file whose content is not
    asked for.  It leaves out files of no bytes, which are added from the file system's listing.
    """
    listing = path_or_none(
        lambda: spark.read.format("binaryFile").load(file_glob(root, suffix)).select("path", "_metadata")
    )
    if listing is None:
        return None
    found = in_dataset_folder(listing, qualified(spark, root)).select(
        path_part(-2).alias("folder"), path_part(-1).alias("file")
    )
    path, system = file_system(spark, file_glob(root, suffix))
    empty = [x.getPath() for x in system.globStatus(path) or () if x.isFile() and x.getLen() == 0]
    names = [(x.getParent().getName(), x.getName()) for x in empty]
    names = [n for n in names if not any(part.startswith(("_", ".")) for part in n)]
    return found.union(spark.createDataFrame(names, "folder STRING, file STRING"))


def _path_depth(path: Column | str) -> Column | int:
    """Number of parts of a path, its scheme and authority left out."""
    if isinstance(path, str):
        return len([p for p in re.sub("^[A-Za-z0-9+.-]+:(//[^/]*)?", "", path).split("/") if p])
    bare = F.regexp_replace(path, "^[A-Za-z0-9+.-]+:(//[^/]*)?", "")
    return F.size(F.filter(F.split(bare, "/"), lambda p: p != ""))


def in_dataset_folder(scan: DataFrame, root: str) -> DataFrame:
    """Rows of files that lie directly in a folder of ``root``, a :func:`qualified` path.

    A folder may carry a data suffix too; the files in it are one level deeper and no data.
    """
    return scan.where(_path_depth(F.col("_metadata.file_path")) == _path_depth(root) + 2)


def _merged_schema(spark: SparkSession, paths: Sequence[str]) -> StructType | None:
    """The columns of all the files, from their footers (one job); None where types differ."""
    try:
        return spark.read.option("mergeSchema", True).parquet(*paths).schema
    except (PySparkException, Py4JJavaError) as error:
        if "CANNOT_MERGE" not in str(error):
            raise
        return None


def files_by_schema(spark: SparkSession, paths: Sequence[str]) -> list[tuple[list[str], StructType]]:
    """Parquet files in groups that agree in the type of every column.

    One job reads all footers.  Only where they differ the list is halved, again and again.
    """
    schema = _merged_schema(spark, paths)
    if schema is not None:
        return [(list(paths), schema)]
    half = len(paths) // 2
    found: dict[str, tuple[list[str], StructType]] = {}
    for part in (paths[:half], paths[half:]):
        for group, own in files_by_schema(spark, part):
            # groups of both halves that agree are scanned together
            if own.json() in found:
                found[own.json()][0].extend(group)
            else:
                found[own.json()] = (group, own)
    return list(found.values())


def _typed_scan(spark: SparkSession, paths: Sequence[str], schema: StructType) -> DataFrame:
    """The three columns; what is not text is null, names that are not text are written out."""
    wanted = StructType.fromDDL(RAW_PAIR_SCHEMA).names
    there = [f for f in schema.fields if f.name in wanted]
    columns = {f.name: F.col(f.name) if isinstance(f.dataType, StringType) else None for f in there}
    if any(f.name == "task_name" for f in there):
        columns["task_name"] = F.col("task_name").cast("string")
    raw = spark.read.schema(StructType(there)).parquet(*paths)
    none = F.lit(None).cast("string")
    values = [columns.get(n) if columns.get(n) is not None else none for n in wanted]
    return raw.select(*(v.alias(n) for v, n in zip(values, wanted)), "_metadata")


def scan_parquet(spark: SparkSession, root: str) -> DataFrame | None:
    """The three columns of every Parquet file, with folder, file and row number.

    null columns stand in where a file lacks one; None when there is no such file.  Files may
    differ in their types: one scan for each kind, a ``code`` that is no text is null.
    """
    glob = file_glob(root, "parquet")
    if path_or_none(lambda: spark.read.format("binaryFile").load(glob)) is None:
        return None
    home = qualified(spark, root)
    schema = _merged_schema(spark, [glob])
    if schema is not None:
        groups = [([glob], schema)]
    else:
        listing = in_dataset_folder(spark.read.format("binaryFile").load(glob).select("path", "_metadata"), home)
        groups = files_by_schema(spark, [r["path"] for r in listing.select("path").orderBy("path").collect()])
    scans = [in_dataset_folder(_typed_scan(spark, paths, own), home) for paths, own in groups]
    return reduce(DataFrame.unionByName, scans).select(
        "task_name",
        "language_name",
        "code",
        path_part(-2).alias("folder"),
        path_part(-1).alias("file"),
        F.lit(0).cast("bigint").alias("block"),
        F.col("_metadata.row_index").alias("row"),
    )


def with_text_order(lines: DataFrame) -> DataFrame:
    """Folder, file and an order inside the file for lines of a text scan.

    Large files are read in blocks by several tasks.  The block offset orders the blocks,
    and the generated id grows along the lines of one block.
    """
    return lines.select(
        "value",
        path_part(-2).alias("folder"),
        path_part(-1).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def scan_jsonl(spark: SparkSession, root: str) -> DataFrame | None:
    """Non-blank lines of every JSONL file; None when there is no such file."""
    raw = path_or_none(lambda: spark.read.text(file_glob(root, "jsonl")))
    if raw is None:
        return None
    return non_blank(with_text_order(in_dataset_folder(raw, qualified(spark, root))), "value")


def corpus_table_path(path: str) -> str:
    """Where the corpus folder at ``path`` has its records as a table."""
    return f"{path.rstrip('/')}.table"


def load_corpus(spark: SparkSession, path: str, schema: str | None = CORPUS_SCHEMA) -> DataFrame:
    """A corpus as one table.  ``schema=None`` infers it, at the price of one more scan."""
    if schema is None:
        return spark.read.json(path).drop("first")
    columns = [part.split()[0] for part in schema.split(", ")]
    return spark.read.schema(schema).json(path).select(*columns)


def load_corpus_with_position(
    spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA
) -> DataFrame:
    """A corpus with the 0-based ``position`` of every record in source order.

    A corpus that was written in order has a table with positions beside it: one scan, of the
    columns asked for.  For lines from elsewhere positions are counted, see
    :func:`count_positions`.
    """
    if not root_exists(spark, corpus_table_path(path)):
        return count_positions(spark, path, schema)
    table = spark.read.parquet(corpus_table_path(path))
    label = F.col("label").cast("string").alias("task_name")
    known = {"task_name": label, "c_code": F.col("c_code"), "safe_rust_code": F.col("safe_rust_code")}
    wanted = [part.split() for part in schema.split(", ")]
    more = lambda name, kind: F.variant_get(
        F.try_element_at("extras", F.lit(name)), "$", kind
    ).alias(name)
    return table.select("position", *(known[n] if n in known else more(n, k) for n, k in wanted))


def count_positions(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA) -> DataFrame:
    """JSON lines with the 0-based ``position`` of every record in file order.

    Ids are consecutive along a block, so a record's place is its id less the first id of
    its block plus the size of all blocks before it.  Only one small row per block is
    aggregated and ordered; records are not ranked, and they are shuffled only where the
    table of blocks is too large for Spark to broadcast.
    """
    lines = with_text_order(non_blank(spark.read.text(path).select("value", "_metadata"), "value"))
    at = ["folder", "file", "block"]
    blocks = lines.groupBy(*at).agg(
        F.count("*").alias("__size"), F.min("row").alias("__first")
    )
    starts = first_positions(
        blocks, "__size", ["block"], [F.col("folder"), part_number(F.col("file"))], "__start"
    ).drop("__size")
    record = F.from_json("value", schema, {"mode": "FAILFAST"})
    return (
        lines.join(starts, at)
        .select(
            (F.col("__start") + F.col("row") - F.col("__first")).alias("position"),
            record.alias("__record"),
        )
        .select("position", "__record.*")
    )
