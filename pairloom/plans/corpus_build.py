"""Corpus build: dataset folders -> one cleaned, merged corpus and its report.

Two lazy branches.  Parquet rows are paired per file and task; JSONL records carry both
sides already and are deduplicated over all files.  Each branch shuffles its text once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.constants import (
    ALLOWED_LANGUAGES,
    CORPUS_NAME,
    DROP_KEYS_BY_FOLDER,
    LANG_C,
    LANG_RUST,
)
from pairloom.functions.records import (
    RECORD_TYPE,
    canonical_label,
    drop_keys_by_folder,
    extras,
    has_keys,
    is_string,
    parse_record,
    string_to_variant,
    string_value,
)
from pairloom.functions.text import finalize_snippet
from pairloom.operators.filters import allowed_languages, both_present, with_key
from pairloom.operators.pairs import (
    dedup_keep_first,
    merge_sources,
    pair_digest,
    pair_last_wins,
)
from pairloom.operators.reports import (
    clean_report,
    files_processed,
    rows_per_file,
    with_all_files,
)
from pairloom.operators.placing import in_order
from pairloom.operators.shape import computed_once
from pairloom.sources.files import (
    FILE_COLUMNS,
    ORDER_COLUMNS,
    listed_files,
    root_exists,
    scan_jsonl,
    scan_parquet,
)
from pairloom.sources.sinks import write_corpus, write_corpus_lines

PAIR_COLUMNS = ("c_code", "safe_rust_code")
CORPUS_COLUMNS = ("label", *PAIR_COLUMNS, "extras", *ORDER_COLUMNS, "task_order")


@dataclass
class CorpusOptions:
    drop_keys: dict[str, Sequence[str]] = field(
        default_factory=lambda: dict(DROP_KEYS_BY_FOLDER)
    )
    grammar_habits: bool = False
    ordered: bool = True
    # folder for intermediate tables, which all executors share; by default one beside the
    # corpus, hidden to Spark's readers
    staging: str | None = None


def paired_rows(rows: DataFrame, options: CorpusOptions) -> DataFrame:
    """Parquet branch: last snippet per file, task and language; both sides required.

    Cleaning is per row, so cleaning only the winning snippets gives the same pairs as
    cleaning all of them first.
    """
    wanted = with_key(allowed_languages(rows, "language_name", ALLOWED_LANGUAGES), "task_name")
    slots = pair_last_wins(
        wanted,
        [*FILE_COLUMNS, "task_name"],
        "language_name",
        F.col("code"),
        F.col("row"),
        {LANG_C: "__c", LANG_RUST: "__rust"},
    )
    clean = computed_once(
        slots,
        {
            "c_code": finalize_snippet(F.col("__c"), LANG_C, options.grammar_habits),
            "safe_rust_code": finalize_snippet(F.col("__rust"), LANG_RUST, options.grammar_habits),
        },
    )
    return both_present(clean, *PAIR_COLUMNS).select(
        string_to_variant(F.col("task_name")).alias("label"),
        *PAIR_COLUMNS,
        F.from_json(F.lit("{}"), RECORD_TYPE).alias("extras"),
        *FILE_COLUMNS,
        F.lit(0).cast("bigint").alias("block"),
        F.lit(0).cast("bigint").alias("row"),
        F.col("task_name").alias("task_order"),
    )


def cleaned_lines(lines: DataFrame, options: CorpusOptions) -> DataFrame:
    """JSONL branch before dedup: every line, with a pair digest where it is complete."""
    # bytes that are not UTF-8 stop the build
    valid = F.validate_utf8(F.col("value"))
    parsed = computed_once(lines, {"record": parse_record(valid)}).drop("value")
    record = F.col("record")
    usable = (
        has_keys(record, ["C", "Rust"]) & is_string(record, "C") & is_string(record, "Rust")
    )
    raw = computed_once(
        parsed,
        {
            "raw_c": F.when(usable, string_value(record, "C")),
            "raw_rust": F.when(usable, string_value(record, "Rust")),
            "label": canonical_label(record),
        },
    )
    clean = computed_once(
        raw,
        {
            "c_code": finalize_snippet(F.col("raw_c"), LANG_C, options.grammar_habits),
            "safe_rust_code": finalize_snippet(
                F.col("raw_rust"), LANG_RUST, options.grammar_habits
            ),
        },
    )
    complete = (F.length("c_code") > 0) & (F.length("safe_rust_code") > 0)
    rest = extras(record, F.col("label"), ["C", "Rust", *PAIR_COLUMNS])
    return clean.select(
        "label",
        *PAIR_COLUMNS,
        drop_keys_by_folder(rest, F.col("folder"), options.drop_keys).alias("extras"),
        *ORDER_COLUMNS,
        F.lit("").alias("task_order"),
        F.when(complete, pair_digest(PAIR_COLUMNS)).alias("digest"),
    )


def unique_records(cleaned: DataFrame) -> DataFrame:
    """First record of every distinct pair over all JSONL files."""
    complete = cleaned.where(F.col("digest").isNotNull())
    return dedup_keep_first(complete, PAIR_COLUMNS, ORDER_COLUMNS, F.col("digest")).drop("digest")


def first_keys(cleaned: DataFrame, *keep: str) -> DataFrame:
    """Where the first record of every distinct pair stands; one digest per pair is compared."""
    at = [*ORDER_COLUMNS, "task_order"]
    complete = cleaned.where(F.col("digest").isNotNull())
    first = complete.groupBy("digest").agg(F.min(F.struct(*at)).alias("at"))
    return first.select(*keep, "at.*")


def build_corpus(
    spark: SparkSession, root: str, options: CorpusOptions | None = None
) -> DataFrame | None:
    """The merged corpus as a lazy DataFrame, or None where there is nothing to read."""
    options = options or CorpusOptions()
    branches = []
    rows, lines = scan_parquet(spark, root), scan_jsonl(spark, root)
    if rows is not None:
        branches.append(paired_rows(rows, options))
    if lines is not None:
        branches.append(unique_records(cleaned_lines(lines, options)))
    return merge_sources(branches).select(*CORPUS_COLUMNS) if branches else None


def corpus_table(corpus: DataFrame) -> DataFrame:
    """Plain columns: a label that is not a string appears as its JSON text."""
    return corpus.select(
        F.col("label").cast("string").alias("task_name"), *PAIR_COLUMNS, "extras"
    )


@dataclass
class CorpusReport:
    parquet_files: DataFrame | None
    jsonl_files: DataFrame | None
    total_files: int
    # the intermediate tables of the run; may be deleted once the report has been read
    staging: str | None = None


def run_corpus_build(
    spark: SparkSession,
    root: str,
    destination: str,
    options: CorpusOptions | None = None,
    name: str = CORPUS_NAME,
) -> CorpusReport:
    """Build, write and report.

    A missing root is an error; a root without usable files writes nothing.  The cleaned
    lines feed both the corpus and the report, so they are written once to the staging
    folder instead of being cleaned twice.  With ``options.ordered`` the corpus is in source
    order and has its table beside it (:func:`pairloom.sources.sinks.write_corpus`).  The report has a row for every file found, and
    is written as tables ``<name>.report/parquet`` and ``/jsonl`` beside the corpus.
    """
    options = options or CorpusOptions()
    if not root_exists(spark, root):
        raise FileNotFoundError(f"no such folder of datasets: {root}")
    rows, lines = scan_parquet(spark, root), scan_jsonl(spark, root)
    target = f"{destination.rstrip('/')}/{name}"
    stage = f"{options.staging or destination.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    branches: list[DataFrame] = []
    keys: list[DataFrame] = []
    at = [*ORDER_COLUMNS, "task_order"]
    files: dict[str, DataFrame] = {}
    parquet_report = jsonl_report = None
    if rows is not None:
        paired_rows(rows, options).write.parquet(f"{stage}/pairs")
        pairs = spark.read.parquet(f"{stage}/pairs")
        branches.append(pairs)
        keys.append(pairs.select(*at))
        parquet_report = rows_per_file(pairs, FILE_COLUMNS)
        files["parquet"] = listed_files(spark, root, "parquet")
    if lines is not None:
        cleaned_lines(lines, options).write.parquet(f"{stage}/lines")
        cleaned = spark.read.parquet(f"{stage}/lines")
        ordered = options.ordered
        branches.append(cleaned.where("digest IS NOT NULL") if ordered else unique_records(cleaned))
        keys.append(first_keys(cleaned))
        jsonl_report = clean_report(cleaned, FILE_COLUMNS, F.col("digest"))
        files["jsonl"] = listed_files(spark, root, "jsonl")
    if not branches:
        return CorpusReport(None, None, 0)
    corpus = merge_sources(branches).select(*CORPUS_COLUMNS)
    if options.ordered:
        write_corpus(in_order(corpus, merge_sources(keys)), target)
    else:
        write_corpus_lines(corpus, target)
    reports = {"parquet": parquet_report, "jsonl": jsonl_report}
    for kind, report in reports.items():
        if report is not None:
            path = f"{target}.report/{kind}"
            with_all_files(report, files[kind], FILE_COLUMNS).write.mode("overwrite").parquet(path)
            reports[kind] = spark.read.parquet(path)
    found = merge_sources(list(files.values()))
    total = files_processed(found, FILE_COLUMNS).first()["total_files"]
    return CorpusReport(reports["parquet"], reports["jsonl"], total, stage)
