"""Pairing, dedup, merging, reports - and the corpus build put together from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions.text import finalize_snippet
from pairloom.operators import filters, pairs, reports
from pairloom.operators.shape import computed_once
from table_queries import dress
from table_queries.registry import query, table

# A short turn stands in for a snippet that is not text: it clears the slot.
_VALUE = "CASE WHEN length(text) >= 60 THEN text END"
SLOTS = {"user": "c_code", "assistant": "safe_rust_code"}


def conversation_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return pairs.pair_last_wins(
        turns, ["conv_id"], "role", F.expr(_VALUE), F.col("turn"), SLOTS
    )


# Also used by the chat and scoring queries.
SQL_PAIRS = f"""
    WITH pairs AS (
      SELECT conv_id,
        arg_max_null({_VALUE}, turn) FILTER (WHERE role = 'user') AS c_code,
        arg_max_null({_VALUE}, turn) FILTER (WHERE role = 'assistant') AS safe_rust_code
      FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id
    )
"""
_SQL_COMPLETE = "length(c_code) > 0 AND length(safe_rust_code) > 0"


@query(SQL_PAIRS + "SELECT conv_id, c_code, safe_rust_code FROM pairs")
def pair_last_wins(spark, sf_dir):
    return conversation_pairs(spark, sf_dir)


@query(
    SQL_PAIRS + f"SELECT conv_id, c_code, safe_rust_code FROM pairs WHERE {_SQL_COMPLETE}"
)
def filter_both_present(spark, sf_dir):
    return filters.both_present(conversation_pairs(spark, sf_dir), "c_code", "safe_rust_code")


@query(
    f"""
    SELECT u.conv_id, u.text AS c_code, a.text AS safe_rust_code
    FROM (SELECT conv_id, arg_max(text, turn) AS text FROM conversations
          WHERE role = 'user' GROUP BY conv_id) u
    JOIN (SELECT conv_id, arg_max(text, turn) AS text FROM conversations
          WHERE role = 'assistant' GROUP BY conv_id) a ON u.conv_id = a.conv_id
    """
)
def pair_rename(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    by_role = pairs.pair_last_wins(
        turns, ["conv_id"], "role", F.col("text"), F.col("turn"), {"user": "C", "assistant": "Rust"}
    )
    renamed = by_role.withColumnsRenamed({"C": "c_code", "Rust": "safe_rust_code"})
    return filters.both_present(renamed, "c_code", "safe_rust_code")


@query(
    SQL_PAIRS
    + f"""
    SELECT concat('task ', conv_id) AS task_name, c_code, safe_rust_code FROM pairs
    WHERE {_SQL_COMPLETE} ORDER BY task_name
    """
)
def pairs_sorted(spark, sf_dir):
    complete = filters.both_present(
        conversation_pairs(spark, sf_dir), "c_code", "safe_rust_code"
    )
    named = complete.select(
        F.concat(F.lit("task "), F.col("conv_id").cast("string")).alias("task_name"),
        "c_code",
        "safe_rust_code",
    )
    return named.orderBy("task_name")


@query(
    """
    WITH pairs AS (
      SELECT source, n_chars // 1000 AS task,
        arg_max_null(text, doc_id) FILTER (WHERE lang = 'en') AS a,
        arg_max_null(text, doc_id) FILTER (WHERE lang = 'fr') AS b
      FROM documents GROUP BY ALL
    )
    SELECT source, count(*) AS written FROM pairs
    WHERE length(a) > 0 AND length(b) > 0 GROUP BY source
    """
)
def pair_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("task", F.expr("n_chars div 1000"))
    paired = pairs.pair_last_wins(
        docs, ["source", "task"], "lang", F.col("text"), F.col("doc_id"), {"en": "a", "fr": "b"}
    )
    return reports.rows_per_file(filters.both_present(paired, "a", "b"), ["source"])


@query(
    """
    SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, text
    FROM documents GROUP BY text
    """
)
def dedup_keep_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pairs.dedup_keep_first(docs, ["text"], ["doc_id"])


# Very short texts stand in for lines without both sides.
_COMPLETE = "n_chars >= 200"


@query(
    f"""
    WITH firsts AS (
      SELECT text, min(source) AS source FROM documents WHERE {_COMPLETE} GROUP BY text
    ), written AS (SELECT source, count(*) AS written FROM firsts GROUP BY source)
    SELECT source, count(*) AS lines_read, count(*) FILTER (WHERE {_COMPLETE}) AS with_both,
      coalesce(any_value(written), 0) AS written,
      count(*) FILTER (WHERE {_COMPLETE}) - coalesce(any_value(written), 0) AS duplicates
    FROM documents LEFT JOIN written USING (source) GROUP BY source
    """
)
def clean_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    digest = F.when(F.expr(_COMPLETE), pairs.pair_digest(["text"]))
    return reports.clean_report(docs, ["source"], digest)


@query("SELECT count(DISTINCT source) AS total_files FROM documents")
def files_processed(spark, sf_dir):
    return reports.files_processed(table(spark, sf_dir, "documents"), ["source"])


@query(
    """
    SELECT 'documents' AS folder, source AS file, doc_id AS row_id, text, lang FROM documents
    UNION ALL
    SELECT 'benchmark', 'benchmark', item_id, text, NULL FROM benchmark
    """
)
def merge_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("folder"),
        F.col("source").alias("file"),
        F.col("doc_id").alias("row_id"),
        "text",
        "lang",
    )
    items = table(spark, sf_dir, "benchmark").select(
        F.lit("benchmark").alias("folder"),
        F.lit("benchmark").alias("file"),
        F.col("item_id").alias("row_id"),
        "text",
    )
    return pairs.merge_sources([docs, items])


def cleaned_documents(spark, sf_dir):
    """Both sides made from a document's text, cleaned; blank and comment-only ones too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text").select(
        "doc_id",
        "source",
        F.expr(dress.AS_C).alias("raw_c"),
        F.expr(
            f"CASE WHEN n_chars < 200 THEN '// nothing else' ELSE {dress.AS_RUST} END"
        ).alias("raw_rust"),
    )
    return computed_once(
        docs,
        {
            "c_code": finalize_snippet(F.col("raw_c"), "C"),
            "safe_rust_code": finalize_snippet(F.col("raw_rust"), "Rust"),
        },
    ).drop("raw_c", "raw_rust")


_SQL_CLEANED = f"""
    WITH cleaned AS (
      SELECT doc_id, source,
        trim({dress.sql_strip_c(dress.sql_normalize(dress.AS_C))}, {dress.SQL_SPACE}) AS c_code,
        CASE WHEN n_chars < 200 THEN '' ELSE
          trim({dress.sql_strip_rust(dress.sql_normalize(dress.AS_RUST))}, {dress.SQL_SPACE})
        END AS safe_rust_code
      FROM documents
    )
"""


@query(
    _SQL_CLEANED
    + f"""
    SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS task_name, c_code, safe_rust_code
    FROM cleaned WHERE {_SQL_COMPLETE} GROUP BY c_code, safe_rust_code
    """
)
def corpus_build(spark, sf_dir):
    complete = filters.both_present(
        cleaned_documents(spark, sf_dir), "c_code", "safe_rust_code"
    )
    first = pairs.dedup_keep_first(complete, ["c_code", "safe_rust_code"], ["doc_id"])
    return first.withColumnRenamed("source", "task_name")


@query(
    _SQL_CLEANED
    + f"""
    , firsts AS (
      SELECT min(source) AS source FROM cleaned WHERE {_SQL_COMPLETE}
      GROUP BY c_code, safe_rust_code
    ), written AS (SELECT source, count(*) AS written FROM firsts GROUP BY source)
    SELECT source, count(*) AS lines_read, count(*) FILTER (WHERE {_SQL_COMPLETE}) AS with_both,
      coalesce(any_value(written), 0) AS written,
      count(*) FILTER (WHERE {_SQL_COMPLETE}) - coalesce(any_value(written), 0) AS duplicates
    FROM cleaned LEFT JOIN written USING (source) GROUP BY source
    """
)
def corpus_report(spark, sf_dir):
    complete = (F.length("c_code") > 0) & (F.length("safe_rust_code") > 0)
    digest = F.when(complete, pairs.pair_digest(["c_code", "safe_rust_code"]))
    return reports.clean_report(cleaned_documents(spark, sf_dir), ["source"], digest)
