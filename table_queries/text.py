"""Text functions over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.operators import filters
from table_queries import dress
from table_queries.registry import query, table


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")


@query(
    "SELECT doc_id, source, text FROM documents WHERE lang IN ('en', 'fr')"
)
def scan_filtered_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return filters.allowed_languages(docs, "lang", ("en", "fr")).select(
        "doc_id", "source", "text"
    )


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('en', 'de')")
def filter_allowed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return filters.allowed_languages(docs, "lang", ("en", "de"))


@query(
    """
    SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)
    WHERE quality IS NOT NULL
    """
)
def filter_key_not_null(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return filters.with_key(docs.join(labels, "doc_id", "left"), "quality")


@query(
    f"""
    WITH lines AS (
      SELECT doc_id, string_split({dress.SENTENCE_LINES}, chr(10)) AS parts FROM documents
    ), numbered AS (
      SELECT doc_id, unnest(generate_series(0, len(parts) - 1)) AS line_no,
             unnest(parts) AS line FROM lines
    )
    SELECT doc_id, line_no, line FROM numbered
    WHERE regexp_replace(line, '[\\s\\x{{a0}}]', '', 'g') <> ''
    """
)
def filter_blank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(
        "doc_id", F.posexplode(F.split(F.expr(dress.SENTENCE_LINES), "\n")).alias("line_no", "line")
    )
    return filters.non_blank(
        lines.withColumn("line_no", F.col("line_no").cast("bigint")), "line"
    )


@query(f"SELECT doc_id, {dress.sql_normalize(dress.PADDED)} AS code FROM documents")
def normalize_code(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    return docs.select("doc_id", T.normalize_code(F.expr(dress.PADDED)).alias("code"))


@query(f"SELECT doc_id, {dress.sql_strip_c(dress.AS_C)} AS code FROM documents")
def strip_c_comments(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    return docs.select("doc_id", T.strip_c_comments(F.expr(dress.AS_C)).alias("code"))


@query(f"SELECT doc_id, {dress.sql_strip_rust(dress.AS_RUST)} AS code FROM documents")
def strip_rust_comments(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    return docs.select("doc_id", T.strip_rust_comments(F.expr(dress.AS_RUST)).alias("code"))


# Short texts stand in for blank snippets and for snippets made of one comment.
_SNIPPET = f"""
    CASE WHEN n_chars < 100 THEN concat({dress.NBSP}, ' ')
         WHEN n_chars < 400 THEN concat('/* ', text, ' */')
         WHEN lang = 'en' THEN {dress.AS_C}
         ELSE {dress.AS_RUST} END
"""
_LANGUAGE = "CASE WHEN lang = 'en' THEN 'C' ELSE 'Rust' END"


@query(
    f"""
    WITH raw AS (
      SELECT doc_id, {_LANGUAGE} AS language, n_chars, {dress.sql_normalize(_SNIPPET)} AS code
      FROM documents
    ), clean AS (
      SELECT doc_id, language, code AS raw_code,
        CASE WHEN code = '' THEN NULL
             WHEN n_chars < 400 THEN ''
             WHEN language = 'C' THEN {dress.sql_strip_c('code')}
             ELSE {dress.sql_strip_rust('code')} END AS code
      FROM raw
    )
    SELECT doc_id, language, trim(code, {dress.SQL_SPACE}) AS code FROM clean
    """
)
def finalize_snippet(spark, sf_dir):
    docs = _texts(spark, sf_dir).select(
        "doc_id", F.expr(_LANGUAGE).alias("language"), F.expr(_SNIPPET).alias("raw")
    )
    return docs.select(
        "doc_id", "language", T.finalize_snippet(F.col("raw"), F.col("language")).alias("code")
    )


@query(
    f"""
    WITH found AS (
      SELECT doc_id, list_filter(regexp_extract_all({dress.AS_C},
        '(?s){dress.SQL_C_LITERAL}|({dress.SQL_C_COMMENT})', 2), lambda x: x <> '') AS parts
      FROM documents
    )
    SELECT doc_id, unnest(generate_series(0, len(parts) - 1)) AS pos,
           unnest(parts) AS comment FROM found
    """
)
def extract_comments(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    found = docs.select(
        "doc_id", F.posexplode(T.extract_comments(F.expr(dress.AS_C), "C")).alias("pos", "comment")
    )
    return found.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    f"""
    SELECT doc_id,
      len(list_filter(regexp_extract_all({dress.AS_C},
        '(?s){dress.SQL_C_LITERAL}|({dress.SQL_C_COMMENT})', 2), lambda x: x <> '')) AS n_ranges,
      {dress.sql_strip_c(dress.AS_C)} AS code
    FROM documents
    """
)
def delete_ranges(spark, sf_dir):
    docs = _texts(spark, sf_dir).select("doc_id", F.expr(dress.AS_C).alias("raw"))
    ranges = docs.select(
        "doc_id", "raw", T.comment_ranges(F.col("raw"), "C").alias("ranges")
    )
    return ranges.select(
        "doc_id",
        F.size("ranges").cast("bigint").alias("n_ranges"),
        T.delete_ranges(F.col("raw"), F.reverse("ranges")).alias("code"),
    )


_SQL_FENCE = r"(?is)```rust\s+(.*?)\s+```"


@query(
    f"""
    WITH answers AS (
      SELECT conv_id, turn, {dress.AS_ANSWER} AS answer FROM conversations
    )
    SELECT conv_id, turn, trim(
      CASE WHEN regexp_matches(answer, '{_SQL_FENCE}')
           THEN regexp_extract(answer, '{_SQL_FENCE}', 1) ELSE answer END,
      {dress.SQL_SPACE}) AS code
    FROM answers
    """
)
def extract_fenced_code(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id", "turn", T.extract_fenced_code(F.expr(dress.AS_ANSWER)).alias("code")
    )
