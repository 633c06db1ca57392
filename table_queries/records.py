"""Dynamic JSON records: lines written from ``documents`` and ``labels``, parsed back.

Depending on a document's label its line has a numeric, text, null or no ``Rust`` value,
and its name under ``name``, ``task_name`` or both.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import records as R
from pairloom.operators import filters
from pairloom.operators.shape import computed_once
from table_queries.registry import query, table

_DROP_RULES = {"src3": ("id",), "src7": ("id", "n")}


def _lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    labels = table(spark, sf_dir, "labels")
    options = {"ignoreNullFields": "false"}
    label = F.col("source").alias("name")
    nothing = F.lit(None).cast("string")
    source = F.col("text").alias("C")
    numeric = F.struct(F.col("doc_id").alias("id"), label, source, F.col("quality").alias("Rust"))
    full = F.struct(
        label,
        F.col("lang").alias("task_name"),
        source,
        F.col("text").alias("Rust"),
        F.col("n_chars").alias("n"),
        F.array("lang", "source").alias("tags"),
    )
    null_side = F.struct(
        label, nothing.alias("task_name"), source, nothing.alias("Rust"), F.col("n_chars").alias("n")
    )
    absent = F.struct(F.col("doc_id").alias("id"), label, source)
    line = (
        F.when(F.col("toxic") == 1, F.to_json(numeric, options))
        .when(F.col("quality") == 1, F.to_json(full, options))
        .when(F.col("quality") == 0, F.to_json(null_side, options))
        .otherwise(F.to_json(absent, options))
    )
    joined = docs.join(labels, "doc_id", "left")
    lines = joined.select("doc_id", "source", line.alias("line"))
    return computed_once(lines, {"record": R.parse_record(F.col("line"))}).drop("line")


# How the SQL side names the four kinds of line.
_KINDS = """
    WITH kinds AS (
      SELECT *, CASE WHEN toxic = 1 THEN 'numeric' WHEN quality = 1 THEN 'full'
                     WHEN quality = 0 THEN 'null' ELSE 'absent' END AS kind
      FROM documents LEFT JOIN labels USING (doc_id)
    )
"""


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_fields(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "props")
    parsed = computed_once(events, {"record": R.parse_record(F.col("props"))})
    value = F.try_element_at("record", F.lit("k"))
    return parsed.select("event_id", F.variant_get(value, "$", "bigint").alias("k"))


@query(_KINDS + "SELECT doc_id FROM kinds WHERE kind <> 'absent'")
def json_required_keys(spark, sf_dir):
    return filters.with_record_keys(_lines(spark, sf_dir), "record", ["C", "Rust"]).select(
        "doc_id"
    )


@query(_KINDS + "SELECT doc_id, text AS c_text, text AS rust_text FROM kinds WHERE kind = 'full'")
def json_string_type(spark, sf_dir):
    rows = filters.with_string_values(_lines(spark, sf_dir), "record", ["C", "Rust"])
    return rows.select(
        "doc_id",
        R.string_value(F.col("record"), "C").alias("c_text"),
        R.string_value(F.col("record"), "Rust").alias("rust_text"),
    )


@query(
    _KINDS
    + """
    SELECT doc_id, CASE kind
      WHEN 'numeric' THEN concat('{"id":', doc_id, '}')
      WHEN 'full' THEN concat('{"n":', n_chars, ',"tags":["', lang, '","', source, '"]}')
      WHEN 'null' THEN concat('{"name":"', source, '","task_name":null,"n":', n_chars, '}')
      ELSE concat('{"id":', doc_id, '}') END AS extras
    FROM kinds
    """
)
def json_passthrough(spark, sf_dir):
    record = F.col("record")
    rest = R.extras(record, R.canonical_label(record), ["C", "Rust"])
    return _lines(spark, sf_dir).select("doc_id", F.to_json(rest).alias("extras"))


@query(
    _KINDS
    + """
    SELECT doc_id, CASE kind WHEN 'full' THEN lang WHEN 'null' THEN NULL ELSE source END AS label
    FROM kinds
    """
)
def canonical_label(spark, sf_dir):
    label = R.canonical_label(F.col("record")).cast("string")
    return _lines(spark, sf_dir).select("doc_id", label.alias("label"))


@query(
    _KINDS
    + """
    SELECT doc_id, source, concat_ws(',',
      CASE WHEN kind IN ('numeric', 'absent') AND source NOT IN ('src3', 'src7') THEN 'id' END,
      'name',
      CASE WHEN kind IN ('full', 'null') THEN 'task_name' END,
      'C',
      CASE WHEN kind <> 'absent' THEN 'Rust' END,
      CASE WHEN kind IN ('full', 'null') AND source <> 'src7' THEN 'n' END,
      CASE WHEN kind = 'full' THEN 'tags' END) AS keys
    FROM kinds
    """
)
def drop_keys_by_source(spark, sf_dir):
    kept = R.drop_keys_by_folder(F.col("record"), F.col("source"), _DROP_RULES)
    return _lines(spark, sf_dir).select(
        "doc_id", "source", F.array_join(F.map_keys(kept), ",").alias("keys")
    )
