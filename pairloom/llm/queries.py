"""The operators as queries over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decontamination, embeddings, language_model, lexical, licenses, periodic, pieces, secrets, sharding, simhash, substrings, token_counts, toxicity
from pairloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def oracle(sql: str):
    """Registers a query together with its SQL."""

    def with_sql(f):
        ORACLES[f.__name__] = sql
        return query(f)

    return with_sql


@query
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), count=16)


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_counts.tokenizer_path("word_bpe_49k.json")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path, limit=2048).drop("prefix_tokens")


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.col("found")).alias("spans"),
    )


@query
def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = pieces.model_path("piece_bpe_32k.model")
    return pieces.sampled_pieces(table(spark, sf_dir, "documents"), path, dropout=0.1, seed=42)


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, most=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint_bits"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.pseudo_likelihood(table(spark, sf_dir, "documents"))


#: A word is a run of characters other than ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def periodic_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in a tenth of the documents the words from one place on go round in a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    keyed = docs.select("doc_id", "text", h.alias("h"), F.expr("h div 10").alias("g"))
    split = keyed.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))))
    sized = split.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    period = sized.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a))")
    return period.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic_texts(table(spark, sf_dir, "documents")), least=6, times=4)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top_run.start",
        "top_run.length",
        "top_run.period",
        F.expr("1000 * top_run.length div top_run.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@oracle(
    r"""
    WITH texts AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), places AS (
      SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS place FROM texts
    ), windows AS (
      SELECT doc_id, place, row_number() OVER (
        PARTITION BY array_to_string(list_slice(words, place, place + 19), ' ') ORDER BY doc_id, place) > 1 AS later
      FROM places WHERE place + 19 <= len(words)
    ), covered AS (
      SELECT p.doc_id, p.place, words[p.place] AS word,
             coalesce(max(later::int) OVER (PARTITION BY p.doc_id ORDER BY p.place ROWS 19 PRECEDING), 0) AS gone
      FROM places p LEFT JOIN windows w USING (doc_id, place)
    ), kept AS (
      SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (gone = 0) AS text
      FROM covered GROUP BY doc_id
    )
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
           sha256(coalesce(k.text, '')) AS kept_sha256
    FROM texts LEFT JOIN kept k USING (doc_id)
    """
)
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@oracle(
    r"""
    WITH terms AS (
      SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM documents
    ), asked AS (
      SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark
    ), total AS (
      SELECT count(DISTINCT doc_id)::BIGINT AS all_docs, count(*)::BIGINT AS all_terms FROM terms
    ), sized AS (
      SELECT doc_id, 25 + (75 * count(*)::BIGINT * any_value(all_docs)) // any_value(all_terms) AS m
      FROM terms, total GROUP BY doc_id
    ), postings AS (
      SELECT term, doc_id, count(*)::BIGINT AS tf FROM terms GROUP BY term, doc_id
    ), weights AS (
      SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(all_docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
      FROM postings, total GROUP BY term
    ), wanted AS (
      SELECT item_id, term, count(*)::BIGINT AS times FROM asked GROUP BY item_id, term
    ), scored AS (
      SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM wanted JOIN weights USING (term) JOIN postings USING (term) JOIN sized USING (doc_id)
      GROUP BY item_id, doc_id
    ), placed AS (
      SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
      FROM scored WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
    """
)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)
