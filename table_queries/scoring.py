"""Encoding, batching, padding, scoring and prediction records."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import chat as C
from pairloom.functions import tokens as K
from pairloom.operators import batches, grid
from pairloom.operators import scoring as S
from pairloom.operators.shape import computed_once
from pairloom.plans import experiments
from table_queries.chat import (
    SQL_BASELINE_PROMPT,
    SQL_EMPTY_PROMPT,
    SQL_INSTRUCTED_PROMPT,
    sql_chat,
)
from table_queries.dress import SQL_SPACE
from table_queries.pairs import SQL_PAIRS, conversation_pairs
from table_queries.registry import query, sql_text, table

_TOKENS = f"regexp_extract_all(text, {sql_text(K.TOKEN_PATTERN)})"
_CUT = f"list_slice({_TOKENS}, 1, 8192)"


@query(
    f"""
    SELECT doc_id, len({_TOKENS}) AS n_tokens, len({_CUT}) AS n_ids, len({_CUT}) AS mask_sum,
      array_to_string({_CUT}, '') AS kept
    FROM documents
    """
)
def encode_truncate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = computed_once(docs, {"tokens": K.encode(F.col("text"))})
    ids = K.truncate(F.col("tokens"))
    mask_sum = F.aggregate(K.attention_mask(ids), F.lit(0), lambda a, x: a + x)
    return encoded.select(
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.size(ids).cast("bigint").alias("n_ids"),
        mask_sum.cast("bigint").alias("mask_sum"),
        F.array_join(ids, "").alias("kept"),
    )


_SQL_TURNS = SQL_PAIRS + """
    , rendered AS (
      SELECT CASE WHEN c_code IS NOT NULL AND safe_rust_code IS NOT NULL THEN {0} ELSE {1} END
        AS text FROM pairs
    )
"""


@query(
    _SQL_TURNS.format(
        SQL_INSTRUCTED_PROMPT.replace(
            "concat('<|im_start|>assistant', chr(10))",
            "concat('<|im_start|>assistant', chr(10), safe_rust_code, '<|im_end|>', chr(10))",
        ),
        sql_chat(("user", "''"), ("assistant", "''")),
    )
    + f"""
    SELECT array_to_string({_CUT}, '|') AS input_ids,
      array_to_string(list_transform({_CUT}, lambda x: '1'), '') AS attention_mask
    FROM rendered
    """
)
def encode_only(spark, sf_dir):
    """Training rows carry ids and mask and none of the source columns."""
    rows = experiments.training_examples(conversation_pairs(spark, sf_dir))
    return rows.select(
        F.array_join("input_ids", "|").alias("input_ids"),
        F.array_join("attention_mask", "").alias("attention_mask"),
    )


_SQL_BATCHES = """
    WITH numbered AS (
      SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id) - 1) // 4 AS batch_id
      FROM documents
    )
"""


@query(_SQL_BATCHES + "SELECT doc_id, batch_id FROM numbered")
def batch_ids(spark, sf_dir):
    return batches.batch_ids(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(
    _SQL_BATCHES
    + f"""
    , encoded AS (SELECT doc_id, batch_id, {_TOKENS} AS ids FROM numbered),
    sized AS (
      SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM encoded
    )
    SELECT doc_id, batch_id, width,
      concat(repeat('_', width - len(ids)), array_to_string(ids, '')) AS padded,
      concat(repeat('0', width - len(ids)), repeat('1', len(ids))) AS mask
    FROM sized
    """
)
def left_pad(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    padded = batches.padded_batches(docs, "doc_id", K.encode(F.col("text")), F.lit("_"))
    return padded.select(
        "doc_id",
        "batch_id",
        F.size("input_ids").cast("bigint").alias("width"),
        F.array_join("input_ids", "").alias("padded"),
        F.array_join("attention_mask", "").alias("mask"),
    )


@query("SELECT doc_id, source, text FROM documents ORDER BY doc_id LIMIT 4")
def dry_run_limit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return batches.first_batch(docs, ["doc_id"])


@query(
    f"""
    SELECT conv_id, turn, len({_TOKENS}) AS n_generated, text AS generated FROM conversations
    """
)
def slice_completion(spark, sf_dir):
    """Prompt and answer tokens in one array, as a model returns them; the prompt is cut."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    prompt = K.encode(
        C.render_chat(C.messages_inference(F.col("text")), add_generation_prompt=True)
    )
    made = computed_once(turns, {"prompt": prompt, "answer": K.encode(F.col("text"))})
    output = F.concat("prompt", "answer")
    generated = K.slice_completion(output, F.size("prompt"))
    return made.select(
        "conv_id",
        "turn",
        F.size(generated).cast("bigint").alias("n_generated"),
        F.array_join(generated, "").alias("generated"),
    )


@query(
    """
    SELECT conv_id, turn, concat(role, chr(10), text, chr(10)) AS decoded FROM conversations
    """
)
def decode_tokens(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    rendered = C.render_chat(
        F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("content")))
    )
    decoded = K.decode(K.encode(rendered), ("<|im_start|>", "<|im_end|>"))
    return turns.select("conv_id", "turn", decoded.alias("decoded"))


_SQL_ANSWERS = (
    SQL_PAIRS
    + f"""
    , models(model_type) AS (VALUES ('Baseline'), ('Proposed')),
    prompts AS (
      SELECT *, CASE WHEN c_code IS NULL OR safe_rust_code IS NULL THEN {SQL_EMPTY_PROMPT}
           WHEN model_type = 'Proposed' THEN {SQL_INSTRUCTED_PROMPT}
           ELSE {SQL_BASELINE_PROMPT} END AS prompt
      FROM pairs, models
    )
    """
)


def _answers(spark, sf_dir):
    def answering_model():
        """Stand-in for a model; marks its answers and leaves blanks around them."""
        return lambda prompts: [f" \n{p}-- done\t" for p in prompts]

    rows = experiments.prompts(grid.over_models(conversation_pairs(spark, sf_dir)))
    return rows.withColumn("answer", S.score(F.col("prompt"), answering_model))


@query(_SQL_ANSWERS + "SELECT conv_id, model_type, concat(prompt, '-- done') AS answer FROM prompts")
def score_batches(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "model_type", "answer")


@query(
    _SQL_ANSWERS
    + """
    SELECT conv_id, model_type, c_code AS original_c, safe_rust_code AS true_rust,
      concat(prompt, '-- done') AS predicted_rust
    FROM prompts
    """
)
def prediction_records(spark, sf_dir):
    return S.prediction_records(
        _answers(spark, sf_dir), "c_code", "safe_rust_code", "answer", ["conv_id", "model_type"]
    )


@query(
    """
    SELECT doc_id, text, concat('quality ', quality) AS predicted
    FROM documents JOIN labels USING (doc_id)
    """
)
def zip_predictions(spark, sf_dir):
    examples = table(spark, sf_dir, "documents").select("doc_id", "text")
    predictions = table(spark, sf_dir, "labels").select(
        "doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("predicted")
    )
    return S.zip_predictions(examples, predictions, ["doc_id"])


@query(f"SELECT conv_id, turn, trim(text, {SQL_SPACE}) AS translation FROM conversations")
def translate_snippets(spark, sf_dir):
    def fencing_model():
        """Stand-in for a model that returns the user's snippet in a fenced block."""

        def answer(prompts: list[str]) -> list[str]:
            snippets = [p.split("<|im_start|>user\n")[1].split("<|im_end|>")[0] for p in prompts]
            return [f"Sure.\n```rust\n{s}\n```\n" for s in snippets]

        return answer

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return experiments.translate(turns, "text", fencing_model).drop("text")
