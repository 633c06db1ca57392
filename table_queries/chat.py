"""Chat messages built from conversation pairs, one row per message or the chat text."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.constants import BASELINE_PREFIX, RESPONSE_MARKER, SYSTEM_PROMPT
from pairloom.functions import chat as C
from pairloom.functions import tokens as K
from pairloom.operators import grid
from pairloom.operators.shape import computed_once
from table_queries.pairs import SQL_PAIRS, conversation_pairs
from table_queries.registry import query, sql_text, table

_BOTH = "c_code IS NOT NULL AND safe_rust_code IS NOT NULL"
_SYSTEM = sql_text(SYSTEM_PROMPT)
_PREFIX = sql_text(BASELINE_PREFIX)


def _per_message(df, messages, keys=("conv_id",)):
    rows = df.select(*keys, F.posexplode(messages).alias("pos", "message"))
    return rows.select(*keys, "pos", "message.role", "message.content")


_SQL_BASELINE = f"""
    SELECT conv_id, 0 AS pos, 'user' AS role,
      CASE WHEN {_BOTH} THEN concat({_PREFIX}, c_code) ELSE '' END AS content FROM pairs
    UNION ALL
    SELECT conv_id, 1, 'assistant', CASE WHEN {_BOTH} THEN safe_rust_code ELSE '' END FROM pairs
"""
_SQL_INSTRUCTED = f"""
    SELECT conv_id, 0 AS pos, 'system' AS role, {_SYSTEM} AS content FROM pairs WHERE {_BOTH}
    UNION ALL SELECT conv_id, 1, 'user', c_code FROM pairs WHERE {_BOTH}
    UNION ALL SELECT conv_id, 2, 'assistant', safe_rust_code FROM pairs WHERE {_BOTH}
    UNION ALL SELECT conv_id, 0, 'user', '' FROM pairs WHERE NOT ({_BOTH})
    UNION ALL SELECT conv_id, 1, 'assistant', '' FROM pairs WHERE NOT ({_BOTH})
"""


@query(SQL_PAIRS + _SQL_BASELINE)
def messages_baseline(spark, sf_dir):
    pairs = conversation_pairs(spark, sf_dir)
    return _per_message(pairs, C.messages_baseline(F.col("c_code"), F.col("safe_rust_code")))


@query(SQL_PAIRS + _SQL_INSTRUCTED)
def messages_instructed(spark, sf_dir):
    pairs = conversation_pairs(spark, sf_dir)
    return _per_message(pairs, C.messages_instructed(F.col("c_code"), F.col("safe_rust_code")))


@query(
    SQL_PAIRS
    + f""", messages AS ({_SQL_INSTRUCTED})
    SELECT * FROM messages WHERE role <> 'assistant'
    """
)
def messages_prompt_only(spark, sf_dir):
    pairs = conversation_pairs(spark, sf_dir)
    messages = C.messages_instructed(F.col("c_code"), F.col("safe_rust_code"))
    return _per_message(pairs, C.prompt_only(messages))


@query(
    f"""
    SELECT conv_id, turn, 0 AS pos, 'system' AS role, {_SYSTEM} AS content FROM conversations
    UNION ALL SELECT conv_id, turn, 1, 'user', text FROM conversations
    """
)
def messages_inference(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return _per_message(turns, C.messages_inference(F.col("text")), ("conv_id", "turn"))


def sql_chat(*turns: tuple[str, str], prompt: bool = False) -> str:
    """SQL for the chat text of (role, content expression) turns."""
    parts = [
        f"concat('<|im_start|>{role}', chr(10), {content}, '<|im_end|>', chr(10))"
        for role, content in turns
    ]
    if prompt:
        parts.append("concat('<|im_start|>assistant', chr(10))")
    return f"concat({', '.join(parts)})"


SQL_EMPTY_PROMPT = sql_chat(("user", "''"), prompt=True)
SQL_INSTRUCTED_PROMPT = sql_chat(("system", _SYSTEM), ("user", "c_code"), prompt=True)
SQL_BASELINE_PROMPT = sql_chat(("user", f"concat({_PREFIX}, c_code)"), prompt=True)
_SQL_RENDERED = sql_chat(
    ("system", _SYSTEM), ("user", "c_code"), ("assistant", "safe_rust_code")
)
_SQL_EMPTY = sql_chat(("user", "''"), ("assistant", "''"))


@query(
    SQL_PAIRS
    + f"""
    SELECT conv_id,
      CASE WHEN {_BOTH} THEN {_SQL_RENDERED} ELSE {_SQL_EMPTY} END AS rendered,
      CASE WHEN {_BOTH} THEN {SQL_INSTRUCTED_PROMPT} ELSE {SQL_EMPTY_PROMPT} END AS prompt
    FROM pairs
    """
)
def render_chat(spark, sf_dir):
    pairs = conversation_pairs(spark, sf_dir)
    messages = C.messages_instructed(F.col("c_code"), F.col("safe_rust_code"))
    return pairs.select(
        "conv_id",
        C.render_chat(messages).alias("rendered"),
        C.render_chat(C.prompt_only(messages), add_generation_prompt=True).alias("prompt"),
    )


@query(
    SQL_PAIRS
    + f"""
    , models(model_type) AS (VALUES ('Baseline'), ('Proposed'))
    SELECT conv_id, model_type,
      CASE WHEN NOT ({_BOTH}) THEN {SQL_EMPTY_PROMPT}
           WHEN model_type = 'Proposed' THEN {SQL_INSTRUCTED_PROMPT}
           ELSE {SQL_BASELINE_PROMPT} END AS prompt
    FROM pairs, models
    """
)
def messages_by_model(spark, sf_dir):
    rows = grid.over_models(conversation_pairs(spark, sf_dir))
    messages = C.messages_by_model(F.col("model_type"), F.col("c_code"), F.col("safe_rust_code"))
    return rows.select(
        "conv_id",
        "model_type",
        C.render_chat(C.prompt_only(messages), add_generation_prompt=True).alias("prompt"),
    )


# Every turn is rendered with its own role: user and system turns have no response marker.
_TURN_TEXT = (
    "concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10))"
)
_TOKEN_SQL = sql_text(K.TOKEN_PATTERN)


@query(
    f"""
    WITH turns AS (SELECT conv_id, turn, role, {_TURN_TEXT} AS rendered FROM conversations),
    cut AS (
      SELECT *, len(regexp_extract_all(rendered, {_TOKEN_SQL})) AS n_tokens,
        CASE WHEN role = 'assistant'
             THEN substr(rendered, length('<|im_start|>assistant') + 2) ELSE '' END AS completion
      FROM turns
    )
    SELECT conv_id, turn, completion, n_tokens,
      n_tokens - len(regexp_extract_all(completion, {_TOKEN_SQL})) AS n_ignored,
      completion AS kept
    FROM cut
    """
)
def completion_mask(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").select("conv_id", "turn", F.expr(_TURN_TEXT).alias("rendered"))
    encoded = computed_once(
        turns, {"ids": K.encode(F.col("rendered")), "marker": K.encode(F.lit(RESPONSE_MARKER))}
    )
    labels = K.completion_labels(F.col("ids"), F.col("marker"), F.lit("-100"))
    labelled = computed_once(encoded, {"labels": labels})
    ignored = F.filter("labels", lambda x: x == "-100")
    kept = F.filter("labels", lambda x: x != "-100")
    return labelled.select(
        "conv_id",
        "turn",
        C.completion_text(F.col("rendered")).alias("completion"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.size(ignored).cast("bigint").alias("n_ignored"),
        F.array_join(kept, "").alias("kept"),
    )
