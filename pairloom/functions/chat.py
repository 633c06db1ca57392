"""Chat messages: ARRAY<STRUCT<role STRING, content STRING>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.constants import (
    BASELINE_PREFIX,
    CHAT_END,
    CHAT_START,
    RESPONSE_MARKER,
    SYSTEM_PROMPT,
)


def message(role: str, content: Column | str) -> Column:
    body = F.lit(content) if isinstance(content, str) else content
    return F.struct(F.lit(role).alias("role"), body.alias("content"))


def _or_empty_turns(source: Column, target: Column, messages: Column) -> Column:
    """A record with a missing side becomes two empty turns."""
    empty = F.array(message("user", ""), message("assistant", ""))
    return F.when(source.isNotNull() & target.isNotNull(), messages).otherwise(empty)


def messages_baseline(source: Column, target: Column, prefix: str = BASELINE_PREFIX) -> Column:
    turns = F.array(
        message("user", F.concat(F.lit(prefix), source)), message("assistant", target)
    )
    return _or_empty_turns(source, target, turns)


def messages_instructed(
    source: Column, target: Column, system_prompt: str = SYSTEM_PROMPT
) -> Column:
    turns = F.array(
        message("system", system_prompt), message("user", source), message("assistant", target)
    )
    return _or_empty_turns(source, target, turns)


def messages_by_model(
    model_type: Column,
    source: Column,
    target: Column,
    system_prompt: str = SYSTEM_PROMPT,
    prefix: str = BASELINE_PREFIX,
) -> Column:
    """Instructed form for the trained model, bare form for every other."""
    return F.when(
        model_type == "Proposed", messages_instructed(source, target, system_prompt)
    ).otherwise(messages_baseline(source, target, prefix))


def messages_inference(source: Column, system_prompt: str = SYSTEM_PROMPT) -> Column:
    return F.array(message("system", system_prompt), message("user", source))


def prompt_only(messages: Column) -> Column:
    """All but the last message (nothing is left of none or one)."""
    return F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))


def render_chat(
    messages: Column,
    add_generation_prompt: bool = False,
    start: str = CHAT_START,
    end: str = CHAT_END,
) -> Column:
    """Chat text in the ``<start>role\\ncontent<end>\\n`` form."""
    turns = F.transform(
        messages,
        lambda m: F.concat(
            F.lit(start), m["role"], F.lit("\n"), m["content"], F.lit(f"{end}\n")
        ),
    )
    text = F.array_join(turns, "")
    return F.concat(text, F.lit(f"{start}assistant\n")) if add_generation_prompt else text


def completion_text(rendered: Column, marker: str = RESPONSE_MARKER) -> Column:
    """The text after the last response marker; empty when there is no marker."""
    return F.when(
        F.contains(rendered, F.lit(marker)), F.substring_index(rendered, marker, -1)
    ).otherwise(F.lit(""))
