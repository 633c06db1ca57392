"""Token arrays: encode, truncate, mask, cut, decode.

The built-in encoding cuts text with a regular expression; the pieces joined together
give the text back.  A caller's own tokenizer goes through
``pairloom.operators.scoring.encode_with``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.constants import IGNORE_INDEX, MAX_SEQ_LENGTH

# Chat markers, runs of letters/digits, runs of whitespace, single other characters.
TOKEN_PATTERN = r"<\|[a-z_]+\|>|[\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s]"


def encode(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def truncate(ids: Column, max_length: int = MAX_SEQ_LENGTH) -> Column:
    return F.slice(ids, 1, max_length)


def encode_truncate(
    text: Column, max_length: int = MAX_SEQ_LENGTH, pattern: str = TOKEN_PATTERN
) -> Column:
    return truncate(encode(text, pattern), max_length)


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def left_padded(ids: Column, width: Column, pad: Column) -> Column:
    return F.concat(F.array_repeat(pad, width - F.size(ids)), ids)


def left_padded_mask(ids: Column, width: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(0), width - F.size(ids)), attention_mask(ids))


def completion_labels(
    ids: Column, marker: Column, ignore: Column | None = None
) -> Column:
    """Labels for a loss over the completion only.

    Everything up to and including the last occurrence of ``marker`` (an array) is
    ignored; without a marker everything is.
    """
    mask = F.lit(IGNORE_INDEX) if ignore is None else ignore
    width = F.size(marker)
    last_start = F.size(ids) - width
    starts = F.filter(
        F.when(last_start >= 0, F.sequence(F.lit(0), last_start)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: (F.get(ids, i) == F.get(marker, F.lit(0)))
        & (F.slice(ids, i + 1, width) == marker),
    )
    # Built from two stretches: an index test per element would search the marker anew
    # for every token.
    cut = F.coalesce(F.array_max(starts) + width, F.size(ids))
    return F.concat(F.array_repeat(mask, cut), F.slice(ids, cut + 1, F.size(ids)))


def slice_completion(output: Column, prompt_length: Column) -> Column:
    """Cut the prompt off the front of the generated ids."""
    return F.slice(output, prompt_length + 1, F.size(output))


def decode(tokens: Column, specials: tuple[str, ...] = ()) -> Column:
    kept = F.filter(tokens, lambda t: ~t.isin(*specials)) if specials else tokens
    return F.array_join(kept, "")
