"""Filters and projections of the corpus build."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.constants import ALLOWED_LANGUAGES
from pairloom.functions.records import has_keys, is_string
from pairloom.functions.text import is_blank


def allowed_languages(
    df: DataFrame, language: str, allowed: Sequence[str] = ALLOWED_LANGUAGES
) -> DataFrame:
    """Case-sensitive allow-list; reaches the Parquet scan as an ``In`` filter."""
    return df.where(F.col(language).isin(*allowed))


def with_key(df: DataFrame, key: str) -> DataFrame:
    """Rows with a key; the empty string is a key."""
    return df.where(F.col(key).isNotNull())


def non_blank(df: DataFrame, line: str) -> DataFrame:
    return df.where(~is_blank(F.col(line)))


def with_record_keys(df: DataFrame, record: str, keys: Sequence[str]) -> DataFrame:
    return df.where(has_keys(F.col(record), keys))


def with_string_values(df: DataFrame, record: str, keys: Sequence[str]) -> DataFrame:
    condition = F.lit(True)
    for key in keys:
        condition = condition & is_string(F.col(record), key)
    return df.where(condition)


def both_present(df: DataFrame, first: str, second: str) -> DataFrame:
    """Both sides neither null nor empty."""
    return df.where((F.length(first) > 0) & (F.length(second) > 0))

