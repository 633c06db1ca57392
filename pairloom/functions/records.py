"""JSON records with keys that are not known in advance.

A record is MAP<STRING, VARIANT>: the type of every value, the order of the keys and the
difference between an absent key and an explicit null all survive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD_TYPE = "map<string,variant>"


def parse_record(line: Column) -> Column:
    """One JSON object per line; anything else stops the job.

    A key given twice keeps its first place and its last value.
    """
    parsed = F.from_json(line, RECORD_TYPE, {"mode": "FAILFAST"})
    # One-element transform: the parsed record is used several times but made once.
    return F.get(F.transform(F.array(parsed), _last_value_per_key), F.lit(0))


def _last_value_per_key(record: Column) -> Column:
    keys = F.map_keys(record)
    once = F.array_distinct(keys)
    entries = F.map_entries(record)

    def newest(key: Column) -> Column:
        same = F.filter(entries, lambda e: e["key"] == key)
        return F.struct(key.alias("key"), F.element_at(same, -1)["value"].alias("value"))

    rebuilt = F.map_from_entries(F.transform(once, newest))
    return F.when(F.size(keys) == F.size(once), record).otherwise(rebuilt)


def has_keys(record: Column, keys: Sequence[str]) -> Column:
    """Presence of all keys; a null value counts as present."""
    present = F.lit(True)
    for key in keys:
        present = present & F.map_contains_key(record, key)
    return present


def is_string(record: Column, key: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_element_at(record, F.lit(key))) == "STRING", F.lit(False))


def string_value(record: Column, key: str) -> Column:
    """The value where it is a JSON string, else null."""
    value = F.try_element_at(record, F.lit(key))
    return F.when(is_string(record, key), F.variant_get(value, "$", "string"))


def canonical_label(record: Column) -> Column:
    """The record's label as VARIANT; null when there is none.

    ``task_name`` decides if the key is there, even if its value is null; only without
    that key ``name`` is looked at.
    """
    label = F.when(
        F.map_contains_key(record, "task_name"), F.try_element_at(record, F.lit("task_name"))
    ).when(F.map_contains_key(record, "name"), F.try_element_at(record, F.lit("name")))
    return F.when(~F.is_variant_null(label), label)


def without_keys(record: Column, keys: Sequence[str]) -> Column:
    return F.map_filter(record, lambda k, _: ~k.isin(*keys)) if keys else record


def extras(record: Column, label: Column, consumed: Sequence[str]) -> Column:
    """All keys not turned into columns.

    A record without a label is left as it is, so its ``name`` / ``task_name`` stay.
    """
    rest = without_keys(record, consumed)
    return F.when(label.isNull(), rest).otherwise(without_keys(rest, ["task_name", "name"]))


def drop_keys_by_folder(
    record: Column, folder: Column, rules: dict[str, Sequence[str]]
) -> Column:
    """Drop keys from the records of certain folders only."""
    out = record
    for name, keys in rules.items():
        out = F.when(folder == name, without_keys(record, list(keys))).otherwise(out)
    return out


def string_to_variant(text: Column) -> Column:
    return text.cast("variant")


def record_json(label: Column, rest: Column, columns: dict[str, Column]) -> Column:
    """JSON line: label first (when there is one), then the rest, then the columns."""
    empty = F.from_json(F.lit("{}"), RECORD_TYPE)
    head = F.when(label.isNull(), empty).otherwise(
        F.create_map(F.lit("task_name"), label)
    )
    tail = F.create_map(
        *[x for name, c in columns.items() for x in (F.lit(name), string_to_variant(c))]
    )
    return F.to_json(F.map_concat(head, rest, tail))
