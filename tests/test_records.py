import json

import pytest
from pyspark.sql import functions as F

from pairloom.functions import records as R
from pairloom.operators import filters

LINES = [
    '{"C": "a", "Rust": "b", "name": "n", "id": 1, "x": [1, {"y": null}], "f": 1.25}',
    '{"C": null, "Rust": "b", "task_name": null, "name": "n"}',
    '{"C": 5, "Rust": "b", "task_name": "t", "name": "n"}',
    '{"Rust": "b"}',
    '{"C": "a", "Rust": "b", "task_name": 7, "e": "\\u00e9\\u4e2d"}',
    '{"C": "a", "Rust": "b", "k": 1, "z": 0, "k": "last"}',
]


@pytest.fixture
def records(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "i INT, line STRING")
    return df.select("i", R.parse_record(F.col("line")).alias("record"))


def collect(df, column):
    rows = df.select("i", column.alias("r")).collect()
    return {r["i"]: r["r"] for r in rows}


def test_round_trip_keeps_types_order_and_nulls(records):
    got = collect(records, F.to_json("record"))
    for i, line in enumerate(LINES):
        assert list(json.loads(got[i]).items()) == list(json.loads(line).items())


def test_non_ascii_stays_raw(records):
    assert "é中" in collect(records, F.to_json("record"))[4]


def test_required_keys_and_string_type(records):
    keyed = filters.with_record_keys(records, "record", ["C", "Rust"])
    assert {r["i"] for r in keyed.collect()} == {0, 1, 2, 4, 5}
    typed = filters.with_string_values(records, "record", ["C", "Rust"])
    assert {r["i"] for r in typed.collect()} == {0, 4, 5}


LABELLED = [
    '{"task_name": "n", "id": 1, "x": [1, {"y": null}], "f": 1.25, "c": "x"}',
    '{"task_name": null, "name": "n", "c": "x"}',
    '{"task_name": "t", "c": "x"}',
    '{"c": "x"}',
    '{"task_name": 7, "e": "é中", "c": "x"}',
    '{"k": "last", "z": 0, "c": "x"}',
]


def test_label_rule(records):
    record = F.col("record")
    label = R.canonical_label(record)
    lines = collect(records, R.record_json(label, R.extras(record, label, ["C", "Rust"]), {"c": F.lit("x")}))
    for i, want in enumerate(LABELLED):
        assert list(json.loads(lines[i]).items()) == list(json.loads(want).items())


def test_drop_keys_only_in_named_folder(spark, records):
    record = F.col("record")
    for folder, kept in (("a", False), ("b", True)):
        out = R.drop_keys_by_folder(record, F.lit(folder), {"a": ["id", "f"]})
        keys = collect(records, F.map_keys(out))[0]
        assert ("id" in keys) is kept and ("f" in keys) is kept and "x" in keys


@pytest.mark.parametrize("line", ['{"a": 1', "[1, 2]", "nonsense"])
def test_malformed_line_stops_the_job(spark, line):
    df = spark.createDataFrame([(line,)], "line STRING")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        df.select(F.to_json(R.parse_record(F.col("line")))).collect()
