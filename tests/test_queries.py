"""Every registered query against its SQL counterpart, and rules for the whole library."""

import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from conftest import ROOT, SF
from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import TABLES
from table_queries import QUERIES


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, database, name):
    df = queries()[name](spark, SF)
    cursor = database.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert by_name(df.columns, map(tuple, df.collect())) == by_name(columns, cursor.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_library_uses_no_unsafe_operations():
    banned = re.compile(
        r"localCheckpoint|crossJoin|\.toPandas\(|\.rdd\.(?!getNumPartitions)|dropDuplicates\(\)"
        r"|randomSplit|\brand\(|sample\(|F\.udf"
    )
    for path in [*Path(ROOT, "pairloom").rglob("*.py"), *Path(ROOT, "table_queries").rglob("*.py")]:
        assert not banned.search(path.read_text()), path
