"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def _cells(row):
    return tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(entry_module.QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = entry_module.queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    got = sorted(_cells(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect())
    result = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(_cells([row[i] for i in order]) for row in result.fetchall())
    assert got == expected and got


def test_every_query_has_sql():
    assert set(entry_module.QUERIES) <= set(entry_module.oracle_sql())


def test_entry(spark):
    frame = entry_module.entry(spark)
    assert frame.columns[0] == "p_partkey" and len(frame.columns) == 23
