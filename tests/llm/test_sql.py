"""Queries of the subpackage against their SQL on the smallest tables."""

import duckdb
import pytest

from listloom.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    result = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    got = sorted(tuple(r) for r in frame.select(*columns).collect())
    assert got == sorted(result) and got
