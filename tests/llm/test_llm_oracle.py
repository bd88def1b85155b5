"""Training-data queries that SQL can express, against DuckDB on a small data folder."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, rel = queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())
