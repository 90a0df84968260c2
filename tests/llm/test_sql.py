"""Queries of the operators that SQL can express, against it."""

from __future__ import annotations

import duckdb
import pytest

from clientela.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "embeddings", "conversations")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result, expected = queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name])
    columns = sorted(result.columns)
    assert columns == sorted(expected.columns)
    order = [expected.columns.index(c) for c in columns]
    rows = sorted(repr(tuple(row)) for row in result.select(*columns).collect())
    assert rows and rows == sorted(repr(tuple(row[i] for i in order)) for row in expected.fetchall())
