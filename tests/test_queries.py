"""Every registered query against its SQL, on the test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import oracle

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, STATEMENTS = {k: v for k, v in entry.queries().items() if k in entry._QUERIES or k in entry._FOLDER_QUERIES}, oracle.statements()
KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE", "int": "INTEGER",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("customer", "orders", "events"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    expected = duck.sql(STATEMENTS[name])
    columns = sorted(result.columns)
    assert columns == sorted(expected.columns)
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: KINDS[result.schema[c].dataType.simpleString()] for c in columns} == kinds
    order = [expected.columns.index(c) for c in columns]
    rows = sorted(repr(tuple(row)) for row in result.select(*[f"`{c}`" for c in columns]).collect())
    assert rows == sorted(repr(tuple(row[i] for i in order)) for row in expected.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 123


def test_ordered_results_keep_their_order(spark):
    export = [row["Total Gasto"] for row in QUERIES["customer_frequency_export"](spark, FOLDER).collect()]
    assert export == sorted(export, reverse=True)
    bands = [row["faixa"] for row in QUERIES["repurchase_cycle"](spark, FOLDER).collect()]
    assert bands == sorted(bands) and len(bands) == 10
