"""Every registered query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest
from conftest import TESTDATA

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{TESTDATA}/{table}.parquet'")
    return connection


def _value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else float(v)
    return v


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_value(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    result = entry.queries()[name](spark, TESTDATA)
    expected = duck.sql(entry.oracle_sql()[name])
    assert _rows(result.columns, result.collect()) == _rows(expected.columns, expected.fetchall())


UNCHECKED = [n for n in entry.queries() if n not in entry.oracle_sql()]


@pytest.mark.parametrize("name", UNCHECKED)
def test_runs(spark, name):
    assert entry.queries()[name](spark, TESTDATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
