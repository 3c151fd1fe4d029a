"""Every relational query against DuckDB on the small tables."""

import os

import duckdb
import pytest

from lodestone import suite

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", suite.queries())
def test_same_rows_as_sql(spark, duck, name):
    df = suite.queries()[name](spark, FOLDER)
    want = duck.sql(suite.oracle_sql()[name])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(suite.queries()) == set(suite.oracle_sql())
