"""Every registered query against its SQL, by value; the others must give rows."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES, ORACLES = entry.QUERIES, entry.ORACLES


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    yield connection
    connection.close()


def table(frame):
    columns = sorted(frame.columns)
    return frame[columns].sort_values(columns).reset_index(drop=True)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_values_as_sql(spark, duck, name):
    got = table(QUERIES[name](spark, FOLDER).toPandas())
    want = table(duck.execute(ORACLES[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) > 0
    assert (got.isna() == want.isna()).all(axis=None)
    for column in got:
        assert got[column].dtype == want[column].dtype, column
        assert got[column].astype(str).tolist() == want[column].astype(str).tolist(), column


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 20
