"""Every catalogue query against its SQL in an independent engine."""

from __future__ import annotations

import duckdb
import pytest
from helpers import DATA

import __spark_entry__ as entry
from dwellgrid.catalog import oracle, queries
from tools.compare import TABLES, bag

QUERIES, SQL = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return connection


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["floor", "occ_rate_percent"]
    assert df.count() == 25


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    mine = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert mine
        return
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert bag(df.columns, mine) == bag(names, result.fetchall())
