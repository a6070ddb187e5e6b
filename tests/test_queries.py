"""Every registered query with SQL gives the rows of its SQL; every other one runs."""

import os

import duckdb
import pytest

from barloom.plans import oracles, queries

SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    for name in os.listdir(sf):
        table = name.removesuffix(".parquet")
        out.sql(f"create view {table} as select * from '{sf}/{name}'")
    return out


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_sql(spark, sf, con, name):
    df = queries.queries()[name](spark, sf)
    found = con.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    place = [list(found.columns).index(c) for c in columns]
    want = sorted(repr(tuple(row[i] for i in place)) for row in found.fetchall())
    assert sorted(repr(tuple(row[c] for c in columns)) for row in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_runs_twice_alike(spark, sf, name):
    run = queries.queries()[name]
    assert sorted(map(repr, run(spark, sf).collect())) == sorted(map(repr, run(spark, sf).collect()))
