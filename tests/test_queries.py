"""Every query that has SQL gives DuckDB's rows."""

import os

import duckdb
import pytest

from quillspark import queries as own

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 5) if isinstance(v, float) else v
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_against_sql(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    want = duck.sql(own.ORACLES[name])
    columns = list(want.columns)
    assert sorted(df.columns) == sorted(columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLES)))
def test_runs(spark, name):
    own.QUERIES[name](spark, SF).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
