"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got, sql = rows_of(df.columns, df.collect()), entry.oracle_sql().get(name)
    if sql:
        cur = con.execute(sql)
        columns = [x[0] for x in cur.description]
        assert sorted(df.columns) == sorted(columns)
        assert got == rows_of(columns, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
