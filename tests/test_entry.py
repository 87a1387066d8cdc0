"""Every registered query over the smallest test tables, held against its SQL."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(x):
    return None if x is None or x != x else round(x, 6) if isinstance(x, float) else x


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    text = entry.oracle_sql().get(name)
    if text is None:
        return
    found = sql.sql(text)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    key = lambda t: tuple((x is not None, x) for x in t)
    assert sorted(got, key=key) == sorted(want, key=key)
