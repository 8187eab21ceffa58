"""Every query with SQL against DuckDB on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__
from scriptorium.plans import catalogue


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = sorted((plain(tuple(r)) for r in df.collect()), key=repr)
    assert got or name == "chunk_pages"  # no source has more than 20 documents here
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        at = [want.columns.index(c) for c in df.columns]
        assert got == sorted((plain(tuple(r[i] for i in at)) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
