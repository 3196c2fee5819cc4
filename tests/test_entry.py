"""The driver's contract: every query runs, and those with SQL equal it, on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tallyframe import catalogue

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    v = float(v) if isinstance(v, decimal.Decimal) else v
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def compare(spark, duck, query, sql):
    df = query(spark, TABLES)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = duck.execute(sql)
    there = [d[0] for d in found.description]
    assert sorted(there) == names
    assert got == sorted((tuple(plain(r[there.index(c)]) for c in names) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    if name in catalogue.ORACLES:
        compare(spark, duck, catalogue.QUERIES[name], catalogue.ORACLES[name])
    else:
        assert catalogue.QUERIES[name](spark, TABLES).count() > 0


def test_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())
