"""Every registered core query against its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import more, places
from quire.plans import queries as Q

QUERIES, SQL = Q.QUERIES | more.QUERIES | places.QUERIES, Q.SQL | more.SQL | places.SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.sql(SQL[name]).df()
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    a, b = (x[order].astype(str).replace({"nan": "None", "<NA>": "None"}).sort_values(order).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
