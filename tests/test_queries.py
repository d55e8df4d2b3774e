"""Every registered query with SQL against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("nan" if isinstance(r[i], float) and math.isnan(r[i]) else repr(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, DIR)
    want = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql_or_is_known_to_have_none():
    from annulus.plans import catalog, oracle

    assert set(catalog.QUERIES) == set(oracle.SQL)
