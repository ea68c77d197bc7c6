"""Every core query with SQL, against that SQL, on the smallest tables."""

import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")

from corpuloom.plans.queries import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.sql(SQL[name])
    assert columns == sorted(want.columns)
    order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[i] for i in order]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    got = QUERIES[name](spark, DATA)
    assert got.columns and got.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
