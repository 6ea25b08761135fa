"""Every registered query that has a SQL twin, beside it (about nine minutes)."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    r = con.execute(SQL[name])
    assert compare(df.columns, rows, [d[0] for d in r.description], r.fetchall()) == "ok"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
