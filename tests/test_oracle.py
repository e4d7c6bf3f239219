"""Every registered query against its SQL on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], SQL.get(name)) in (None, "no rows on both sides")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(SQL) <= set(QUERIES)
