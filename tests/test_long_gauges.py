"""Gauges whose ids have more digits than the usual file names."""

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck
from test_short_fields import SF, TABLES


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    to = tmp_path_factory.mktemp("long")
    more = "union all select * replace (event_id+700000 as event_id, user_id+540000 as user_id) from t"
    for name in TABLES:
        read = f"with t as (select * from '{SF}/{name}.parquet') select * from t"
        duckdb.sql(f"copy ({read} {more if name == 'events' else ''}) to '{to}/{name}.parquet' (format parquet)")
    return str(to)


@pytest.mark.parametrize("name", ["scan_gauges", "scan_gauges_binary"])
def test_long_gauges(spark, folder, name):
    assert compare(spark, duck(folder), folder, entry.queries()[name], entry.oracle_sql()[name]) is None
