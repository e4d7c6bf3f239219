"""Queries against their SQL on tables whose last field lacks most of its cells, with points in its run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import TABLES, compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MORE = {
    "embeddings": "select * replace (vec_id+500 as vec_id) from t where vec_id<256",
    "events": "select * replace (event_id+10000 as event_id) from t where event_id%2=0",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    to = tmp_path_factory.mktemp("short")
    for name in TABLES:
        read = f"with t as (select * from '{SF}/{name}.parquet') select * from t"
        duckdb.sql(f"copy ({read} {'union all ' + MORE[name] if name in MORE else ''}) to '{to}/{name}.parquet' (format parquet)")
    return str(to)


NAMES = """
sample_nearest
sample_bilinear
sample_wet_bilinear
sample_finest
sample_finest_nearest
sampled_face_counts
sampled_source_rates
scan_deform
scan_deform_single_column
""".split()


@pytest.mark.parametrize("name", NAMES)
def test_short_fields(spark, folder, name):
    assert compare(spark, duck(folder), folder, entry.queries()[name], entry.oracle_sql()[name]) is None
