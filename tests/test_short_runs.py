"""Queries against their SQL on tables whose last run is short, and whose keys are larger than the fixed widths of names."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import TABLES, compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Run r1 holds 256 of 500 rows; the shifts lead past six digits and past the years that two digits tell apart.
MORE = {
    "embeddings": "select * replace (vec_id+500 as vec_id) from t where vec_id<256",
    "events": "select * replace (event_id+700000 as event_id) from t",
    "part": "select * replace (p_partkey+1200000 as p_partkey) from t",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    to = tmp_path_factory.mktemp("short")
    for name in TABLES:
        read = f"with t as (select * from '{SF}/{name}.parquet') select * from t"
        duckdb.sql(f"copy ({read} {'union all ' + MORE[name] if name in MORE else ''}) to '{to}/{name}.parquet' (format parquet)")
    return str(to)


NAMES = """
composite_change
scan_frames
scan_frames_text
scan_patch_cells_binary
scan_patches_binary
scan_raster_grids
scan_raster_text
boundary_flux
cell_average
deep_water_check
gradient
flagship
tangent_speed
gradient_second_order
slope_terms
normal_vertical
names_from_files
nodal_midpoints
scan_tracks_jma
historical_max_profile
infer_geometry
last_frames
""".split()


@pytest.mark.parametrize("name", NAMES)
def test_short_runs_and_long_keys(spark, folder, name):
    assert compare(spark, duck(folder), folder, entry.queries()[name], entry.oracle_sql()[name]) is None
