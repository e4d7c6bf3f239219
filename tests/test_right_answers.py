"""Inputs that once gave wrong answers: runs that lose frames, short rasters, columns in another order, models on other grids."""

import pytest

from gridspark.operators import ranking
from gridspark.sources import sinks, text


def test_a_changed_run_loses_its_old_frames(spark, tmp_path):
    path = str(tmp_path / "cells")
    cells = lambda rows: spark.createDataFrame(rows, "run string, frame int, i int, j int, h double")
    prints = lambda *p: spark.createDataFrame(p, "run string, fingerprint string")
    back = lambda: sorted((r.run, int(r.frame), r.h) for r in sinks.published_cells(spark, path).collect())
    sinks.write_cells(cells([("a", 0, 0, 0, 1.0), ("a", 1, 0, 0, 2.0), ("b", 0, 0, 0, 3.0)]), path, prints(("a", "1"), ("b", "1")))
    assert back() == [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)]
    done = sinks.write_cells(cells([("a", 0, 0, 0, 5.0), ("b", 0, 0, 0, -1.0)]), path, prints(("a", "2"), ("b", "1")))
    assert [r.run for r in done.collect()] == ["a"] and back() == [("a", 0, 5.0), ("b", 0, 3.0)]
    assert sinks.drop_old_versions(spark, path) == []  # b still lives in the first version
    sinks.write_cells(cells([("b", 0, 0, 0, 4.0)]), path, prints(("b", "2")))
    assert len(sinks.drop_old_versions(spark, path)) == 1 and back() == [("a", 0, 5.0), ("b", 0, 4.0)]
    # A job that fails before the manifest is switched leaves what was valid.
    (tmp_path / "cells" / "version=broken" / "run=a" / "frame=0").mkdir(parents=True)
    assert back() == [("a", 0, 5.0), ("b", 0, 4.0)]


@pytest.mark.parametrize("rows", ["1 2\n", "1 2\n3 4\n5 6\n"])
def test_rasters_of_another_number_of_rows(spark, tmp_path, rows):
    (tmp_path / "dem.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\n" + rows)
    cells, grids = text.scan_raster_text(spark, str(tmp_path))
    for table in (cells, grids):
        with pytest.raises(Exception, match="shape differs"):
            table.collect()


def test_subfault_columns_in_any_order(spark, tmp_path):
    for name, content in (
        ("a", "Longitude,Latitude,Depth(km),Slip\n1,2,3,4\n"), ("b", "Slip,Depth(m),Other,Latitude,Longitude\n8,7000,x,6,5\n9,8000,\"y,z\",6,5\n"), ("c", "Latitude,Longitude\n1,2\n"),
    ):
        (tmp_path / name).mkdir()
        (tmp_path / name / "faults.csv").write_text(content)
    got = {(r.fault, r.longitude, r.latitude, r.depth, r.slip) for r in text.scan_subfaults(spark, str(tmp_path)).collect()}
    assert got == {("a", 1.0, 2.0, 3000.0, 4.0), ("b", 5.0, 6.0, 7000.0, 8.0), ("b", 5.0, 6.0, 8000.0, 9.0), ("c", 2.0, 1.0, None, None)}


def test_pairs_on_other_grids_are_an_error(spark):
    e = spark.createDataFrame([("c", m, i, 0, float(i + k)) for k, m in enumerate("xy") for i in range(4)], "case string, model string, i int, j int, v double")
    grid = lambda *g: spark.createDataFrame(g, "case string, model string, ncols int, nrows int, cellsize double, xmin double, ymin double")
    same = ranking.model_pairs(e, grids=grid(("c", "x", 4, 1, 1.0, 0.0, 0.0), ("c", "y", 4, 1, 1.0, 1e-10, 0.0))).collect()
    assert [(r.a, r.b) for r in same] == [("x", "y")]
    for other, said in ((("c", "y", 5, 1, 1.0, 0.0, 0.0), "shape differs"), (("c", "y", 4, 1, 1.0, 0.5, 0.0), "x centres differ"), (("c", "z", 4, 1, 1.0, 0.0, 0.0), "no grid")):
        with pytest.raises(Exception, match=said):
            ranking.model_pairs(e, grids=grid(("c", "x", 4, 1, 1.0, 0.0, 0.0), other)).collect()
