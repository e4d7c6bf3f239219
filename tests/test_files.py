"""Scans of files as solvers write them."""

import json

import numpy as np
import pytest

from gridspark.sources import decks, frames, sinks, text


def test_binary_frames(spark, tmp_path):
    run = tmp_path / "run1"
    run.mkdir()
    q = np.arange(4 * 3 * 2, dtype=np.float32).reshape((4, 3, 2), order="F")
    for k in (1, 2):
        (run / f"fgout0001.t000{k}").write_text(f"{k * 10.0} time\n4 meqn\n1 ngrids\nbinary32 file_format\n")
        (run / f"fgout0001.q000{k}").write_text("1 grid_number\n1 AMR_level\n3 mx\n2 my\n0.0 xlow\n5.0 ylow\n1.0 dx\n1.0 dy\n")
    (run / "fgout0001.b0001").write_bytes(q.tobytes(order="F"))
    with pytest.raises(ValueError, match="no data file"):
        frames.scan_frames(spark, str(tmp_path))
    rows = frames.scan_frames(spark, str(tmp_path), missing="skip").collect()
    assert len(rows) == 6 and {r["t"] for r in rows} == {10.0}
    for r in rows:
        assert (r["h"], r["b"]) == (q[0, r["i"], r["j"]], q[3, r["i"], r["j"]]) and r["y"] == 5.5 + r["j"]


def test_patches_and_gauges(spark, tmp_path):
    run = tmp_path / "a"
    run.mkdir()
    head = lambda n, lev, x: f"{n} grid_number\n{lev} AMR_level\n2 mx\n2 my\n{x} xlow\n0.0 ylow\n1.0 dx\n1.0 dy\n\n"
    body = lambda v: f"{v} 0.0\n{v + 1} 0.0\n\n{v + 2} 0.0\n{v + 3} 1D+01\n\n"
    (run / "fort.t0000").write_text("0.5 time\n2 meqn\n2 ngrids\n")
    (run / "fort.q0000").write_text(head(1, 1, 0.0) + body(1) + head(2, 2, 4.0) + body(10))
    patches, cells = frames.scan_patches(spark, str(tmp_path))
    assert {(r["patch"], r["level"], r["xlow"], r["t"]) for r in patches.collect()} == {(1, 1, 0.0, 0.5), (2, 2, 4.0, 0.5)}
    got = {(r["patch"], r["i"], r["j"]): tuple(r["q"]) for r in cells.collect()}
    assert got[(2, 1, 1)] == (13.0, 10.0) and got[(1, 1, 0)] == (2.0, 0.0) and len(got) == 8
    (run / "gauge00007.txt").write_text("# gauge_id=     7 location=(  1.5  2.5 ) num_eqn= 2\n# Stationary gauge\n# level, time, q\n1 0.0 1.0 2.0\n2 1.0 3.0 4.0\n")
    g = text.scan_gauges(spark, str(tmp_path)).orderBy("t").collect()
    assert [(r["gauge"], r["level"], r["t"], r["x"], list(r["q"])) for r in g] == [(7, 1, 0.0, 1.5, [1.0, 2.0]), (7, 2, 1.0, 1.5, [3.0, 4.0])]
    (run / "gauge00008.txt").write_text("# gauge_id=     9 location=(  1.5  2.5 ) num_eqn= 2\n1 0.0 1.0 2.0\n")
    with pytest.raises(Exception, match="differs from its file name"):
        text.scan_gauges(spark, str(tmp_path)).collect()


def test_raster_dialects(spark, tmp_path):
    (tmp_path / "e.asc").write_text("ncols 3\nnrows 2\nxllcenter 10.5\nyllcenter 20.5\ncellsize 1\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    (tmp_path / "s.asc").write_text("3 ncols\n2 nrows\n10 xlower\n20 ylower\n1 cellsize\n-9999 nodata_value\n1 2 3\n4 -9999 6\n")
    (tmp_path / "g.asc").write_text("north: 22\nsouth: 20\neast: 13\nwest: 10\nrows: 2\ncols: 3\n1 2 3\n4 * 6\n")
    cells, grids = text.scan_raster_text(spark, str(tmp_path))
    want = {(0, 1): 1.0, (1, 1): 2.0, (2, 1): 3.0, (0, 0): 4.0, (1, 0): None, (2, 0): 6.0}
    for name in "esg":
        rows = cells.where(f"run = '{name}'").collect()
        assert {(r["i"], r["j"]): r["z"] for r in rows} == want
        assert {(r["x"], r["y"]) for r in rows} == {(10.5 + i, 20.5 + j) for i, j in want}
    assert {(r["xmin"], r["ymax"], r["ncols"]) for r in grids.collect()} == {(10.0, 22.0, 3)}
    (tmp_path / "bad.asc").write_text("3 ncols\n2 nrows\n10 xlower\n20 ylower\n1 cellsize\n1 2\n4 5 6\n")
    with pytest.raises(Exception, match="shape differs"):
        text.scan_raster_text(spark, str(tmp_path), "bad.asc")[0].collect()


def test_runs_and_polygons(spark, tmp_path):
    for name, marker in (("r1", {"status": "completed", "rho": 250.0, "configuration": {"a": {"b": 1}}}), ("r2", {"status": "failed"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text(json.dumps(marker))
    (tmp_path / "r3").mkdir()
    (tmp_path / "r3" / "run.json").write_text("{oops")
    from gridspark.operators.tables import flatten_config

    runs = text.scan_runs(spark, str(tmp_path))
    assert [(r["run"], r["rho"]) for r in runs.collect()] == [("r1", 250.0)]
    assert [(r["key"], r["value"]) for r in flatten_config(runs).collect()] == [("a.b", "1")]
    ring = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [2, 1], [2, 2], [1, 1]]
    layer = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": 1}, "geometry": {"type": "Polygon", "coordinates": [ring, hole, [[1, 1], [2, 2]]]}}]}
    (tmp_path / "lake.geojson").write_text(json.dumps(layer))
    p = text.scan_polygons(spark, str(tmp_path)).collect()
    assert len(p) == 1 and len(p[0]["exterior"]) == 5 and len(p[0]["holes"]) == 1 and p[0]["run"] == "lake"


def test_raster_round_trip_is_exact(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [("a", i, j, i + 0.5, j + 0.5, float(v)) for (j, i), v in np.ndenumerate(rng.random((4, 5)) * 1e3)]
    cells = spark.createDataFrame(rows, "run string, i int, j int, x double, y double, z double")
    grids = spark.createDataFrame([("a", 0.0, 5.0, 0.0, 4.0, 5, 4, 1.0)], "run string, xmin double, xmax double, ymin double, ymax double, ncols int, nrows int, cellsize double")
    sinks.export_raster_text(cells, grids, str(tmp_path / "out"))
    back = text.scan_raster_text(spark, str(tmp_path / "out"), "*.txt", by_folder=True)[0]
    assert {(r["i"], r["j"], r["z"]) for r in back.collect()} == {(r[1], r[2], r[5]) for r in rows}


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "long.txt").write_text("\n".join(f"line {k}" for k in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        rows = text.numbered_lines(spark, str(tmp_path), "*.txt")
        assert rows.where("text <> concat('line ', line_no)").count() == 0 and rows.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_native_tracks(spark, tmp_path):
    (tmp_path / "ike").mkdir()
    row = "  1.0e+01 -60.0e+00 20.0e+00 3.0e+01 -1.0e+00 9.0e+04 2.0e+05\n"
    (tmp_path / "ike" / "s.storm").write_text("1\n2008-09-13T07:00:00\n\n" + row)
    r = decks.scan_tracks(spark, str(tmp_path), "native", "*.storm").collect()
    assert [(x["storm"], x["lon"], x["rmw"], x["ts"].second) for x in r] == [("ike", -60.0, None, 10)]


def test_payloads_are_read_in_ranges(spark, tmp_path, monkeypatch):
    """Small ranges, a folder with a blank, float32 patches with ghost cells beside a text frame, a payload cut short."""
    monkeypatch.setattr(frames, "CHUNK", 7)
    out = tmp_path / "a run"
    out.mkdir()
    rng = np.random.default_rng(1)
    shapes = [(5, 3), (2, 9)]
    q = [np.float32(rng.normal(size=(my + 4, mx + 4, 3))) for mx, my in shapes]
    head = "".join(
        f"{k + 1} grid_number\n{k + 1} AMR_level\n{mx} mx\n{my} my\n0.0 xlow\n0.0 ylow\n1.0 dx\n1.0 dy\n\n" for k, (mx, my) in enumerate(shapes)
    )
    (out / "fort.t0000").write_text("0.5 time\n3 meqn\n2 ngrids\n0 naux\n2 ndim\n2 num_ghost\nbinary32 file_format\n")
    (out / "fort.q0000").write_text(head)
    (out / "fort.b0000").write_bytes(b"".join(v.tobytes() for v in q))
    (out / "fort.t0001").write_text("1.5 time\n3 meqn\n1 ngrids\n0 naux\n2 ndim\n2 num_ghost\nascii file_format\n")
    (out / "fort.q0001").write_text("1 grid_number\n1 AMR_level\n2 mx\n1 my\n0.0 xlow\n0.0 ylow\n1.0 dx\n1.0 dy\n\n1.0 2.0 3.0\n4.0 5.0 6.0\n\n")
    patches, cells = frames.scan_patches(spark, str(tmp_path))
    got = {(r.frame, r.patch, r.i, r.j): tuple(r.q) for r in cells.collect()}
    want = {(0, k + 1, i, j): tuple(map(float, q[k][j + 2, i + 2])) for k, (mx, my) in enumerate(shapes) for i in range(mx) for j in range(my)}
    assert got == want | {(1, 1, 0, 0): (1.0, 2.0, 3.0), (1, 1, 1, 0): (4.0, 5.0, 6.0)}
    assert patches.count() == 3
    (out / "fort.b0000").write_bytes(b"".join(v.tobytes() for v in q)[:-4])
    with pytest.raises(Exception, match="size differs"):
        frames.scan_patches(spark, str(tmp_path))[1].collect()


def test_binary_gauges_beside_text_ones(spark, tmp_path):
    out = tmp_path / "r"
    out.mkdir()
    for n, form in ((7, "binary32"), (8, "binary64")):
        (out / f"gauge0000{n}.txt").write_text(f"# gauge_id= {n} location=( 1.0 2.0 ) num_eqn= 2\n# Lagrangian particle\n# level, time, q\n# file format: {form}, time series in .bin file\n")
        (out / f"gauge0000{n}.bin").write_bytes(np.array([[1, 0.5, 3, 4], [2, 1.5, 5, 6]], "f4" if form == "binary32" else "f8").tobytes())
    (out / "gauge00009.txt").write_text("# gauge_id= 9 location=( 1.0 2.0 ) num_eqn= 2\n# Stationary gauge\n# level, time, q\n# file format: ascii\n1 0.5 3.0 4.0\n")
    rows = {(r.gauge, r.kind, r.level, r.t, tuple(r.q)) for r in text.scan_gauges(spark, str(tmp_path)).collect()}
    assert rows == {(n, "lagrangian", *v) for n in (7, 8) for v in ((1, 0.5, (3.0, 4.0)), (2, 1.5, (5.0, 6.0)))} | {(9, "stationary", 1, 0.5, (3.0, 4.0))}
