"""Operators on grids small enough to know the answer."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import Geometry
from gridspark.functions.ordered import running, shifted
from gridspark.operators import aggs, fields, filters, geometry, joins, regions, sampling, windows


def grid(spark, values, run="r"):
    """Cells of a list of rows, south first."""
    rows = [(run, i, j, i + 0.5, j + 0.5, None if v is None else float(v)) for j, r in enumerate(values) for i, v in enumerate(r)]
    return spark.createDataFrame(rows, "run string, i int, j int, x double, y double, z double")


def field(df, value="z"):
    return {(r["i"], r["j"]): r[value] for r in df.collect()}


def test_plane_gradient_and_sampling(spark):
    plane = spark.createDataFrame(
        [("r", i, j, float(i), float(j), 10.0 * j + i) for i in range(3) for j in range(3)], "run string, i int, j int, x double, y double, z double"
    )
    for order in (1, 2):
        g = fields.gradient(plane, "z", edge_order=order)
        assert {(r["z_x"], r["z_y"]) for r in g.collect()} == {(1.0, 10.0)}
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, -0.1, 0.0), (4, 1.5, 1.5)], "pid int, x double, y double")
    at = {r["pid"]: r["z"] for r in sampling.sample_bilinear(plane, pts, Geometry(-0.5, -0.5, 1, 1, 3, 3)).collect()}
    assert at == {1: 5.5, 2: 22.0, 3: None, 4: 16.5}
    holed = plane.withColumn("z", F.when(~((F.col("i") == 2) & (F.col("j") == 2)), F.col("z")))
    at = {r["pid"]: r["z"] for r in sampling.sample_bilinear(holed, pts, Geometry(-0.5, -0.5, 1, 1, 3, 3)).collect()}
    assert at == {1: 5.5, 2: None, 3: None, 4: None}


def test_equal_points_and_missing_corners(spark):
    rows = [("r", i, j, None if (i, j) == (2, 2) else 8.0, 8.0) for i in range(3) for j in range(3)]
    cells = spark.createDataFrame(rows, "run string, i int, j int, z double, h double")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.5, 0.5), (2, 1.4, 1.4), (3, 1.6, 1.6)], "pid int, x double, y double")
    box = Geometry(-0.5, -0.5, 1, 1, 3, 3)
    order = lambda df: sorted((r["pid"], r["z"]) for r in df.collect())
    assert order(sampling.sample_bilinear(cells, pts, box)) == [(1, 8.0), (1, 8.0), (2, None), (3, None)]
    assert order(sampling.sample_wet_bilinear(cells, pts, box, "z", dry=0.1)) == [(1, 8.0), (1, 8.0), (2, 8.0), (3, None)]


def test_gradient_equals_numpy_over_tiles(spark):
    rng = np.random.default_rng(1)
    z = rng.random((17, 23))
    cells = grid(spark, z.tolist())
    for order in (1, 2):
        gy, gx = np.gradient(z, edge_order=order)
        got = fields.gradient(cells, "z", edge_order=order, tile=5).collect()
        assert len(got) == z.size
        for r in got:
            assert r["z_x"] == pytest.approx(gx[r["j"], r["i"]]) and r["z_y"] == pytest.approx(gy[r["j"], r["i"]])


def test_running_and_shifted_over_many_chunks(spark):
    rng = random.Random(3)
    rows = [(g, t, rng.choice([None, rng.randint(0, 99)])) for g in (1, 2) for t in range(400)]
    rows += [(3, 7, 5)]
    df = spark.createDataFrame(rows, "g int, t int, v int")
    kinds = {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "last": ("last", "v")}
    for backward in (False, True):
        got = {(r["g"], r["t"]): (r["s"], r["lo"], r["hi"], r["last"]) for r in running(df, ["g"], "t", kinds, backward, rows=17).collect()}
        for g in (1, 2, 3):
            seen, s = [], None
            for _, t, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=backward):
                if v is not None:
                    seen.append(v)
                    s = (s or 0) + v
                want = (s, min(seen), max(seen), seen[-1]) if seen else (None,) * 4
                assert got[(g, t)] == want
    for ahead in (False, True):
        got = {(r["g"], r["t"]): r["p"] for r in shifted(df, ["g"], "t", {"p": "v"}, ahead, rows=13).collect()}
        by = {(g, t): v for g, t, v in rows}
        assert all(got[(g, t)] == by.get((g, t + (1 if ahead else -1))) for g, t, _ in rows if g != 3)


def square(spark, x0, y0, x1, y1, holes=()):
    ring = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    t = "array<struct<x:double,y:double>>"
    return spark.createDataFrame([(1, ring(x0, y0, x1, y1), [ring(*h) for h in holes])], f"pid int, exterior {t}, holes array<{t}>")


def test_coverage_exact_fractions(spark):
    g = Geometry(0, 0, 1, 1, 6, 6)
    cov = {k: v for k, v in field(geometry.polygon_coverage(square(spark, 1.25, 1.25, 3.25, 3.25), g), "coverage").items() if v}
    assert cov[(1, 1)] == 0.5625 and cov[(2, 2)] == 1.0 and cov[(3, 2)] == 0.25 and cov[(3, 3)] == 0.0625
    assert sum(cov.values()) == 4.0
    holed = geometry.polygon_coverage(square(spark, 1.25, 1.25, 4.25, 4.25, [(2.25, 2.25, 3.25, 3.25)]), g)
    assert sum(field(holed, "coverage").values()) == 8.0
    two = square(spark, 1.25, 1.25, 3.25, 3.25).union(square(spark, 2.25, 1.25, 4.25, 3.25).withColumn("pid", F.lit(2)))
    assert sum(field(geometry.polygon_coverage(two, g), "coverage").values()) == 6.0


def brute_region(mask, seeds, step=((0, 1), (1, 0), (0, -1), (-1, 0))):
    todo, seen = [s for s in seeds if mask.get(s)], set()
    while todo:
        c = todo.pop()
        if c in seen:
            continue
        seen.add(c)
        todo += [(c[0] + a, c[1] + b) for a, b in step if mask.get((c[0] + a, c[1] + b))]
    return seen


def test_regions_equal_brute_force(spark):
    rng = random.Random(5)
    values = [[rng.random() for _ in range(24)] for _ in range(20)]
    cells = grid(spark, values)
    mask = {(i, j): values[j][i] <= 0.6 for i in range(24) for j in range(20)}
    seed = next(k for k, v in mask.items() if v)
    seeds = spark.createDataFrame([("r", *seed)], "run string, i int, j int")
    got = set(field(regions.connected_region(cells, seeds, 0.6)))
    assert got == brute_region(mask, [seed])
    eight = [d for d in itertools.product((-1, 0, 1), repeat=2) if d != (0, 0)]
    for conn, step in ((4, ((0, 1), (1, 0), (0, -1), (-1, 0))), (8, eight)):
        labels = {}
        for (i, j), l in field(regions.label_cells(cells.where("z <= 0.6"), conn), "label").items():
            labels.setdefault(l, set()).add((i, j))
        assert sorted(map(sorted, labels.values())) == sorted(
            sorted(c) for c in {frozenset(brute_region(mask, [k], step)) for k, v in mask.items() if v}
        )


def test_spiral_is_one_region(spark):
    n, wall = 32, [[9.0] * 32 for _ in range(32)]
    i = j = 0
    di, dj, path = 1, 0, []
    lo_i, hi_i, lo_j, hi_j = 0, n - 1, 0, n - 1
    while lo_i <= hi_i and lo_j <= hi_j:
        path += [(a, lo_j) for a in range(lo_i, hi_i + 1)] + [(hi_i, b) for b in range(lo_j, hi_j + 1)]
        path += [(a, hi_j) for a in range(hi_i, lo_i - 1, -1)] + [(lo_i, b) for b in range(hi_j, lo_j + 1, -1)]
        path += [(lo_i + 1, lo_j + 2)] if lo_i + 2 <= hi_i - 2 else []
        lo_i, hi_i, lo_j, hi_j = lo_i + 2, hi_i - 2, lo_j + 2, hi_j - 2
    for a, b in path:
        wall[b][a] = 1.0
    mask = {(a, b): wall[b][a] < 2 for a in range(n) for b in range(n)}
    seeds = spark.createDataFrame([("r", 0, 0)], "run string, i int, j int")
    assert set(field(regions.connected_region(grid(spark, wall), seeds, 2.0))) == brute_region(mask, [(0, 0)])


def test_two_basins_and_open_edge(spark):
    bowl = [[9] * 5, [9, 1, 9, 1, 9], [9, 1, 9, 1, 9], [9] * 5, [9] * 5]
    cells = grid(spark, bowl)
    grids = spark.createDataFrame([("r", 5, 5)], "run string, ncols int, nrows int")
    seed = lambda i, j: spark.createDataFrame([("r", i, j)], "run string, i int, j int")
    assert set(field(regions.connected_region(cells, seed(1, 1), 2.0, grids))) == {(1, 1), (1, 2)}
    with pytest.raises(ValueError, match="seed above"):
        regions.connected_region(cells, seed(2, 2), 2.0, grids)
    bowl[0][1] = 1
    with pytest.raises(ValueError, match="edge"):
        regions.connected_region(grid(spark, bowl), seed(1, 1), 2.0, grids)


def test_fill_missing_takes_smallest_square(spark):
    rng = random.Random(8)
    v = [[None if 3 <= i <= 12 and 2 <= j <= 11 or rng.random() < 0.3 else float(rng.randint(0, 9)) for i in range(16)] for j in range(14)]
    got = field(geometry.fill_missing(grid(spark, v)))
    for j, i in itertools.product(range(14), range(16)):
        want = v[j][i]
        r = 0
        while want is None:
            r += 1
            near = [v[b][a] for b in range(max(0, j - r), min(14, j + r + 1)) for a in range(max(0, i - r), min(16, i + r + 1)) if v[b][a] is not None]
            want = sum(near) / len(near) if near else None
        assert got[(i, j)] == pytest.approx(want)


def test_nearest_point_equals_brute_force(spark):
    rng = random.Random(2)
    pts = [(k, rng.random() * 3, rng.random() * 20, float(k)) for k in range(40)]
    nodes = [(a + 0.5, b + 0.5) for a in range(20) for b in range(20)]
    got = geometry.nearest_point(spark.createDataFrame(nodes, "x double, y double"), spark.createDataFrame(pts, "pid int, x double, y double, z double"), 1.0)
    for r in got.collect():
        best = min(pts, key=lambda p: ((p[1] - r["x"]) ** 2 + (p[2] - r["y"]) ** 2, p[0]))
        assert best[0] == r["pid"]
    assert got.count() == 400


def test_rest_ignores_early_dip(spark):
    f = [1.0, 0.5, 0.009, 0.02, 0.009, 0.008, 0.007]
    h = spark.createDataFrame([("r", float(t), v) for t, v in enumerate(f)] + [("s", 0.0, 1.0)], "run string, t double, moving_fraction double")
    got = {r["run"]: (r["rest"], r["confirmed"]) for r in windows.sustained_rest(h).collect()}
    assert got == {"r": (4.0, 6.0), "s": (None, None)}


def test_source_rates_faces(spark):
    rows = [("r", 0.0, 1.0, 1.0, 2.0, 1.0, 0.0, 1.0, 0.0, 2.0), ("r", 0.0, 1.0, 1.0, 2.0, -1.0, 0.0, 1.0, 0.0, 2.0),
            ("r", 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 2.0), ("r", 0.0, 1.0, 1.0, None, None, None, 1.0, 0.0, 2.0)]
    f = spark.createDataFrame(rows, "run string, t double, target_x double, target_y double, h double, hu double, hv double, nx double, ny double, length double")
    r = aggs.source_rates(f, 0.5).collect()
    assert [(x["q"], x["qu"], x["qv"]) for x in r] == [(1.0, 0.5, 0.0)]
    c = aggs.source_face_counts(f).first()
    assert (c["active"], c["replaced"]) == (1, 1)


def test_checks_raise(spark):
    cells = grid(spark, [[1, -1, 2], [3, None, 4]])
    with pytest.raises(ValueError, match="2 selected cell.* row 0, column 1"):
        filters.reject_invalid(cells, F.col("i") < 2, "release")
    assert filters.reject_invalid(cells, F.col("i") == 0, "release").count() == 6
    t = spark.createDataFrame([("r", 0, 0.0), ("r", 1, 5.0)], "run string, frame int, t double")
    with pytest.raises(ValueError, match="frame 1"):
        joins.complete_frames(t, t.where("frame = 0"), missing="error")
    with pytest.raises(ValueError):
        windows.assert_increasing(spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0)], "g string, k int, t double"), ["g"], ["k"])
    mask = spark.createDataFrame([(0, 0, True)], "i int, j int, flag boolean")
    with pytest.raises(Exception, match="not aligned"):
        joins.align_mask(cells, mask, 0.2, 0.0, 1.0).collect()


def test_units_refuse_other_kinds():
    from gridspark.functions.units import scale_offset

    assert scale_offset("F", "C") == (5 / 9, pytest.approx(-160 / 9))
    assert scale_offset("K", "C") == (1.0, -273.15)
    with pytest.raises(ValueError):
        scale_offset("m", "Pa")


def test_selection_needs_every_fold(spark):
    from gridspark.operators import ranking

    peers = [f"p{k}" for k in range(4)]
    base = {"p0": 1.0, "p1": 1.1, "p2": 0.9, "p3": 1.05}
    rows = []
    rng = random.Random(4)
    for i, j in itertools.product(range(6), range(5)):
        bump = math.sin(i) + math.cos(j) + 2
        for p in peers:
            rows.append(("c", p, i, j, bump * base[p] + rng.random() * 0.05))
        rows.append(("c", "good", i, j, bump * 1.01))
        rows.append(("c", "poor", i, j, bump * 2 + rng.random()))
    e = spark.createDataFrame(rows, "case string, model string, i int, j int, v double")
    pairs = ranking.model_pairs(e)
    details = ranking.candidate_details(pairs, ["good", "poor"])
    ranked = windows.rank_candidates(ranking.candidate_scores(pairs, e, ["good", "poor"]))
    out = ranking.selection(ranked, details, ranking.leave_one_out(pairs, ["good", "poor"])).first()
    assert (out["status"], out["candidate"], out["wins"]) == ("selected", "good", 4)


def test_missing_values_do_not_wipe_maxima(spark):
    from gridspark.operators import aggs

    rows = [(0, 0, t, h, 0) for t, h in ((0.0, 1.0), (1.0, None), (2.0, 5.0), (3.0, float("nan")))]
    frames = spark.createDataFrame(rows, "i int, j int, t double, h double, level int")
    got = aggs.cell_maxima(frames, ("h",)).first()
    assert (got["max_h"], got["time_h"], got["min_h"]) == (5.0, 2.0, 1.0)


def test_config_is_flattened_to_any_depth(spark):
    from gridspark.operators import tables

    deep = spark.createDataFrame([("r", '{"a":{"b":{"c":{"d":{"e":{"f":1}}}}},"x":[1]}')], "run string, conf string")
    assert {(r.key, r.value) for r in tables.flatten_config(deep).collect()} == {("a.b.c.d.e.f", "1"), ("x", "[1]")}


def test_stability_marks_with_much_white_space(spark):
    from gridspark.operators import logs

    text = "Courant number  =   1.5" + " " * 250 + "\nis larger than input cfl_max = 1.0 on grid 3 level 2"
    got = logs.log_diagnostics(spark.createDataFrame([("r", "log", 0, text)], "run string, source string, part int, text string")).first()
    assert (got["violations"], got["max_violating"], got["first_grid"]) == (1, 1.5, 3)


@pytest.mark.parametrize("field", ["********", "Infinity", "NaN", "+Infinity", "", "0.2185D+02"])
def test_stability_marks_with_any_printed_field(spark, field):
    from gridspark.operators import logs

    text = f"Courant number = {field} is larger\nthan input cfl_max = 1.0\nmaximum Courant number seen = 1.00\nCourant number  = {field}  is larger than input cfl_max =   0.1000D+01  on grid 180 level   1"
    got = logs.log_diagnostics(spark.createDataFrame([("r", "amr", 0, text)], "run string, source string, part int, text string")).first()
    assert (got["violations"], got["max_violating"], got["max_courant"]) == (2, 21.85 if "D" in field else None, 1.0)


def touches(a, b, i, j):
    """Whether the segment from a to b meets the closed unit square (i, j), in fractions."""
    lo, hi = Fraction(0), Fraction(1)
    for p, q, low in ((a[0], b[0], i), (a[1], b[1], j)):
        if p == q:
            if not low <= p <= low + 1:
                return False
            continue
        s, t = sorted((edge - p) / (q - p) for edge in (low, low + 1))
        lo, hi = max(lo, s), min(hi, t)
    return lo <= hi


@pytest.mark.parametrize("seed", [1, 2])
def test_outline_touches_closed_squares(spark, seed):
    rng = random.Random(seed)
    # Corners on quarters: many lie on grid lines, some outside; the last ring runs along lines.
    rings = [[(Fraction(rng.randint(-8, 40), 4), Fraction(rng.randint(-8, 40), 4)) for _ in range(3)] for _ in range(4)]
    rings.append([(Fraction(x), Fraction(y)) for x, y in ((2, 2), (5, 2), (5, 4), (2, 4))])
    ring = "array<struct<x:double,y:double>>"
    polys = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in r], []) for k, r in enumerate(rings)], f"pid int, exterior {ring}, holes array<{ring}>")
    expected = {
        (i, j) for r in rings for a, b in zip(r, r[1:] + r[:1]) for i in range(8) for j in range(7) if touches(a, b, i, j)
    }
    got = [(r["i"], r["j"]) for r in geometry.boundary_cells(polys, Geometry(0.0, 0.0, 1.0, 1.0, 8, 7)).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
