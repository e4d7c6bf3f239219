"""Gaps filled from the smallest square: tiny and huge values, grids that lack cells, gaps wider than any fixed number of rounds."""

import math

import numpy as np
import pytest

from gridspark.operators import geometry

KIND = "run string, i int, j int, z double"


def squares(rows):
    """Smallest square with a value around each missing cell, by trying."""
    value = {(run, i, j): z for run, i, j, z in rows if z is not None}
    out = {}
    for run, i, j, z in rows:
        near = {max(abs(a - i), abs(b - j)): None for r, a, b in value if r == run}
        if z is None and near:
            ring = [v for (r, a, b), v in value.items() if r == run and max(abs(a - i), abs(b - j)) == min(near)]
            z = math.fsum(ring) / len(ring)
        out[run, i, j] = z
    return out


def check(spark, rows):
    got = {(r.run, r.i, r.j): r.z for r in geometry.fill_missing(spark.createDataFrame(rows, KIND)).collect()}
    want = squares(rows)
    assert got.keys() == want.keys()
    for k, z in want.items():
        assert (got[k] is None) == (z is None) and (z is None or got[k] == pytest.approx(z, rel=1e-12)), k


def test_random_gaps_and_lacking_cells(spark):
    rng = np.random.default_rng(6)
    rows = [("a", i, j, None if rng.random() < 0.8 else float(rng.normal())) for i in range(17) for j in range(13) if rng.random() < 0.8 and (i, j) != (0, 0)]
    rows += [("b", i, j, 7.0 if (i, j) == (30, 2) else None) for i in range(-3, 31) for j in range(-2, 3)]
    rows += [("none", 0, 0, None), ("none", 1, 0, None), ("one", 5, 5, 1.0)]
    check(spark, rows)


@pytest.mark.parametrize("scale", [1e-20, 3e-17, 1e25, 3e23, 1e300])
def test_tiny_and_huge_values(spark, scale):
    v = {(0, 0): 1.0, (4, 0): 2.0, (0, 4): 3.0, (1, 1): 4.0}
    check(spark, [("a", i, j, v[i, j] * scale if (i, j) in v else None) for i in range(5) for j in range(5)])


def test_tiny_beside_huge(spark):
    v = {(0, 0): 1e25, (9, 9): 3e-20, (8, 9): 1e-20}
    check(spark, [("a", i, j, v.get((i, j))) for i in range(10) for j in range(10)])
