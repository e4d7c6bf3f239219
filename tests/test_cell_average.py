"""Averages over cells: fields of one arrangement share the cutting, and no table of pieces is broadcast."""

import pytest

from gridspark.functions import Geometry
from gridspark.operators.geometry import cell_average


def test_shared_cuts_are_not_broadcast(spark):
    # Fields 0 to 3 have a fine source within a wide one, field 4 the wide one only.
    layout = [(f, s, x0, x0, d, d, 9, 9) for f in range(5) for s, x0, d in ((1, 0.0, 1.0), (2, 2.0, 0.5)) if f < 4 or s == 1]
    geometry = spark.createDataFrame(layout, "frame int, source int, x0 double, y0 double, dx double, dy double, nx int, ny int")
    nodes = [(f, s, i, j, f + 100.0 * s + x0 + i * d) for f, s, x0, _, d, *_ in layout for i in range(9) for j in range(9)]
    sources = spark.createDataFrame(nodes, "frame int, source int, i int, j int, z double")
    out = cell_average(sources, geometry, Geometry(0.0, 0.0, 4.0, 8.0, 2, 1))
    got = {(r["frame"], r["i"], r["j"]): (r["mean"], r["covered"]) for r in out.collect()}
    # A plane in x: the mean is its middle; a quarter lies in the fine source's square of 2 to 6.
    for f in range(5):
        for i in (0, 1):
            x, fine = 4.0 * i + 2, 8 / 32 if f < 4 else 0.0
            assert got[f, i, 0] == (pytest.approx((1 - fine) * 100 + fine * 200 + f + x), True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
