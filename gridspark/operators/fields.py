"""Derived fields: column mathematics on cells, and stencils over halo tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark import schema
from gridspark.functions import grain, halo_tiles
from gridspark.functions.keys import finite, round_half_up, to_int
from gridspark.functions.tiles import TILE, Geometry, home


def gradient(cells: DataFrame, column: str = "z", edge_order: int = 1, tile: int = TILE) -> DataFrame:
    """`{column}_x`, `{column}_y`: central differences, one-sided at the grid edge.

    `edge_order` 2 uses the three-point one-sided formula at edges. A missing
    neighbour value gives NULL; a missing neighbour row is an edge.
    """
    by = grain(cells)
    tiled = halo_tiles(cells, halo=edge_order, tile=tile)

    def slope(index: str, across: str, at: str) -> Column:
        w = Window.partitionBy(*by, "_ti", "_tj", across).orderBy(index)

        def near(c: str, k: int) -> Column:
            shift = F.lag(c, k) if k > 0 else F.lead(c, -k)
            place = F.lag(index, k) if k > 0 else F.lead(index, -k)
            return F.when(place.over(w) == F.col(index) - k, shift.over(w))

        z, p = F.col(column), F.col(at)
        before, after = near(index, 1).isNotNull(), near(index, -1).isNotNull()
        z_b, z_a, p_b, p_a = near(column, 1), near(column, -1), near(at, 1), near(at, -1)
        first, last = (z_a - z) / (p_a - p), (z - z_b) / (p - p_b)
        if edge_order == 2:
            far_a, far_b = near(index, -2).isNotNull(), near(index, 2).isNotNull()
            first = F.when(far_a, (-3 * z + 4 * z_a - near(column, -2)) / (2 * (p_a - p))).otherwise(first)
            last = F.when(far_b, (3 * z - 4 * z_b + near(column, 2)) / (2 * (p - p_b))).otherwise(last)
        return (
            F.when(before & after, (z_a - z_b) / (p_a - p_b)).when(after, first).when(before, last)
        )

    return home(
        tiled.withColumns({f"{column}_x": slope("i", "j", "x"), f"{column}_y": slope("j", "i", "y")})
    )


def slope_terms(cells: DataFrame, column: str = "z", tile: int = TILE) -> DataFrame:
    """`slope`, `angle` in degrees and `cosine` of the surface normal."""
    gx, gy = F.col(f"{column}_x"), F.col(f"{column}_y")
    return gradient(cells, column, tile=tile).withColumns(
        {
            "slope": F.sqrt(gx * gx + gy * gy),
            "angle": F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))),
            "cosine": 1 / F.sqrt(1 + gx * gx + gy * gy),
        }
    )


def tangent_speed(frames: DataFrame, vel: float = schema.VELOCITY_DEPTH, bed: str = "b", tile: int = TILE) -> DataFrame:
    """`speed` along the bed from `u`, `v`; zero below the velocity depth. Needs `wet_mask` columns."""
    u, v = F.col("u"), F.col("v")
    w = u * F.col(f"{bed}_x") + v * F.col(f"{bed}_y")
    speed = F.when(F.col("h") >= vel, F.sqrt(u * u + v * v + w * w)).otherwise(F.lit(0.0))
    return gradient(frames, bed, edge_order=2, tile=tile).withColumn("speed", speed)


def desingularised_velocity(frames: DataFrame, hmin: float) -> DataFrame:
    """`u`, `v` damped smoothly in thin flow; zero at or below `hmin`."""
    h = F.col("h")
    h4 = F.pow(h, F.lit(4.0))
    scale = F.sqrt(F.lit(2.0)) * h / F.sqrt(h4 + F.greatest(h4, F.lit((4 * hmin) ** 4)))
    part = lambda q: F.when(h > hmin, scale * F.col(q)).otherwise(F.lit(0.0))
    return frames.withColumns({"u": part("hu"), "v": part("hv")})


def kinetic_pressure(frames: DataFrame, runs: DataFrame | None = None, speed: str = "speed") -> DataFrame:
    """`pressure` in kPa; density comes from `runs(run, rho)`, else the default."""
    rho: Column = F.lit(schema.DEFAULT_DENSITY)
    if runs is not None:
        frames = frames.join(runs.select("run", F.col("rho").alias("_rho")), "run", "left")
        rho = F.coalesce("_rho", rho)
    return frames.withColumn("pressure", 0.5 * rho * F.col(speed) * F.col(speed) / 1000.0).drop("_rho")


def surface_fields(frames: DataFrame) -> DataFrame:
    """Fill in `eta` or `b` from the other, and add `u`, `v`, `s`, `hs`, `hss`; zero velocity where dry."""
    cols = frames.columns
    h = F.col("h")
    eta = F.coalesce("eta", h + F.col("b")) if "eta" in cols and "b" in cols else (
        F.col("eta") if "eta" in cols else h + F.col("b")
    )
    bed = F.coalesce("b", eta - h) if "b" in cols else eta - h
    wet = F.when(h > 0, h)
    u, v = (F.coalesce(F.try_divide(F.col(q), wet), F.lit(0.0)) for q in ("hu", "hv"))
    s = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    return frames.withColumns({"eta": eta, "b": bed, "u": u, "v": v}).withColumn("s", s).withColumns(
        {"hs": h * F.col("s"), "hss": h * F.col("s") * F.col("s")}
    )


def lake_variable(frames: DataFrame, name: str, wet: float = schema.LAKE_WET_DEPTH) -> DataFrame:
    """`value`: depth, elevation (NULL where dry) or displacement from the run's first frame."""
    h, surface = F.col("h"), F.col("b") + F.col("h")
    if name == "depth":
        return frames.withColumn("value", F.when(h >= wet, h).otherwise(F.lit(0.0)))
    if name == "elevation":
        return frames.withColumn("value", F.when(h >= wet, surface))
    if name != "displacement":
        raise ValueError(f"unknown lake variable {name!r}")
    by = grain(frames, "frame")
    # One aggregate per cell, then an equi-join: no window gathers a cell's whole history.
    start = frames.groupBy(*by, "i", "j").agg(F.min_by(surface, F.struct("t", "frame")).alias("_start"))
    return frames.join(start, [*by, "i", "j"]).withColumn("value", surface - F.col("_start")).drop("_start")


# Defaults of the release model (fixed values).
RELEASE_DEFAULTS = {
    "d0": 0.0, "z_ref": 0.0, "gradient_hypso": 0.0, "theta_cr": 30.0, "nu": 0.2,
    "correction_elevation": False, "correction_slope": False,
}
STEEP_DEGREES = 25.0


def release_depth(cells: DataFrame, params: dict | None = None, tile: int = TILE) -> DataFrame:
    """`depth` of release per cell with `coverage`, and `invalid` where the model gives no valid depth.

    Depth grows with elevation and is scaled by a slope factor, zero on slopes up
    to 25 degrees. Missing terrain takes the field's mean for the slope only.
    """
    p = {**RELEASE_DEFAULTS, **(params or {})}
    by = grain(cells)
    z = F.col("z")
    out = cells
    factor: Column = F.lit(1.0)
    if p["correction_slope"]:
        mean = cells.groupBy(*by).agg(F.avg("z").alias("_mean"))
        out = cells.join(mean, by).withColumn("_fill", F.coalesce("z", "_mean"))
        out = gradient(out, "_fill", tile=tile)
        gx, gy = F.col("_fill_x"), F.col("_fill_y")
        angle = F.atan(F.sqrt(gx * gx + gy * gy))
        at = lambda q: F.sin(q) - F.lit(p["nu"]) * F.cos(q)
        below = at(angle)
        factor = F.when(
            (angle > F.radians(F.lit(STEEP_DEGREES))) & (F.abs(below) > 1e-12),
            F.try_divide(at(F.radians(F.lit(p["theta_cr"]))), below),
        ).otherwise(F.lit(0.0))
    rise = (z - p["z_ref"]) * p["gradient_hypso"] / 100.0 if p["correction_elevation"] else F.lit(0.0)
    candidate = (F.lit(float(p["d0"])) + rise) * factor
    covered = F.col("coverage") > 0
    wrong = covered & (z.isNull() | F.coalesce(~finite(candidate) | (candidate < 0), F.lit(True)))
    depth = F.when(covered & ~wrong, candidate * F.col("coverage")).when(~covered, F.lit(0.0))
    return out.withColumns({"depth": depth, "invalid": wrong}).drop("_mean", "_fill", "_fill_x", "_fill_y")


def initial_surface(cells: DataFrame) -> DataFrame:
    return cells.withColumn("surface", F.col("z") + F.col("depth"))


def normal_vertical(cells: DataFrame, to: str, column: str = "depth", initial: str | None = None) -> DataFrame:
    """Convert thickness between slope-normal and vertical with `cosine`; peaks include the initial depth."""
    value = F.col(column) if initial is None else F.greatest(F.col(column), F.col(initial))
    if to == "vertical":
        return cells.withColumn("vertical", value / F.col("cosine"))
    if to != "normal":
        raise ValueError("`to` is 'vertical' or 'normal'")
    return cells.withColumn("normal", value * F.col("cosine"))


def initial_water_depth(cells: DataFrame, level: float) -> DataFrame:
    """`water`: level minus bed inside the lake (`inside`) where below level, else NULL."""
    return cells.withColumn("water", F.when(F.col("inside") & (F.col("z") < level), level - F.col("z")))


def stabilise_shore(cells: DataFrame, level: float, tol: float = schema.LAKE_WET_DEPTH, tile: int = TILE) -> DataFrame:
    """Raise dry ground outside the lake and the lake's one-cell rim to just above `level`.

    If the rim would leave no wet cell away from the grid edge, only the outside is
    raised. `guarded` marks raised cells; cells beyond the grid count as outside.
    """
    by = grain(cells)
    guard = level + tol
    tiled = halo_tiles(cells, halo=1, tile=tile)
    row = Window.partitionBy(*by, "_ti", "_tj", "j").orderBy("i").rangeBetween(-1, 1)
    column = Window.partitionBy(*by, "_ti", "_tj", "i").orderBy("j").rangeBetween(-1, 1)
    one = F.when(F.col("inside"), 1).otherwise(0)
    near = home(
        tiled.withColumn("_three", F.sum(one).over(row)).withColumn("_nine", F.sum("_three").over(column))
    )
    low = F.col("z") < guard
    outside = ~F.col("inside") & low
    rim = F.col("inside") & (F.col("_nine") < 9) & low
    edge = cells.groupBy(*by).agg(F.max("i").alias("_im"), F.max("j").alias("_jm"))
    inner = (F.col("i") > 0) & (F.col("j") > 0) & (F.col("i") < F.col("_im")) & (F.col("j") < F.col("_jm"))
    marked = near.withColumns({"_out": F.coalesce(outside, F.lit(False)), "_rim": F.coalesce(rim, F.lit(False))})
    wet = F.col("inside") & ~F.col("_rim") & (F.col("z") < level) & inner
    keep = marked.join(edge, by).groupBy(*by).agg(F.max(F.coalesce(wet, F.lit(False))).alias("_keep"))
    guarded = F.col("_out") | (F.col("_rim") & F.col("_keep"))
    return (
        marked.join(keep, by)
        .withColumn("guarded", guarded)
        .withColumn("z", F.when(F.col("guarded"), F.lit(guard)).otherwise(F.col("z")))
        .drop("_three", "_nine", "_out", "_rim", "_keep")
    )


def edge_halo(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """One more ring of cells around each grid, copying the nearest edge value; indices start at -1."""
    g = grids.select("run", "ncols", "nrows", F.col("cellsize").alias("_d"))

    def copies(index: str, count: str) -> Column:
        here = F.col(index)
        return F.explode(
            F.array_compact(
                F.array(
                    F.lit(0),
                    F.when(here == 0, F.lit(-1)),
                    F.when(here == F.col(count) - 1, F.lit(1)),
                )
            )
        )

    out = cells.join(g, "run").withColumn("_oi", copies("i", "ncols")).withColumn("_oj", copies("j", "nrows"))
    return out.withColumns(
        {
            "x": F.col("x") + F.col("_oi") * F.col("_d"),
            "y": F.col("y") + F.col("_oj") * F.col("_d"),
            "i": F.col("i") + F.col("_oi"),
            "j": F.col("j") + F.col("_oj"),
        }
    ).select(*cells.columns)


def nodal_midpoints(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """2n + 1 samples per axis: centres, their midpoints, and the edge values carried to the outer edge.

    Every cell gives weighted shares to the nodes around it and nodes add them up;
    there is no neighbour lookup. A node next to a missing value is missing.
    """

    def shares(index: str, count: str) -> Column:
        here, n = F.col(index), F.col(count)
        low = F.struct(
            (2 * here).cast("int").alias("k"), F.when(here == 0, F.lit(1.0)).otherwise(F.lit(0.5)).alias("w")
        )
        mid = F.struct((2 * here + 1).cast("int").alias("k"), F.lit(1.0).alias("w"))
        high = F.struct(
            (2 * here + 2).cast("int").alias("k"), F.when(here == n - 1, F.lit(1.0)).otherwise(F.lit(0.5)).alias("w")
        )
        return F.explode(F.array(low, mid, high))

    g = grids.select("run", "ncols", "nrows", F.col("xmin").alias("_x0"), F.col("ymin").alias("_y0"), F.col("cellsize").alias("_d"))
    out = cells.join(g, "run").withColumn("_a", shares("i", "ncols")).withColumn("_b", shares("j", "nrows"))
    out = out.select("run", "_x0", "_y0", "_d", F.col("_a.k").alias("i"), F.col("_b.k").alias("j"),
                     (F.col("_a.w") * F.col("_b.w")).alias("_w"), "z")
    return (
        out.groupBy("run", "i", "j")
        .agg(
            F.min("_x0").alias("_x0"), F.min("_y0").alias("_y0"), F.min("_d").alias("_d"),
            # A whole node has shares of one in all; a cell that is not there leaves a part of it out.
            F.when(F.sum(F.when(F.col("z").isNotNull(), F.col("_w"))) == 1, F.sum(F.col("z") * F.col("_w"))).alias("z"),
        )
        .select(
            "run", "i", "j", (F.col("_x0") + F.col("i") * F.col("_d") / 2).alias("x"),
            (F.col("_y0") + F.col("j") * F.col("_d") / 2).alias("y"), "z",
        )
    )


def derive(frames: DataFrame, quantities: dict) -> DataFrame:
    """Add user quantities: a Column, or a function of the frame returning one (a pandas UDF call included)."""
    return frames.withColumns({n: q(frames) if callable(q) else q for n, q in quantities.items()})


def snap_to_centres(points: DataFrame, grid: Geometry) -> DataFrame:
    """Move points to the nearest cell centre of `grid`; `i`, `j` may lie outside it."""
    i = to_int(round_half_up((F.col("x") - grid.xmin) / grid.dx - 0.5))
    j = to_int(round_half_up((F.col("y") - grid.ymin) / grid.dy - 0.5))
    return points.withColumns({"i": i, "j": j}).withColumns(
        {
            "x": grid.xmin + (F.col("i") + F.lit(0.5)) * grid.dx,
            "y": grid.ymin + (F.col("j") + F.lit(0.5)) * grid.dy,
        }
    )


def apply_deformation(cells: DataFrame, moved: DataFrame) -> DataFrame:
    """`bed` at `moved`'s times: initial bed plus `dz`, zero where `moved(run, t, i, j, dz)` has no row.

    `moved` comes from `interp_field_time` on the deformation frames (end values
    held), so its rows already sit on the cell grid.
    """
    times = moved.select("run", "t").distinct()
    all_times = cells.join(times, "run")
    return all_times.join(moved.select("run", "t", "i", "j", "dz"), ["run", "t", "i", "j"], "left").withColumn(
        "bed", F.col("z") + F.coalesce("dz", F.lit(0.0))
    )
