"""Projections, filters and predicates over cells, grids and run tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark import schema
from gridspark.functions import grain
from gridspark.functions.keys import clean, close, col, finite, to_int
from gridspark.functions.units import convert


def _reindexed(cells: DataFrame, box: DataFrame, on: list[str], step: int = 1) -> DataFrame:
    """Cells inside index box (i0..i1, j0..j1 inclusive, every `step`), renumbered from zero."""
    inside = (
        F.col("i").between(F.col("i0"), F.col("i1"))
        & F.col("j").between(F.col("j0"), F.col("j1"))
        & ((F.col("i") - F.col("i0")) % step == 0)
        & ((F.col("j") - F.col("j0")) % step == 0)
    )
    joined = cells.join(box.select(*on, "i0", "i1", "j0", "j1"), on).where(inside)
    return joined.withColumns(
        {
            "i": ((F.col("i") - F.col("i0")) / step).cast("int"),
            "j": ((F.col("j") - F.col("j0")) / step).cast("int"),
        }
    ).select(*cells.columns)


def crop(
    cells: DataFrame,
    grids: DataFrame,
    extent: tuple[float, float, float, float],
    coarsen: int = 1,
    buffer: int = 0,
    align: tuple[float, float] | None = None,
) -> DataFrame:
    """Cells inside `extent` (x0, x1, y0, y1 inclusive), every `coarsen`-th one.

    `align` picks the first of the `coarsen` phases closest to whole coarse steps
    from that point; `buffer` adds coarse cells outside, held to the grid.
    """

    def axis(lo: float, hi: float, edge: str, count: str, at: float | None, n: str) -> dict[str, Column]:
        d = F.col("cellsize")
        first = F.col(edge) + d / 2
        start = F.greatest(F.ceil((lo - first) / d), F.lit(0))
        stop = F.least(F.floor((hi - first) / d), F.col(count) - 1)
        if coarsen > 1 and at is not None:
            def misfit(k: int) -> Column:
                steps = (first + (start + k) * d - at) / (d * coarsen)
                return F.abs(steps - F.rint(steps))

            phase = F.array_min(F.array(*[F.struct(misfit(k).alias("m"), F.lit(k).alias("k")) for k in range(coarsen)]))
            start = start + phase["k"]
            stop = stop - F.pmod(stop - start, F.lit(coarsen))
        return {
            f"{n}0": F.greatest(F.lit(0), start - buffer * coarsen).cast("int"),
            f"{n}1": F.least(F.col(count) - 1, stop + buffer * coarsen).cast("int"),
        }

    x0, x1, y0, y1 = extent
    ax, ay = align if align is not None else (None, None)
    box = grids.select(
        "run",
        *[c.alias(k) for k, c in axis(x0, x1, "xmin", "ncols", ax, "i").items()],
        *[c.alias(k) for k, c in axis(y0, y1, "ymin", "nrows", ay, "j").items()],
    )
    return _reindexed(cells, box, ["run"], coarsen)


def crop_to_polygons(cells: DataFrame, grids: DataFrame, polys: DataFrame) -> DataFrame:
    """The grid-aligned rectangle around all rings, held to the grid and at least 3 x 3 cells."""
    rings = polys.select(F.concat(F.array("exterior"), F.coalesce("holes", F.expr("array()"))).alias("rings"))
    p = rings.select(F.explode(F.flatten("rings")).alias("p"))
    x0, x1, y0, y1 = p.agg(F.min("p.x"), F.max("p.x"), F.min("p.y"), F.max("p.y")).first()
    if x0 is None:
        raise ValueError("the polygons have no vertices")

    def lower(v: float, edge: str) -> Column:
        return F.greatest(F.lit(0), F.floor((v - F.col(edge)) / F.col("cellsize"))).cast("int")

    def upper(v: float, edge: str, count: str) -> Column:
        return F.least(F.col(count) - 1, F.ceil((v - F.col(edge)) / F.col("cellsize"))).cast("int")

    box = grids.select(
        "run", lower(x0, "xmin").alias("i0"), upper(x1, "xmin", "ncols").alias("i1"),
        lower(y0, "ymin").alias("j0"), upper(y1, "ymin", "nrows").alias("j1"),
    )
    small = (F.col("i1") - F.col("i0") < 2) | (F.col("j1") - F.col("j0") < 2)
    box = box.withColumn(
        "i0", F.when(small, F.raise_error(F.lit("the polygons cover fewer than 3 x 3 cells")).cast("int")).otherwise(F.col("i0"))
    )
    return _reindexed(cells, box, ["run"])


def _trim(count: Column, ratio: Column) -> tuple[Column, Column]:
    """Cells dropped at the low and the high edge; an odd one goes from the high edge."""
    extra = count % ratio
    low = F.floor(extra / 2).cast("int")
    return low, (extra - low).cast("int")


def _whole_ratio(cell: float | Column, source: Column) -> tuple[Column, Column]:
    ratio = F.lit(cell) / source if not isinstance(cell, Column) else cell / source
    whole = F.rint(ratio)
    return whole.cast("int"), (whole >= 1) & close(ratio, whole)


def trim_to_multiple(cells: DataFrame, grids: DataFrame, cell: float) -> DataFrame:
    """Drop edge rows and columns so that counts are whole multiples of `cell` / cellsize."""
    ratio, ok = _whole_ratio(cell, F.col("cellsize"))
    ratio = F.when(ok, ratio).otherwise(F.raise_error(F.lit("cell sizes are not a whole ratio")).cast("int"))
    g = grids.withColumn("_r", ratio)
    west, east = _trim(F.col("ncols"), F.col("_r"))
    south, north = _trim(F.col("nrows"), F.col("_r"))
    box = g.select(
        "run", west.alias("i0"), (F.col("ncols") - east - 1).alias("i1"),
        south.alias("j0"), (F.col("nrows") - north - 1).alias("j1"),
    )
    return _reindexed(cells, box, ["run"])


def fit_domain(domains: DataFrame, grids: DataFrame, cell: float) -> DataFrame:
    """Fit requested rectangles (domain, run, xmin..ymax) to their run's grid; `issue` says why not.

    Works on geometry tables alone.
    """
    g = grids.select("run", *[F.col(c).alias(f"g_{c}") for c in ("xmin", "xmax", "ymin", "ymax", "cellsize")])
    d = domains.join(g, "run")
    ratio, ok = _whole_ratio(cell, F.col("g_cellsize"))
    d = d.withColumn("_r", ratio)
    aligned, counts = None, {}
    for a in "xy":
        for e in ("min", "max"):
            steps = (F.col(a + e) - F.col(f"g_{a}min")) / F.col("g_cellsize")
            c = close(steps, F.rint(steps))
            aligned = c if aligned is None else aligned & c
        counts[a] = F.rint((F.col(a + "max") - F.col(a + "min")) / F.col("g_cellsize")).cast("int")
    covered = (
        (F.col("xmin") >= F.col("g_xmin")) & (F.col("xmax") <= F.col("g_xmax"))
        & (F.col("ymin") >= F.col("g_ymin")) & (F.col("ymax") <= F.col("g_ymax"))
    )
    short = (F.floor(counts["x"] / F.col("_r")) < 2) | (F.floor(counts["y"] / F.col("_r")) < 2)
    issue = (
        F.when((F.col("xmax") <= F.col("xmin")) | (F.col("ymax") <= F.col("ymin")), "empty rectangle")
        .when(~covered, "outside the terrain")
        .when(~ok, "cell size is not a whole multiple")
        .when(~aligned, "not aligned with the terrain")
        .when(short, "fewer than two cells")
    )
    d = d.withColumn("issue", issue).withColumn("_r", F.when(F.col("issue").isNull(), F.col("_r")))
    fitted = {}
    for a in "xy":
        low, high = _trim(counts[a], F.col("_r"))
        fitted[f"fit_{a}min"] = F.col(a + "min") + low * F.col("g_cellsize")
        fitted[f"fit_{a}max"] = F.col(a + "max") - high * F.col("g_cellsize")
    return d.withColumns(fitted).select(*domains.columns, *fitted, "issue")


def overlapping(domains: DataFrame, runs: DataFrame, bin_size: float) -> DataFrame:
    """Pairs of rectangles of one CRS that share area; touching edges do not count.

    Rectangles are spread over square bins, joined by bin, and a pair is kept only
    in the bin of its shared lower-left corner, so no pair appears twice. An empty
    CRS agrees with any. Equal rectangles are compared once; their names join the
    pairs that were found.
    """

    sides = ("crs", "xmin", "xmax", "ymin", "ymax")
    shape = lambda name: [f"{name}_{c}" for c in sides]

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            F.col(name), F.upper(F.trim(F.coalesce("crs", F.lit("")))).alias(f"{name}_crs"), *[F.col(c).alias(f"{name}_{c}") for c in sides[1:]]
        )

    def spread(df: DataFrame, name: str) -> DataFrame:
        df = df.select(*shape(name)).distinct()
        for a in "xy":
            lo, hi = (to_int(F.col(f"{name}_{a}{e}") / bin_size) for e in ("min", "max"))
            df = df.withColumn(f"_b{a}", F.explode(F.sequence(lo, hi)))
        return df

    domains, runs = named(domains, "domain"), named(runs, "run")
    a, b = spread(domains, "domain"), spread(runs, "run")
    d = lambda c: F.col(f"domain_{c}")
    r = lambda c: F.col(f"run_{c}")
    home = (to_int(F.greatest(d("xmin"), r("xmin")) / bin_size) == F.col("_bx")) & (
        to_int(F.greatest(d("ymin"), r("ymin")) / bin_size) == F.col("_by")
    )
    meet = (d("xmax") > r("xmin")) & (d("xmin") < r("xmax")) & (d("ymax") > r("ymin")) & (d("ymin") < r("ymax"))
    same = (d("crs") == r("crs")) | (d("crs") == "") | (r("crs") == "")
    pairs = a.join(b, ["_bx", "_by"]).where(home & meet & same).select(*shape("domain"), *shape("run"))
    # Small tables of few rectangles make very many pairs: domains are dealt by rectangle, or one task would unfold all of them.
    return domains.hint("merge").join(pairs, shape("domain")).join(runs, shape("run")).select("domain", "run")


def wet_mask(frames: DataFrame, wet: float = schema.WET_DEPTH, vel: float = schema.VELOCITY_DEPTH) -> DataFrame:
    """`depth` where wet, velocities `u`, `v` only where deep enough, else zero."""
    h = F.col("h")
    fast = h >= vel
    return frames.withColumns(
        {
            "depth": F.when(h >= wet, h).otherwise(F.lit(0.0)),
            "u": F.when(fast, F.try_divide(F.col("hu"), h)).otherwise(F.lit(0.0)),
            "v": F.when(fast, F.try_divide(F.col("hv"), h)).otherwise(F.lit(0.0)),
        }
    )


def clean_nonneg(cells: DataFrame, column: str = "z") -> DataFrame:
    return cells.withColumn(column, clean(column))


def nodata_to_null(cells: DataFrame, nodata: float | Column, column: str = "z") -> DataFrame:
    """NULL for values equal to `nodata` within 1e-8 + 1e-5 |nodata|, and for non-finite ones."""
    z, mark = F.col(column), nodata if isinstance(nodata, Column) else F.lit(float(nodata))
    missing = (F.abs(z - mark) <= 1e-8 + 1e-5 * F.abs(mark)) | ~finite(z)
    return cells.withColumn(column, F.when(~F.coalesce(missing, F.isnan(z)), z))


def in_ruled_region(
    cells: DataFrame, s: Sequence[float], lower: Sequence[float], upper: Sequence[float],
    axis: str = "x", linear: bool = False,
) -> DataFrame:
    """`inside`: within the region ruled along `axis` by ascending breakpoints `s`, edges included."""
    along, across = (F.col("x"), F.col("y")) if axis == "x" else (F.col("y"), F.col("x"))
    lit = lambda vs: F.array(*[F.lit(float(v)) for v in vs])
    k = F.size(F.filter(lit(s), lambda v: v <= along))

    def bound(vs: Sequence[float]) -> Column:
        here = F.try_element_at(lit(vs), k)
        if not linear:
            return here
        s0, s1 = F.try_element_at(lit(s), k), F.try_element_at(lit(s), k + 1)
        part = F.try_divide(along - s0, s1 - s0)
        return F.when((s0 >= along) | s1.isNull(), here).otherwise(
            (1 - part) * here + part * F.try_element_at(lit(vs), k + 1)
        )

    in_range = along.between(float(min(s)), float(max(s)))
    return cells.withColumn(
        "inside", F.when(in_range, (bound(lower) <= across) & (across <= bound(upper))).otherwise(F.lit(False))
    )


def thin_frames(frames: DataFrame, every: int) -> DataFrame:
    """Every `every`-th frame of a run by time, the first one included."""
    by = grain(frames, "frame")
    listing = frames.select(*by, "frame", "t").distinct()
    order = Window.partitionBy(*by).orderBy("t", "frame")
    keep = listing.withColumn("_n", F.row_number().over(order)).where((F.col("_n") - 1) % every == 0)
    return frames.join(keep.select(*by, "frame"), [*by, "frame"], "left_semi")


def convert_units(df: DataFrame, mapping: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Convert columns in place: `{column: (from, to)}`."""
    return df.withColumns({c: convert(F.col(c), *pair) for c, pair in mapping.items()})


def clip_to_active(cells: DataFrame, active: Column) -> DataFrame:
    """The index rectangle around cells where `active` holds, last row and column included."""
    by = grain(cells)
    hit = cells.where(active)
    box = hit.groupBy(*by).agg(
        F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1")
    )
    return _reindexed(cells, box, by)


def invalid_cells(cells: DataFrame, selected: Column, column: str = "z") -> DataFrame:
    """Per field: how many selected cells are missing, non-finite or negative, and the first (j, i)."""
    z = F.col(column)
    bad = selected & F.coalesce(~finite(z) | (z < 0), F.lit(True))
    return (
        cells.groupBy(*grain(cells))
        .agg(
            F.count_if(bad).alias("invalid"),
            F.min(F.when(bad, F.struct("j", "i"))).alias("_first"),
        )
        .select(*grain(cells), "invalid", F.col("_first.j").alias("first_row"), F.col("_first.i").alias("first_column"))
    )


def reject_invalid(cells: DataFrame, selected: Column, label: str, column: str = "z") -> DataFrame:
    """The same cells, or an error naming the count and the first bad place."""
    bad = invalid_cells(cells, selected, column).where("invalid > 0").orderBy(*grain(cells)).first()
    if bad is not None:
        raise ValueError(
            f"{label}: {bad['invalid']} selected cell(s) invalid; "
            f"first at row {bad['first_row']}, column {bad['first_column']}"
        )
    return cells


def altitude_zone(z: str | Column, breaks: Sequence[float]) -> Column:
    """1-based zone of an elevation; a value on a break belongs to the upper zone, NULL to zone 0."""
    z = col(z)
    below = F.filter(F.array(*[F.lit(float(b)) for b in breaks]), lambda b: b <= z) if breaks else F.array()
    return F.when(z.isNull(), F.lit(0)).otherwise(F.size(below) + 1)


# Constitutive models a run may name (fixed values).
RHEOLOGIES = ("Voellmy", "Coulomb", "cohesive_Voellmy")


def config_rules() -> dict[str, Column]:
    """Issue text -> condition under which a run row has it."""
    c = F.col
    span = lambda a: c(f"{a}max") - c(f"{a}min")
    cells = lambda a: F.try_divide(span(a), c("cell_size"))
    need = F.when(c("rheology") == "Water", 4).otherwise(10)
    whole = lambda a: (span(a) > 0) & close(cells(a), F.rint(cells(a)))
    ratio = F.try_divide(c("cell_size"), c("source_cell_size"))
    rising = F.forall(
        F.sequence(F.lit(2), F.greatest(F.size("z_breaks"), F.lit(2))),
        lambda k: F.coalesce(F.try_element_at("z_breaks", k - 1) < F.try_element_at("z_breaks", k), F.lit(True)),
    )
    return {
        "release depth must be non-negative and finite": ~finite(c("d0")) | (c("d0") < 0),
        "return period must be at least one year": c("period_return") < 1,
        "end time must be positive": c("t_max") <= 0,
        "cell size must be positive": c("cell_size") <= 0,
        "regularisation depth must be non-negative and finite": ~finite(c("reg_depth")) | (c("reg_depth") < 0),
        "output counts must be at least one": c("outputs") < 1,
        "target CFL exceeds maximum CFL": c("cfl_target") > c("cfl_max"),
        "check interval exceeds end time": c("delta_t") > c("t_max"),
        "rheology is not known": ~c("rheology").isin(*RHEOLOGIES, "Water"),
        "zone lists differ in length": (F.size("mu") != F.size("xi")) | (F.size("mu") != F.size("cohesion")),
        "zones need one break fewer than values": F.size("z_breaks") != F.size("mu") - 1,
        "zone breaks must ascend": ~rising,
        "friction values must be positive": F.exists("mu", lambda v: v <= 0) | F.exists("xi", lambda v: v <= 0),
        "cohesion must be non-negative": F.exists("cohesion", lambda v: v < 0),
        "x span is not a whole number of cells": ~whole("x"),
        "y span is not a whole number of cells": ~whole("y"),
        "x span has too few cells": whole("x") & (F.rint(cells("x")) < need),
        "y span has too few cells": whole("y") & (F.rint(cells("y")) < need),
        "terrain cell must divide the cell": (c("source_cell_size") <= 0) | (ratio < 1) | ~close(ratio, F.rint(ratio)),
    }


def validate_config(runs: DataFrame) -> DataFrame:
    """One row per run and broken rule; a rule that cannot be evaluated counts as broken."""
    found = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(text)) for text, bad in config_rules().items()])
    )
    return runs.select("run", F.explode(found).alias("issue"))


def validate_regular_rectangle(cells: DataFrame) -> DataFrame:
    """Per field: axis sizes, row count, duplicates, spacing ranges and whether it is a full regular grid."""
    by = grain(cells)
    axes = []
    for a in "xy":
        values = cells.select(*by, a).distinct()
        step = F.col(a) - F.lag(a).over(Window.partitionBy(*by).orderBy(a))
        axes.append(
            values.withColumn("_d", step).groupBy(*by).agg(
                F.count("*").alias(f"n{a}"), F.min("_d").alias(f"d{a}_min"), F.max("_d").alias(f"d{a}_max")
            )
        )
    # Duplicates by cell first, so that no group gathers a whole field.
    counts = cells.groupBy(*by, "x", "y").agg(F.count("*").alias("_c")).groupBy(*by).agg(
        F.sum("_c").alias("n"), F.sum(F.col("_c") - 1).alias("duplicates")
    )
    out = counts.join(axes[0], by).join(axes[1], by)
    regular = (
        (F.col("duplicates") == 0) & (F.col("nx") * F.col("ny") == F.col("n"))
        & close(F.col("dx_min"), F.col("dx_max")) & close(F.col("dy_min"), F.col("dy_max"))
    )
    return out.withColumn("regular", F.coalesce(regular, F.lit(False)))
