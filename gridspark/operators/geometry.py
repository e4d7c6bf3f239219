"""Polygons, neighbourhoods, scattered points and overlapping rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import Geometry, grain, halo_tiles
from gridspark.functions.keys import to_int
from gridspark.functions.tiles import TILE, home

# Nearness to a grid line, in cells, that counts as lying on it.
SNAP = 1e-9


def shoreline_faces(wet: DataFrame, grid: Geometry) -> DataFrame:
    """A face for every wet cell side whose neighbour is dry or outside: centre, inward normal, length.

    `wet` holds wet cells only. Each cell names its four neighbours and an anti join
    keeps the sides no wet cell answers.
    """
    by = grain(wet)
    # Outward step and inward normal of the four sides.
    sides = F.array(*[
        F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj"), F.lit(float(-di)).alias("nx"), F.lit(float(-dj)).alias("ny"))
        for di, dj in ((-1, 0), (1, 0), (0, -1), (0, 1))
    ])
    open_sides = wet.select(*by, "i", "j", F.inline(sides)).withColumns({"ni": F.col("i") + F.col("di"), "nj": F.col("j") + F.col("dj")})
    near = wet.select(*by, F.col("i").alias("ni"), F.col("j").alias("nj"))
    x = grid.xmin + (F.col("i") + F.lit(0.5)) * grid.dx
    y = grid.ymin + (F.col("j") + F.lit(0.5)) * grid.dy
    return open_sides.join(near, [*by, "ni", "nj"], "left_anti").select(
        *by, x.alias("target_x"), y.alias("target_y"),
        (x + F.col("di") * (grid.dx / 2)).alias("face_x"), (y + F.col("dj") * (grid.dy / 2)).alias("face_y"),
        "nx", "ny", F.when(F.col("di") != 0, F.lit(grid.dy)).otherwise(F.lit(grid.dx)).alias("length"),
    )


def _edges(polys: DataFrame) -> DataFrame:
    """Ring edges (pid, ring, x0, y0, x1, y1); ring 0 is the exterior, rings are closed, short ones dropped."""
    rings = polys.select(
        "pid", F.posexplode(F.concat(F.array("exterior"), F.coalesce("holes", F.expr("array()")))).alias("ring", "pts")
    ).where(F.size("pts") >= 3)
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    closed = F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), F.col("pts")).otherwise(F.concat("pts", F.array(first)))
    rings = rings.withColumn("pts", closed)
    n = F.size("pts")
    pairs = F.arrays_zip(F.slice("pts", F.lit(1), n - 1).alias("a"), F.slice("pts", F.lit(2), n - 1).alias("b"))
    return rings.select("pid", "ring", F.explode(pairs).alias("e")).select(
        "pid", "ring", F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"), F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1")
    )


def _row_spans(polys: DataFrame, grid: Geometry, sub: int = 1) -> DataFrame:
    """Per ring and (sub-)row, index intervals [a, b) of the centres inside the ring.

    Every edge emits its crossing with each row line it passes; sorted crossings of
    a row pair up into intervals, so cost follows the outline, not the area.
    """
    dx, dy = grid.dx / sub, grid.dy / sub
    e = _edges(polys).where("y0 <> y1")
    lo, hi = F.least("y0", "y1"), F.greatest("y0", "y1")
    # Rows whose centre line y satisfies lo <= y < hi.
    j0 = F.greatest(F.lit(0), F.ceil((lo - grid.ymin) / dy - 0.5))
    j1 = F.least(F.lit(grid.nrows * sub - 1), F.ceil((hi - grid.ymin) / dy - 0.5) - 1)
    e = e.withColumns({"_j0": j0.cast("int"), "_j1": j1.cast("int")}).where("_j0 <= _j1")
    e = e.withColumn("j", F.explode(F.sequence("_j0", "_j1")))
    y = grid.ymin + (F.col("j") + F.lit(0.5)) * dy
    x = F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    e = e.withColumn("at", F.ceil((x - grid.xmin) / dx - 0.5).cast("int"))
    w = Window.partitionBy("pid", "ring", "j").orderBy("at", "x0", "y0")
    paired = e.withColumns({"_n": F.row_number().over(w), "b": F.lead("at").over(w)}).where("_n % 2 = 1")
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(grid.ncols * sub), F.col(c)))
    return paired.select("pid", "ring", "j", clamp("at").alias("a"), clamp("b").alias("b")).where("a < b")


def cells_in_polygons(polys: DataFrame, grid: Geometry) -> DataFrame:
    """Cells (i, j) whose centre lies in an exterior and in none of its holes, for any polygon."""
    cells = _row_spans(polys, grid).withColumn("i", F.explode(F.sequence(F.col("a"), F.col("b") - 1)))
    holes = cells.where("ring > 0").select("pid", "i", "j")
    inside = cells.where("ring = 0").select("pid", "i", "j").join(holes, ["pid", "i", "j"], "left_anti")
    return inside.select("i", "j").distinct()


def points_in_polygons(cells: DataFrame, polys: DataFrame, grid: Geometry) -> DataFrame:
    """`inside` for each cell of every field on `grid`."""
    hit = cells_in_polygons(polys, grid).withColumn("inside", F.lit(True))
    return cells.join(hit, ["i", "j"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def boundary_cells(polys: DataFrame, grid: Geometry) -> DataFrame:
    """Cells whose closed square a ring segment touches.

    In units of cells, a segment is cut wherever it crosses a line between two rows. What lies between two cuts is
    in one row and touches the columns it reaches; an end, or a piece along a line, touches the squares on both sides.
    """
    snapped = lambda c: F.when(F.abs(c - F.round(c)) < SNAP, F.round(c)).otherwise(c)
    point = lambda v, u: F.struct(v.alias("v"), u.alias("u"))
    corner = lambda k: point(snapped((F.col(f"y{k}") - grid.ymin) / grid.dy), snapped((F.col(f"x{k}") - grid.xmin) / grid.dx))
    e = _edges(polys).select(corner(0).alias("c0"), corner(1).alias("c1"))
    e = e.select(F.least("c0", "c1").alias("low"), F.greatest("c0", "c1").alias("high"))
    across = F.try_divide(F.col("high.u") - F.col("low.u"), F.col("high.v") - F.col("low.v"))
    first = F.greatest(F.lit(0), F.floor("low.v") + 1).cast("int")
    last = F.least(F.lit(grid.nrows), F.ceil("high.v") - 1).cast("int")
    lines = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    cuts = F.transform(lines, lambda k: point(k.cast("double"), snapped(F.col("low.u") + (k - F.col("low.v")) * across)))
    # The lower end twice: a piece without length for the squares that meet in it.
    e = e.select(F.concat(F.array("low", "low"), cuts, F.array("high")).alias("stops"))
    e = e.select(F.explode(F.transform("stops", lambda s, n: F.struct(s.alias("s"), F.coalesce(F.get("stops", n + 1), s).alias("t")))).alias("p"))
    level = F.col("p.s.v") == F.col("p.t.v")
    side = lambda lo, hi, n: F.when((hi >= 0) & (lo < n), F.sequence(F.greatest(F.lit(0), lo).cast("int"), F.least(F.lit(n - 1), hi).cast("int")))
    row = F.floor("p.s.v")
    e = e.withColumn("j", F.explode(side(F.when(level, F.ceil("p.s.v") - 1).otherwise(row), row, grid.nrows)))
    e = e.withColumn("i", F.explode(side(F.ceil(F.least("p.s.u", "p.t.u")) - 1, F.floor(F.greatest("p.s.u", "p.t.u")), grid.ncols)))
    return e.select("i", "j").distinct()


def polygon_coverage(polys: DataFrame, grid: Geometry, subsamples: int = 64) -> DataFrame:
    """Covered share (i, j, coverage) of every cell the union of polygons touches.

    Cells off the outline are 0 or 1 by their centre. Outline cells count samples on
    a `subsamples` square grid, one row of samples at a time: each sample row holds
    the union of the polygons as disjoint index intervals, and a cell adds up the
    overlap of its own index range with them.
    """
    edge = boundary_cells(polys, grid)
    spans = _row_spans(polys, grid, subsamples)
    # Sweep each sample row: a polygon is on while inside its exterior and outside its holes.
    ends = F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d")))
    marks = spans.select("pid", "ring", "j", F.inline(ends))
    steps = marks.groupBy("pid", "j", "at").agg(
        F.sum(F.when(F.col("ring") == 0, F.col("d")).otherwise(0)).alias("_e"), F.sum(F.when(F.col("ring") > 0, F.col("d")).otherwise(0)).alias("_h")
    )
    w = Window.partitionBy("pid", "j").orderBy("at")
    on = (F.sum("_e").over(w) > 0) & (F.sum("_h").over(w) <= 0)
    steps = steps.withColumn("_on", on.cast("int"))
    steps = steps.withColumn("_d", F.col("_on") - F.coalesce(F.lag("_on").over(w), F.lit(0))).where("_d <> 0")
    level = steps.groupBy("j", "at").agg(F.sum("_d").alias("_d"))
    row = Window.partitionBy("j").orderBy("at")
    pieces = level.withColumns({"_n": F.sum("_d").over(row), "b": F.lead("at").over(row)}).where("_n > 0 and b is not null")
    rows = pieces.groupBy(F.col("j").alias("_J")).agg(F.collect_list(F.struct(F.col("at").alias("a"), "b")).alias("_spans"))
    sub = edge.withColumn("_J", F.explode(F.sequence(F.col("j") * subsamples, F.col("j") * subsamples + subsamples - 1)))
    first = F.col("i") * subsamples
    overlap = F.aggregate(
        "_spans", F.lit(0), lambda acc, s: acc + F.greatest(F.lit(0), F.least(s["b"], first + subsamples) - F.greatest(s["a"], first))
    )
    outline = (
        sub.join(rows, "_J", "left").groupBy("i", "j")
        .agg((F.sum(F.coalesce(overlap, F.lit(0))) / F.lit(float(subsamples * subsamples))).alias("coverage"))
    )
    whole = cells_in_polygons(polys, grid).join(edge, ["i", "j"], "left_anti").withColumn("coverage", F.lit(1.0))
    return whole.unionByName(outline)


def touched_union(layers: list[DataFrame], grid: Geometry) -> DataFrame:
    """Cells touched by the outlines of any of several polygon tables."""
    out = boundary_cells(layers[0], grid)
    for polys in layers[1:]:
        out = out.union(boundary_cells(polys, grid))
    return out.distinct()


def within_radius(fill: DataFrame, points: DataFrame, r: float) -> DataFrame:
    """Fill points closer than `r` to any data point.

    Data points go to squares of side r; a fill point looks into the nine around it.
    Squares of half that side settle most fill points without comparing any pair:
    two points of one small square are always closer than r.
    """
    small = r / 2
    key = lambda df, side, a, b: df.withColumns({a: F.floor(F.col("x") / side), b: F.floor(F.col("y") / side)})
    f = key(fill, small, "_a", "_b")
    settled = key(points.select("x", "y"), small, "_a", "_b").select("_a", "_b").distinct()
    near = f.join(settled, ["_a", "_b"], "left_semi")
    rest = f.join(settled, ["_a", "_b"], "left_anti")
    bucket = lambda c: F.floor(F.col(c) / r)
    around = lambda c: F.explode(F.sequence(bucket(c) - 1, bucket(c) + 1))
    q = points.select(F.col("x").alias("_px"), F.col("y").alias("_py")).distinct()
    # The data side is spread, so the semi join stops at a fill point's first match.
    q = q.withColumns({"_u": F.floor(F.col("_px") / r), "_v": F.floor(F.col("_py") / r)})
    q = q.withColumn("_u", F.explode(F.sequence(F.col("_u") - 1, F.col("_u") + 1))).withColumn("_v", F.explode(F.sequence(F.col("_v") - 1, F.col("_v") + 1)))
    rest = rest.withColumns({"_u": bucket("x"), "_v": bucket("y")})
    dx, dy = F.col("x") - F.col("_px"), F.col("y") - F.col("_py")
    hit = rest.join(q, (rest["_u"] == q["_u"]) & (rest["_v"] == q["_v"]) & (F.sqrt(dx * dx + dy * dy) < r), "left_semi")
    return near.select(*fill.columns).unionByName(hit.select(*fill.columns))


def blend_fill(points: DataFrame, fill: DataFrame, extent: tuple[float, float, float, float], r: float) -> DataFrame:
    """Data points plus the valid fill points inside `extent` (x0, x1, y0, y1) and not within `r` of data."""
    x0, x1, y0, y1 = extent
    inside = fill.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1) & F.col("z").isNotNull())
    close_by = within_radius(inside, points, r).select("x", "y").distinct()
    far = inside.join(close_by, ["x", "y"], "left_anti")
    return points.select("x", "y", "z", F.lit("data").alias("origin")).unionByName(far.select("x", "y", "z", F.lit("fill").alias("origin")))


def nearest_point(nodes: DataFrame, points: DataFrame, start: float, rounds: int = 40) -> DataFrame:
    """Value of the nearest scattered point (x, y, z; `pid` breaks ties) for every node (x, y).

    Nodes look into the nine squares around them. A best distance within the square
    side is final; the others go on with squares twice as wide. `start` near the node
    spacing keeps few nodes per square, so a crowded square costs its own points only.
    """
    from gridspark.session import checkpoint_dir

    checkpoint_dir(nodes.sparkSession)
    left, done, side = nodes.select("x", "y"), None, float(start)
    for _ in range(rounds):
        key = lambda c: F.floor(F.col(c) / side)
        spread = left.withColumn("_u", F.explode(F.sequence(key("x") - 1, key("x") + 1))).withColumn(
            "_v", F.explode(F.sequence(key("y") - 1, key("y") + 1))
        )
        p = points.select(F.col("x").alias("_px"), F.col("y").alias("_py"), "z", "pid").withColumns(
            {"_u": key("_px"), "_v": key("_py")}
        )
        dx, dy = F.col("x") - F.col("_px"), F.col("y") - F.col("_py")
        near = spread.join(p, ["_u", "_v"]).withColumn("_d2", dx * dx + dy * dy)
        best = near.groupBy("x", "y").agg(F.min(F.struct("_d2", "pid", "z")).alias("_b")).where(F.col("_b._d2") <= side * side)
        found = left.join(best, ["x", "y"], "left").checkpoint()
        hit = found.where("_b is not null").select("x", "y", F.col("_b.z").alias("z"), F.col("_b.pid").alias("pid"))
        done = hit if done is None else done.unionByName(hit)
        left = found.where("_b is null").select("x", "y")
        if left.isEmpty():
            return done
        side *= 2
    raise ValueError("no point within reach of some nodes")


def project_to_line(points: DataFrame, line: list[tuple[float, float]]) -> DataFrame:
    """`along`: distance along the polyline of the nearest place on it; ties take the first segment.

    The line is a setting: its segments become one array and rows meet no join.
    """
    segs, total = [], 0.0
    for (x0, y0), (x1, y1) in zip(line, line[1:]):
        length = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
        if length > 0:
            segs.append((x0, y0, x1 - x0, y1 - y0, length, total))
            total += length
    names = ("x0", "y0", "vx", "vy", "length", "start")
    array = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, s)], F.lit(k).alias("k")) for k, s in enumerate(segs)])

    def place(s: Column) -> Column:
        rx, ry = F.col("x") - s["x0"], F.col("y") - s["y0"]
        f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rx * s["vx"] + ry * s["vy"]) / (s["length"] * s["length"])))
        cx, cy = rx - f * s["vx"], ry - f * s["vy"]
        return F.struct((cx * cx + cy * cy).alias("d2"), s["k"].alias("k"), (s["start"] + f * s["length"]).alias("along"))

    return points.withColumn("along", F.array_min(F.transform(array, place))["along"])


def runout(cells: DataFrame, line: list[tuple[float, float]], thresholds: list[float], value: str = "v") -> DataFrame:
    """Furthest distance along a line of cells above each threshold, 0 for none."""
    by = grain(cells)
    placed = project_to_line(cells, line)
    peaks = placed.groupBy(*by).agg(
        *[F.coalesce(F.max(F.when(F.col(value) > t, F.col("along"))), F.lit(0.0)).alias(f"_{k}") for k, t in enumerate(thresholds)]
    )
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{k}").alias("runout")) for k, t in enumerate(thresholds)])
    return peaks.select(*by, F.inline(rows))


def smooth(cells: DataFrame, where: Column, r: int = 1, column: str = "z", tile: int = TILE) -> DataFrame:
    """Mean of the (2r+1)^2 square, cut at the grid edge, for cells where `where` holds.

    Every mean uses original values, so the result does not depend on an order.
    """
    by = grain(cells)
    tiled = halo_tiles(cells, halo=r, tile=tile)
    row = Window.partitionBy(*by, "_ti", "_tj", "j").orderBy("i").rangeBetween(-r, r)
    col = Window.partitionBy(*by, "_ti", "_tj", "i").orderBy("j").rangeBetween(-r, r)
    t = tiled.withColumns({"_s": F.sum(column).over(row), "_c": F.count(column).over(row)})
    t = t.withColumns({"_s": F.sum("_s").over(col), "_c": F.sum("_c").over(col)})
    return home(t).withColumn(column, F.when(where, F.try_divide("_s", "_c")).otherwise(F.col(column))).drop("_s", "_c")


def fill_missing(cells: DataFrame, column: str = "z") -> DataFrame:
    """Missing cells take the mean of the valid original cells in the smallest square around them that holds any.

    Running counts over rows, then columns, tell from four lookups whether a square holds a value. Each missing cell doubles
    its radius until it does, then halves in on the smallest one, so large gaps take few rounds. All values of the
    smallest square lie on its rim, whose sides are put together from sums of 1, 2, 4, ... neighbouring cells: sums are only ever
    added, in double precision, so that neither tiny nor huge values are lost. Cells that a grid lacks are
    no values and are not added; fields without any value stay as they are.
    """
    from gridspark.session import checkpoint_dir

    checkpoint_dir(cells.sparkSession)
    by = grain(cells)
    size = cells.groupBy(*by).agg(F.min("i").alias("_i0"), F.max("i").alias("_im"), F.min("j").alias("_j0"), F.max("j").alias("_jm"), F.count(column).alias("_valid"))
    size = size.where("_valid > 0").drop("_valid").checkpoint()
    whole = size.withColumn("j", F.explode(F.sequence("_j0", "_jm"))).repartition(*by, "j").withColumn("i", F.explode(F.sequence("_i0", "_im")))
    row = Window.partitionBy(*by, "j").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    col = Window.partitionBy(*by, "i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    valid = cells.where(F.col(column).isNotNull()).select(*by, "i", "j", F.col(column).cast("double").alias("_z"))
    table = whole.select(*by, "i", "j").join(valid, [*by, "i", "j"], "left").select(*by, "i", "j", F.count("_z").over(row).alias("_n"))
    table = table.select(*by, "i", "j", F.sum("_n").over(col).alias("_n")).checkpoint()
    open_ = cells.where(F.col(column).isNull()).select(*by, "i", "j").distinct().join(size, by)
    open_ = open_.withColumns({"_lo": F.lit(0), "_hi": F.lit(None).cast("int")})
    found = None
    while True:
        r = F.when(F.col("_hi").isNull(), F.greatest(F.lit(1), 2 * F.col("_lo"))).otherwise(F.floor((F.col("_lo") + F.col("_hi")) / 2).cast("int"))
        t = open_.withColumn("_r", r.cast("int"))
        i0, i1 = F.greatest(F.col("_i0"), F.col("i") - F.col("_r")) - 1, F.least(F.col("_im"), F.col("i") + F.col("_r"))
        j0, j1 = F.greatest(F.col("_j0"), F.col("j") - F.col("_r")) - 1, F.least(F.col("_jm"), F.col("j") + F.col("_r"))
        corner = lambda a, b, g: F.struct(a.alias("_a"), b.alias("_b"), F.lit(g).alias("_g"))
        t = t.withColumn("_k", F.explode(F.array(corner(i1, j1, 1), corner(i0, j1, -1), corner(i1, j0, -1), corner(i0, j0, 1))))
        t = t.select("*", "_k.*").drop("_k").where("_a >= _i0 and _b >= _j0")
        look = table.select(*by, F.col("i").alias("_a"), F.col("j").alias("_b"), "_n")
        keys = [*by, "i", "j", "_i0", "_im", "_j0", "_jm", "_lo", "_hi", "_r"]
        t = t.join(look, [*by, "_a", "_b"]).groupBy(*keys).agg((F.sum(F.col("_n") * F.col("_g")) > 0).alias("_some"))
        # The radius lies above _lo and is at most _hi.
        t = t.withColumns({"_hi": F.when(F.col("_some"), F.col("_r")).otherwise(F.col("_hi")), "_lo": F.when(F.col("_some"), F.col("_lo")).otherwise(F.col("_r"))})
        t = t.withColumn("_end", F.coalesce(F.col("_hi") == F.col("_lo") + 1, F.lit(False))).drop("_r", "_some").checkpoint()
        hit = t.where("_end").select(*by, "i", "j", F.col("_hi").alias("_r"))
        found = hit if found is None else found.unionByName(hit)
        open_ = t.where("not _end").drop("_end")
        if open_.isEmpty():
            break
    filled = rim_means(valid, found, by)
    return cells.join(filled, [*by, "i", "j"], "left").withColumn(column, F.coalesce(F.col(column), F.col("_fill").cast(dict(cells.dtypes)[column]))).drop("_fill")


def rim_means(valid: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, j, _fill): mean of the `_z` on the rim of radius `_r` around each cell of `found`.

    Runs of 2^m cells that start at a multiple of their length have their sums kept, along rows and along columns; any
    stretch of a row or column is at most two of them for each m."""
    most = found.agg(F.max("_r")).first()[0]
    levels = F.sequence(F.lit(0), F.lit((2 * (most or 0) + 1).bit_length()))
    side = lambda row, line, at: F.struct(F.lit(row).alias("_row"), line.alias("_line"), at.alias("_at"))
    runs = valid.select(*by, "_z", F.inline(F.array(side(True, F.col("j"), F.col("i")), side(False, F.col("i"), F.col("j"))))).withColumn("_m", F.explode(levels))
    runs = runs.withColumn("_run", F.floor(F.col("_at") / F.pow(F.lit(2), F.col("_m"))).cast("long"))
    runs = runs.groupBy(*by, "_row", "_line", "_m", "_run").agg(F.sum("_z").alias("_s"), F.count("*").alias("_c"))
    i, j, r = F.col("i"), F.col("j"), F.col("_r")
    edge = lambda row, line, a, b: F.struct(F.lit(row).alias("_row"), line.alias("_line"), a.alias("_a"), b.alias("_b"))
    sides = F.array(edge(True, j - r, i - r, i + r), edge(True, j + r, i - r, i + r), edge(False, i - r, j - r + 1, j + r - 1), edge(False, i + r, j - r + 1, j + r - 1))
    parts = found.select(*by, "i", "j", F.inline(sides)).withColumn("_m", F.explode(levels))
    length = F.pow(F.lit(2), F.col("_m"))
    # Whole runs of length 2^m inside the stretch are numbered from _l to below _h; an odd end is not part of a longer one.
    parts = parts.withColumns({"_l": F.ceil(F.col("_a") / length).cast("long"), "_h": F.floor((F.col("_b") + 1) / length).cast("long")}).where("_l < _h")
    odd = lambda c: F.pmod(F.col(c), F.lit(2)) == 1
    ends = F.array(F.when(odd("_l"), F.col("_l")), F.when(odd("_h"), F.col("_h") - 1))
    parts = parts.withColumn("_run", F.explode(ends)).where("_run is not null")
    met = parts.join(runs, [*by, "_row", "_line", "_m", "_run"])
    return met.groupBy(*by, "i", "j").agg((F.sum("_s") / F.sum("_c")).alias("_fill"))


def ruled_cover(cells: DataFrame, selected: Column, axis: str = "x", d: float = 1.0, stepped: bool = True) -> DataFrame:
    """Ruled region around selected cells: (s, lower, upper) per column (axis x) or row (axis y).

    Stepped regions reach the cells' edges and end with one more breakpoint.
    """
    by = grain(cells)
    along, across = ("x", "y") if axis == "x" else ("y", "x")
    out = cells.where(selected).groupBy(*by, F.col(along).alias("s")).agg(F.min(across).alias("lower"), F.max(across).alias("upper"))
    if not stepped:
        return out
    out = out.withColumns({"s": F.col("s") - d / 2, "lower": F.col("lower") - d / 2, "upper": F.col("upper") + d / 2})
    end = out.groupBy(*by).agg(F.max(F.struct("s", "lower", "upper")).alias("_e")).select(
        *by, (F.col("_e.s") + d).alias("s"), F.col("_e.lower").alias("lower"), F.col("_e.upper").alias("upper")
    )
    return out.unionByName(end)


def mosaic(sources: DataFrame, target: Geometry) -> DataFrame:
    """One raster from overlapping ones: each target cell takes the smallest-celled source with a value there.

    `sources(source, x, y, dx, dy, z)`: every source cell names the target centres it
    holds; a target cell is missing only if no source has a value.
    """

    def spread(c: str, d: str, low: float, step: float, n: int) -> Column:
        first = F.ceil((F.col(c) - F.col(d) / 2 - low) / step - 0.5)
        last = F.ceil((F.col(c) + F.col(d) / 2 - low) / step - 0.5) - 1
        a, b = F.greatest(F.lit(0), first).cast("int"), F.least(F.lit(n - 1), last).cast("int")
        return F.explode(F.when(a <= b, F.sequence(a, b)))

    s = sources.withColumn("i", spread("x", "dx", target.xmin, target.dx, target.ncols))
    s = s.withColumn("j", spread("y", "dy", target.ymin, target.dy, target.nrows))
    rank = F.when(F.col("z").isNotNull(), F.struct((F.col("dx") * F.col("dy")).alias("area"), "source"))
    by = grain(sources)
    return s.groupBy(*by, "i", "j").agg(F.min_by("z", rank).alias("z"), F.min_by("source", rank).alias("source"))


def cell_average(sources: DataFrame, geometry: DataFrame, target: Geometry) -> DataFrame:
    """Area mean over each target cell of the piecewise bilinear surface of the finest source around.

    `geometry(source, x0, y0, dx, dy, nx, ny)` gives node positions, `sources(source, i,
    j, z)` the nodes; both may carry field keys. A target cell is cut at the node lines of the sources that reach
    it; a piece lies in one source cell, where the surface's mean is its centre
    value. Cells not fully covered have `covered` false. Fields of one arrangement of sources share the cutting.
    """

    by = grain(geometry)

    def reach(x0: str, d: str, n: str, low: float, step: float, count: int) -> Column:
        first = F.greatest(F.lit(0), F.floor((F.col(x0) - low) / step)).cast("int")
        last = F.least(F.lit(count - 1), F.ceil((F.col(x0) + (F.col(n) - 1) * F.col(d) - low) / step) - 1).cast("int")
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    g = geometry.withColumn("ti", reach("x0", "dx", "nx", target.xmin, target.dx, target.ncols))
    g = g.withColumn("tj", reach("y0", "dy", "ny", target.ymin, target.dy, target.nrows))

    def cuts(c: str, x0: str, d: str, n: str, low: float, step: float) -> Column:
        a = low + F.col(c) * F.lit(step)
        b = a + F.lit(step)
        k0 = F.greatest(F.lit(0), F.ceil((a - F.col(x0)) / F.col(d))).cast("int")
        k1 = F.least(F.col(n) - 1, F.floor((b - F.col(x0)) / F.col(d))).cast("int")
        lines = F.when(k0 <= k1, F.transform(F.sequence(k0, k1), lambda k: F.col(x0) + k * F.col(d))).otherwise(F.expr("cast(array() as array<double>)"))
        return F.concat(lines, F.array(a, b))

    g = g.withColumns({
        "_xs": cuts("ti", "x0", "dx", "nx", target.xmin, target.dx), "_ys": cuts("tj", "y0", "dy", "ny", target.ymin, target.dy),
    })
    per_cell = g.groupBy(*by, "ti", "tj").agg(
        F.sort_array(F.collect_list(F.struct((F.col("dx") * F.col("dy")).alias("area"), "source", "x0", "y0", "dx", "dy", "nx", "ny"))).alias("_src"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("_xs")))).alias("_xs"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("_ys")))).alias("_ys"),
    )
    pieces = lambda c: F.explode(F.arrays_zip(F.slice(c, F.lit(1), F.size(c) - 1).alias("a"), F.slice(c, F.lit(2), F.size(c) - 1).alias("b")))
    kind = ["ti", "tj", "_src"]
    p = per_cell.select(*kind, "_xs", "_ys").distinct().select(*kind, "_ys", pieces("_xs").alias("_px"))
    p = p.select(*kind, "_px", pieces("_ys").alias("_py"))
    p = p.withColumns({
        "x": (F.col("_px.a") + F.col("_px.b")) / 2, "y": (F.col("_py.a") + F.col("_py.b")) / 2,
        "_area": (F.col("_px.b") - F.col("_px.a")) * (F.col("_py.b") - F.col("_py.a")),
    })
    holds = lambda s: (
        F.col("x").between(s["x0"], s["x0"] + (s["nx"] - 1) * s["dx"]) & F.col("y").between(s["y0"], s["y0"] + (s["ny"] - 1) * s["dy"])
    )
    p = p.withColumn("_s", F.try_element_at(F.filter("_src", holds), F.lit(1))).where("_s is not null")
    fx, fy = (F.col("x") - F.col("_s.x0")) / F.col("_s.dx"), (F.col("y") - F.col("_s.y0")) / F.col("_s.dy")
    a = F.least(F.floor(fx), F.col("_s.nx") - 2)
    b = F.least(F.floor(fy), F.col("_s.ny") - 2)
    one = lambda di, dj: F.struct(
        (a + di).cast("int").alias("i"), (b + dj).cast("int").alias("j"),
        (F.col("_area") * (fx - a if di else 1 - (fx - a)) * (fy - b if dj else 1 - (fy - b))).alias("_w"),
    )
    p = p.select(*kind, F.col("_s.source").alias("source"), F.inline(F.array(one(0, 0), one(1, 0), one(0, 1), one(1, 1))))
    # Shares of one node add up before the join: far fewer rows meet the node table.
    p = p.groupBy(*kind, "source", "i", "j").agg(F.sum("_w").alias("_w"))
    # The planner cannot tell how many rows the cuts make: neither they nor the shares of all fields may pass for a small table to broadcast.
    p = per_cell.select(*by, *kind).hint("merge").join(p.hint("merge"), kind).drop("_src").hint("merge")
    full = target.dx * target.dy
    return p.join(sources.select(*by, "source", "i", "j", "z").hint("merge"), [*by, "source", "i", "j"]).groupBy(*by, "ti", "tj").agg(
        (F.sum(F.col("_w") * F.col("z")) / F.sum(F.when(F.col("z").isNotNull(), F.col("_w")))).alias("mean"),
        (F.abs(F.sum(F.when(F.col("z").isNotNull(), F.col("_w")).otherwise(F.lit(0.0))) - full) <= 1e-9 * full).alias("covered"),
    ).withColumnsRenamed({"ti": "i", "tj": "j"})
