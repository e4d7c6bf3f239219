"""Joins between grids, masks, series, files and tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import Geometry, grain
from gridspark.functions.keys import close, to_int
from gridspark.functions.units import EARTH_RADIUS
from gridspark.operators.filters import altitude_zone
from gridspark.operators.sampling import interp_series


def align_mask(cells: DataFrame, mask: DataFrame, xmin: float, ymin: float, cell: float, flag: str = "flag") -> DataFrame:
    """Bring a wider mask raster (i, j, flag) onto `cells` as `masked`.

    The mask's corner may be an outer edge or a centre: whichever offset of half or
    no cell puts every cell of a run on whole mask indices is used; none, or cells
    the mask lacks, is an error.
    """
    steps = {"x": (F.col("x") - xmin) / cell, "y": (F.col("y") - ymin) / cell}

    def miss(off: float) -> Column:
        return F.max(F.greatest(*[F.abs(s - off - F.rint(s - off)) for s in steps.values()]))

    by = [k for k in grain(cells, "frame")]
    fit = cells.groupBy(*by).agg(miss(0.0).alias("_m0"), miss(0.5).alias("_m5"))
    off = (
        F.when(F.col("_m0") <= 1e-5, F.lit(0.0)).when(F.col("_m5") <= 1e-5, F.lit(0.5))
        .otherwise(F.raise_error(F.lit("the grid is not aligned with the mask")).cast("double"))
    )
    keyed = cells.join(fit.select(*by, off.alias("_off")), by).withColumns(
        {"_mi": F.rint(steps["x"] - F.col("_off")).cast("int"), "_mj": F.rint(steps["y"] - F.col("_off")).cast("int")}
    )
    m = mask.select(F.col("i").alias("_mi"), F.col("j").alias("_mj"), F.col(flag).alias("_flag"))
    lacking = F.raise_error(F.lit("the mask does not cover the grid")).cast("boolean")
    return keyed.join(m, ["_mi", "_mj"], "left").withColumn(
        "masked", F.when(F.col("_flag").isNull(), lacking).otherwise(F.col("_flag"))
    ).drop("_mi", "_mj", "_off", "_flag")


def touched_cells(footprint: DataFrame, grid: Geometry, cell: float) -> DataFrame:
    """Cells of `grid` that share area with any footprint square (x, y centres, side `cell`)."""
    half = cell / 2

    def spread(c: str, low: float, d: float, n: int) -> Column:
        first = F.greatest(F.lit(0), F.floor((F.col(c) - half - low) / d)).cast("int")
        last = F.least(F.lit(n - 1), F.ceil((F.col(c) + half - low) / d) - 1).cast("int")
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    return (
        footprint.withColumn("_i", spread("x", grid.xmin, grid.dx, grid.ncols))
        .withColumn("_j", spread("y", grid.ymin, grid.dy, grid.nrows))
        .select(F.col("_i").alias("i"), F.col("_j").alias("j"))
        .distinct()
    )


def zero_where(frames: DataFrame, footprint: DataFrame, grid: Geometry, cell: float, column: str = "h") -> DataFrame:
    """`column` set to zero in cells a footprint touches; `zeroed` marks them."""
    hit = touched_cells(footprint, grid, cell).withColumn("zeroed", F.lit(True))
    return frames.join(hit, ["i", "j"], "left").withColumns(
        {
            "zeroed": F.coalesce("zeroed", F.lit(False)),
            column: F.when(F.col("zeroed"), F.lit(0.0)).otherwise(F.col(column)),
        }
    )


def zeroed_summary(zeroed: DataFrame, column: str = "h") -> DataFrame:
    """Per frame: the remaining maximum and the number of zeroed cells (none is an error)."""
    n = F.count_if(F.col("zeroed"))
    count = F.when(n == 0, F.raise_error(F.lit("the footprint does not overlap the grid")).cast("bigint")).otherwise(n)
    return zeroed.groupBy(*grain(zeroed)).agg(F.max(column).alias("peak"), count.alias("zeroed"))


def grid_difference(a: Column, b: Column) -> Column:
    """Why two grids (structs with ncols, nrows, cellsize, xmin, ymin) do not match; NULL if they do."""
    off = lambda c: F.abs(a[c] - b[c]) > 1e-8
    return (
        F.when((a["ncols"] != b["ncols"]) | (a["nrows"] != b["nrows"]), "shape differs").when(off("cellsize"), "cell size differs")
        .when(off("xmin"), "x centres differ").when(off("ymin"), "y centres differ")
    )


def grid_pairs(grids: DataFrame, target: str) -> DataFrame:
    """Each case's target grid against its other models' grids, with the reason a pair does not match."""
    place = F.struct("ncols", "nrows", "cellsize", "xmin", "ymin")
    t = grids.where(F.col("model") == target).select("case", place.alias("_t"))
    other = grids.where(F.col("model") != target).select("case", "model", place.alias("_o"))
    return other.join(t, "case").select("case", "model", grid_difference(F.col("_o"), F.col("_t")).alias("reason"))


def pair_outputs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match thickness and speed files (case, name) per model: (pairs, exclusions).

    Two naming schemes exist; a model paired under the standard one ignores the other.
    """
    # File name endings of the two schemes, standard first (fixed values).
    schemes = ((0, "pft", "pfv"), (1, "h_max", "s_max"))
    pattern = r"(?i)^(.*)_(pft|pfv|h_max|s_max)(\.asc|\.tif|\.tiff)?$"
    f = files.select("case", "name", F.regexp_extract("name", pattern, 1).alias("stem"),
                     F.regexp_extract("name", pattern, 2).alias("kind"), F.regexp_extract("name", pattern, 3).alias("ext"))
    after = F.regexp_extract("stem", r"(?i)_null_(.+)$", 1)
    model = F.when(after != "", after).otherwise(F.substring_index("stem", "_", -1))
    f = f.where("kind <> ''").withColumn("model", model)
    scheme = F.when(F.col("kind").isin("pft", "pfv"), 0).otherwise(1)
    rank = F.array_position(F.array(*[F.lit(e) for e in ("", ".asc", ".tif", ".tiff")]), F.col("ext"))
    thick = f.where(F.col("kind").isin(*[s[1] for s in schemes])).select(
        "case", "model", "stem", scheme.alias("scheme"), F.col("name").alias("thickness")
    )
    speed = (
        f.where(F.col("kind").isin(*[s[2] for s in schemes]))
        .groupBy("case", "stem", scheme.alias("scheme")).agg(F.min_by("name", rank).alias("speed"))
    )
    both = thick.join(speed, ["case", "stem", "scheme"], "left")
    standard = both.where("scheme = 0 and speed is not null").select("case", "model").distinct().withColumn("_std", F.lit(True))
    both = both.join(standard, ["case", "model"], "left").withColumn(
        "reason",
        F.when((F.col("scheme") == 1) & F.col("_std"), "already paired under the standard names")
        .when(F.col("speed").isNull(), "no matching speed file"),
    )
    pairs = both.where("reason is null").select("case", "model", "thickness", "speed")
    return pairs, both.where("reason is not null").select("case", "model", "thickness", "reason")


def complete_frames(time_files: DataFrame, data_files: DataFrame, missing: str = "report") -> tuple[DataFrame, DataFrame]:
    """Frames with both files, and frames lacking data (an error when `missing` is "error")."""
    d = data_files.select("run", "frame").distinct()
    lacking = time_files.join(d, ["run", "frame"], "left_anti")
    if missing == "error":
        first = lacking.orderBy("run", "frame").first()
        if first is not None:
            raise ValueError(f"run {first['run']} frame {first['frame']} has no data file")
    return time_files.join(d, ["run", "frame"], "left_semi"), lacking


def observed_vs_predicted(observed: DataFrame | None, predicted: DataFrame | None, strict: bool = True) -> DataFrame:
    """Two station series (station, t, value) side by side by time.

    Either may be absent and gives a NULL column. With both, a time found on one
    side only is an error when `strict`.
    """
    if observed is None or predicted is None:
        given = observed if observed is not None else predicted
        name, other = ("observed", "predicted") if observed is not None else ("predicted", "observed")
        return given.select("station", "t", F.col("value").alias(name), F.lit(None).cast("double").alias(other))
    o = observed.select("station", "t", F.col("value").alias("observed"), F.lit(True).alias("_o"))
    p = predicted.select("station", "t", F.col("value").alias("predicted"), F.lit(True).alias("_p"))
    both = o.join(p, ["station", "t"], "full_outer")
    if strict:
        lone = F.col("_o").isNull() | F.col("_p").isNull()
        both = both.where(F.when(lone, F.raise_error(F.lit("the two series have different times")).cast("boolean")).otherwise(F.lit(True)))
    return both.drop("_o", "_p")


def compare_series(a: DataFrame, b: DataFrame, columns: Sequence[str], rtol: float = 1e-14, atol: float = 1e-8) -> DataFrame:
    """Per gauge: largest differences in t and each column, samples on one side only, and pass or fail."""
    names = ["t", *columns]
    left = a.select("gauge", "sample_no", *[F.col(c).alias(f"_a_{c}") for c in names], F.lit(1).alias("_a"))
    right = b.select("gauge", "sample_no", *[F.col(c).alias(f"_b_{c}") for c in names], F.lit(1).alias("_b"))
    both = left.join(right, ["gauge", "sample_no"], "full_outer")
    gap = {c: F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) for c in names}
    over = F.greatest(*[F.when(gap[c] > atol + rtol * F.abs(F.col(f"_b_{c}")), 1).otherwise(0) for c in names])
    out = both.groupBy("gauge").agg(
        *[F.max(gap[c]).alias(f"max_{c}") for c in names],
        F.count_if(F.col("_b").isNull()).alias("only_first"),
        F.count_if(F.col("_a").isNull()).alias("only_second"),
        F.sum(over).alias("_over"),
    )
    return out.withColumn("passed", (F.col("_over") == 0) & (F.col("only_first") == 0) & (F.col("only_second") == 0)).drop("_over")


def zone_parameters(cells: DataFrame, breaks: Sequence[float], zones: DataFrame, z: str = "z") -> DataFrame:
    """Attach `zones(zone, ...)` by bed elevation; a value on a break takes the upper zone."""
    return cells.withColumn("zone", altitude_zone(z, breaks)).join(zones, "zone", "left")


def region_roughness(cells: DataFrame, regions: Sequence[Mapping], default: float, z: str = "z", sea_level: float = 0.0) -> DataFrame:
    """`roughness` by region box, then by depth bin; later regions override earlier ones.

    A region is {lower: (x, y), upper: (x, y), depths: descending, coefficients}; boxes
    and bins are half-open. Regions are part of the run's settings, so they fold into
    one expression.
    """
    level = F.col(z) - sea_level
    out = F.lit(float(default))
    for r in regions:
        (x0, y0), (x1, y1) = r["lower"], r["upper"]
        box = (F.col("x") > x0) & (F.col("x") <= x1) & (F.col("y") > y0) & (F.col("y") <= y1)
        for k, coefficient in enumerate(r["coefficients"]):
            here = box & (level >= r["depths"][k + 1]) & (level < r["depths"][k])
            out = F.when(here, F.lit(float(coefficient))).otherwise(out)
    return cells.withColumn("roughness", out)


def fill_from_other(tracks: DataFrame, other: DataFrame, var: str, missing: float = -1.0) -> DataFrame:
    """Fill NULL `var` from another source in time, else from the track's own samples, else `missing`.

    Repeated times keep the first row of each storm.
    """
    first = lambda df: df.groupBy("storm", "t").agg(F.min_by(var, "row_no").alias(var), F.min("row_no").alias("row_no"))
    own, alien = first(tracks), first(other)
    gaps = own.where(F.col(var).isNull()).select("storm", "t", "row_no")
    # The track's own neighbours are held at the ends, the other source is not extrapolated.
    a = interp_series(alien.where(F.col(var).isNotNull()), gaps, ["storm"], [var]).select("storm", "row_no", F.col(var).alias("_a"))
    b = interp_series(own.where(F.col(var).isNotNull()), gaps, ["storm"], [var]).select("storm", "row_no", F.col(var).alias("_b"))
    return own.join(a, ["storm", "row_no"], "left").join(b, ["storm", "row_no"], "left").select(
        "storm", "t", "row_no", F.coalesce(var, "_a", "_b", F.lit(missing)).alias(var)
    )


def haversine(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Great-circle distance in metres between points in degrees."""
    dy, dx = F.radians(lat1 - lat0), F.radians(lon1 - lon0)
    a = F.pow(F.sin(dy / 2), F.lit(2)) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(dx / 2), F.lit(2))
    return 2.0 * EARTH_RADIUS * F.asin(F.sqrt(a))


def bearing(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Initial direction from the first point to the second, degrees clockwise from north."""
    dx, y0, y1 = F.radians(lon1 - lon0), F.radians(lat0), F.radians(lat1)
    north = F.cos(y0) * F.sin(y1) - F.sin(y0) * F.cos(y1) * F.cos(dx)
    east = F.sin(dx) * F.cos(y1)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def storm_proximity(tracks: DataFrame, stations: DataFrame, km: float, side: float = 1.0, digits: int | None = None) -> DataFrame:
    """Track points within `km` of each station, with distance and bearing station to eye, rounded to `digits` if given.

    Stations are spread over the lon/lat squares (of `side` degrees) their circle reaches and met by equality. Equal
    places are compared once: the points and stations there join the pairs of places found.
    """
    reach = km * 1000.0 / EARTH_RADIUS
    lat = F.col("s_lat")
    dlat = math.degrees(reach)
    edge = F.cos(F.radians(lat))
    # Half width of the circle in longitude; the whole range where it holds a pole.
    dlon = F.when(
        F.abs(lat) + dlat < 90, F.degrees(F.asin(F.least(F.lit(1.0), math.sin(reach) / edge)))
    ).otherwise(F.lit(180.0))
    columns = int(round(360.0 / side))
    named = stations.select(F.col("station"), F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"))
    s = named.select("s_lon", "s_lat").distinct().withColumn("_y", F.explode(F.sequence(to_int((F.col("s_lat") - dlat) / side), to_int((F.col("s_lat") + dlat) / side))))
    reached = F.sequence(to_int((F.col("s_lon") - dlon) / side), to_int((F.col("s_lon") + dlon) / side))
    s = s.withColumn("_x", F.explode(F.array_distinct(F.transform(reached, lambda v: F.pmod(v, F.lit(columns))))))
    t = tracks.select("lon", "lat").distinct().withColumns({"_y": to_int(F.col("lat") / side), "_x": F.pmod(to_int(F.col("lon") / side), F.lit(columns))})
    hit = t.join(s, ["_x", "_y"])
    d = haversine(F.col("s_lon"), F.col("s_lat"), F.col("lon"), F.col("lat")) / 1000.0
    b = bearing(F.col("s_lon"), F.col("s_lat"), F.col("lon"), F.col("lat"))
    near = hit.withColumns({"distance_km": d, "bearing": b}).where(F.col("distance_km") <= km).drop("_x", "_y")
    if digits is not None:
        near = near.withColumns({c: F.round(c, digits) for c in ("distance_km", "bearing")})
    # Stations of one place go along as arrays of at most 1,024, which unfold last.
    block = F.floor((F.row_number().over(Window.partitionBy("s_lon", "s_lat").orderBy("station")) - 1) / 1024)
    named = named.withColumn("_k", block).groupBy("s_lon", "s_lat", "_k").agg(F.collect_list(F.struct("station")).alias("_s"))
    found = near.join(named, ["s_lon", "s_lat"]).select("lon", "lat", "distance_km", "bearing", "_s")
    return tracks.join(found, ["lon", "lat"]).select(*tracks.columns, F.inline("_s"), "distance_km", "bearing")
