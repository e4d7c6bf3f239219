"""Aggregations over fields, frames, patches and score tables.

Each is one grouped aggregate where the definition allows, so map-side partial
aggregation does most of the work; times of maxima ride along as ordered structs
instead of windows over a cell's history.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark import schema
from gridspark.functions import Geometry, grain
from gridspark.functions.keys import clean, close
from gridspark.operators.fields import slope_terms


def cell_maxima(
    frames: DataFrame, values: Sequence[str] = ("h", "s", "hs", "hss"), dry: float = schema.WET_DEPTH,
    sea_level: float | None = None, arrival_tol: float = 0.0, min_level: int = 0,
) -> DataFrame:
    """Per cell: the maximum of each value and its earliest time, minimum depth and first arrival.

    With a `level` column only rows of the cell's finest level count for maxima, the finest with a value of its own;
    missing (NULL or NaN) values do not count.
    Arrival is the first time deeper than `dry` and, given `sea_level`, with a
    surface above it by `arrival_tol`.
    """
    by = grain(frames, "frame")
    level = F.col("level") if "level" in frames.columns else F.lit(0)
    wet = (F.col("h") > dry) & (level >= min_level)
    if sea_level is not None:
        wet = wet & (F.col("h") + F.col("b") > sea_level + arrival_tol)

    def peak(v: str) -> list[Column]:
        # Earliest among equal maxima: order by level, then value, both descending, then time.
        given = F.col(v).isNotNull() & ~F.isnan(v)
        best = F.min(F.when(given, F.struct((-level).alias("l"), (-F.col(v)).alias("v"), F.col("t").alias("t"))))
        return [(-best["v"]).alias(f"max_{v}"), best["t"].alias(f"time_{v}")]

    return frames.groupBy(*by, "i", "j").agg(
        *[c for v in values for c in peak(v)],
        F.min(F.when(F.col("h").isNotNull() & ~F.isnan("h"), F.struct((-level).alias("l"), F.col("h").alias("h"))))["h"].alias("min_h"),
        F.min(F.when(wet, F.col("t"))).alias("arrival"),
    )


def surface_extremes(frames: DataFrame) -> DataFrame:
    """Largest rise and fall of the surface against the first frame, per cell."""
    surface = F.col("b") + F.col("h")
    start = F.min(F.struct("t", surface.alias("s")))["s"]
    return frames.groupBy(*grain(frames, "frame"), "i", "j").agg(
        F.greatest(F.max(surface) - start, F.lit(0.0)).alias("rise"),
        F.greatest(start - F.min(surface), F.lit(0.0)).alias("fall"),
    )


def variable_range(frames: DataFrame, variables: Mapping[str, str]) -> DataFrame:
    """Display range of each variable per run, over all frames.

    `variables` maps a column to its style: plain, zero (starts at 0) or symmetric.
    An empty range is [0, 1]; a frame with no value at all is an error.
    """
    by = grain(frames, "frame")
    kinds = F.create_map(*[F.lit(x) for pair in variables.items() for x in pair])
    per_frame = frames.groupBy(*by, "frame").agg(
        *[a for c in variables for a in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c in variables])
    long = per_frame.select(*by, F.inline(rows))
    empty = F.raise_error(F.concat(F.lit("a frame has no value of "), F.col("variable"))).cast("double")
    long = long.withColumn("lo", F.when(F.col("lo").isNull(), empty).otherwise(F.col("lo")))
    out = long.groupBy(*by, "variable").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    kind, size = kinds[F.col("variable")], F.greatest(F.abs("lo"), F.abs("hi"))
    lo = F.when(kind == "zero", F.lit(0.0)).when(kind == "symmetric", -size).otherwise(F.col("lo"))
    hi = F.when(kind == "symmetric", size).otherwise(F.col("hi"))
    out = out.withColumns({"_lo": lo, "_hi": hi})
    flat = F.col("_hi") <= F.col("_lo")
    return out.select(
        *by, "variable", F.when(flat, F.lit(0.0)).otherwise(F.col("_lo")).alias("low"),
        F.when(flat, F.lit(1.0)).otherwise(F.col("_hi")).alias("high"),
    )


def lake_volume(frames: DataFrame, area: float, masked: str = "masked") -> DataFrame:
    """Water volume of masked cells per frame."""
    return frames.groupBy(*grain(frames)).agg(
        F.min("t").alias("t"), (F.sum(F.when(F.col(masked), F.col("h")).otherwise(F.lit(0.0))) * area).alias("volume")
    )


def volume_balance(history: DataFrame, order: str = "t") -> DataFrame:
    """Change, escaped amount and escaped percent of each volume against its run's first."""
    first = history.groupBy("run").agg(F.min_by("volume", order).alias("_v0"))
    change = F.col("volume") - F.col("_v0")
    escaped = F.greatest(-change, F.lit(0.0))
    percent = F.when(F.col("_v0") > 0, 100.0 * F.col("escaped") / F.col("_v0")).otherwise(F.lit(0.0))
    return (
        history.join(first, "run")
        .withColumns({"change": change, "escaped": escaped})
        .withColumn("escaped_percent", percent)
        .drop("_v0")
    )


def volume_summary(history: DataFrame, order: str = "t", warning: float = 1e-3) -> DataFrame:
    """One row per run: initial, final, extreme volumes, escaped share and a warning above `warning`."""
    v0, v1 = F.min_by("volume", order), F.max_by("volume", order)
    out = history.groupBy("run").agg(
        v0.alias("initial"), v1.alias("final"), F.max(order).alias("final_t"),
        F.min("volume").alias("lowest"), F.max("volume").alias("highest"), F.count("*").alias("samples"),
    )
    escaped = F.greatest(F.col("initial") - F.col("final"), F.lit(0.0))
    share = F.when(F.col("initial") > 0, F.col("escaped") / F.col("initial")).otherwise(F.lit(0.0))
    return out.withColumn("escaped", escaped).withColumn("escaped_percent", 100.0 * share).withColumn("warning", share > warning)


# Depth bands of moving volume: name, lower bound, upper bound (fixed values).
DEPTH_BANDS = (
    ("dry_to_0p05", schema.WET_DEPTH, 0.05),
    ("0p05_to_0p10", 0.05, 0.10),
    ("0p10_to_0p20", 0.10, 0.20),
    ("0p20_to_0p50", 0.20, 0.50),
    ("ge_0p50", 0.50, float("inf")),
)


def mass_history(cells: DataFrame, moving: float, area: Column | float, vel: float = schema.VELOCITY_DEPTH) -> DataFrame:
    """Per frame: signed, positive, negative and moving volume, moving share of the first frame, top speed and level.

    Needs `h` and raw `speed`; give active cells only when patches overlap.
    """
    by = grain(cells, "frame")
    area = area if isinstance(area, Column) else F.lit(float(area))
    h, positive = F.col("h"), F.greatest(F.col("h"), F.lit(0.0))
    reported = F.when(h >= vel, F.col("speed")).otherwise(F.lit(0.0))
    level = F.max("level") if "level" in cells.columns else F.lit(1)
    out = cells.groupBy(*by, "frame").agg(
        F.min("t").alias("t"),
        F.sum(h * area).alias("signed_volume"),
        F.sum(positive * area).alias("positive_volume"),
        F.sum(F.when(reported > moving, positive * area).otherwise(F.lit(0.0))).alias("moving_volume"),
        F.max(reported).alias("max_speed"),
        level.alias("max_level"),
    )
    return _against_first(
        out.withColumn("negative_volume", F.col("signed_volume") - F.col("positive_volume")), by, {"moving_volume": "moving_fraction"}
    )


def _against_first(per_frame: DataFrame, by: list[str], shares: Mapping[str, str]) -> DataFrame:
    first = per_frame.groupBy(*by).agg(F.min_by("positive_volume", "frame").alias("_v0"))
    return per_frame.join(first, by).withColumns(
        {new: F.try_divide(F.col(old), F.col("_v0")) for old, new in shares.items()}
    ).drop("_v0")


def moving_by_depth_band(cells: DataFrame, moving: float, area: Column | float, bands=DEPTH_BANDS) -> DataFrame:
    """Moving volume per frame in half-open depth bands, from raw speed, with shares of the first frame."""
    by = grain(cells, "frame")
    area = area if isinstance(area, Column) else F.lit(float(area))
    h = F.greatest(F.col("h"), F.lit(0.0))
    in_band = lambda lo, hi: (F.col("speed") > moving) & (h >= lo) & (h < hi)
    out = cells.groupBy(*by, "frame").agg(
        F.sum(h * area).alias("positive_volume"),
        *[F.sum(F.when(in_band(lo, hi), h * area).otherwise(F.lit(0.0))).alias(f"moving_{n}") for n, lo, hi in bands],
    )
    return _against_first(out, by, {f"moving_{n}": f"fraction_{n}" for n, _, _ in bands})


def field_metrics(cells: DataFrame, threshold: float, area: float, value: str = "v", rollup: bool = False) -> DataFrame:
    """Peak, area above `threshold` and integral of each field; `rollup` adds subtotals by case and overall."""
    by = grain(cells)
    v = clean(value)
    grouped = cells.rollup(*by) if rollup else cells.groupBy(*by)
    return grouped.agg(
        F.max(v).alias("peak"),
        (F.count_if(v > threshold) * F.lit(float(area))).alias("positive_area"),
        (F.sum(v) * area).alias("integral"),
    )


def pair_metrics(pairs: DataFrame, by: list[str], threshold: float, area: float, left: str = "left", right: str = "right") -> DataFrame:
    """Differences of two fields per pair: MAE, RMSE, support overlap, correlation on the joint support, sizes."""
    pairs = pairs.withColumns({"_l": clean(left), "_r": clean(right)})
    l, r = F.col("_l"), F.col("_r")
    on_l, on_r = l > threshold, r > threshold
    joint = on_l | on_r
    la, ra = F.when(joint, l), F.when(joint, r)
    out = pairs.groupBy(*by).agg(
        F.avg(F.abs(l - r)).alias("mae"),
        F.sqrt(F.avg((l - r) * (l - r))).alias("rmse"),
        F.count_if(on_l & on_r).alias("_both"),
        F.count_if(joint).alias("_any"),
        F.covar_pop(la, ra).alias("_cov"),
        F.stddev_pop(la).alias("_sl"),
        F.stddev_pop(ra).alias("_sr"),
        ((F.max(la) > F.min(la)) & (F.max(ra) > F.min(ra))).alias("_varies"),
        F.max(l).alias("left_peak"),
        F.max(r).alias("right_peak"),
        (F.count_if(on_l) * F.lit(float(area))).alias("left_area"),
        (F.count_if(on_r) * F.lit(float(area))).alias("right_area"),
        (F.sum(l) * area).alias("left_integral"),
        (F.sum(r) * area).alias("right_integral"),
    )
    return out.withColumns(
        {
            "support_iou": F.coalesce(F.try_divide(F.col("_both"), F.col("_any")), F.lit(1.0)),
            "correlation": F.when(F.col("_varies"), F.try_divide(F.col("_cov"), F.col("_sl") * F.col("_sr"))),
        }
    ).drop("_both", "_any", "_cov", "_sl", "_sr", "_varies")


def ensemble_cell_stats(ensemble: DataFrame, candidate: str, value: str = "v") -> DataFrame:
    """Per cell: the median and interquartile range of the other models, and the candidate's difference.

    A group holds one value per model.
    """
    v = clean(value)
    peer = F.when(F.col("model") != candidate, v)
    q = F.percentile(peer, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        ensemble.groupBy("case", "i", "j")
        .agg(q.alias("_q"), F.max(F.when(F.col("model") == candidate, v)).alias("candidate"))
        .select(
            "case", "i", "j", F.col("_q")[1].alias("median"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"),
            (F.col("candidate") - F.col("_q")[1]).alias("difference"),
        )
    )


def peer_statistics(table: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Five-number summary of each metric over the models of a case."""
    long = table.unpivot(["case", "model"], list(metrics), "metric", "value")
    q = F.percentile("value", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    return (
        long.groupBy("case", "metric")
        .agg(F.count("value").alias("n"), F.min("value").alias("min"), q.alias("_q"), F.max("value").alias("max"))
        .select("case", "metric", "n", "min", *[F.col("_q")[k].alias(n) for k, n in enumerate(("q1", "median", "q3"))], "max")
    )


def array_quantile(values: Column, p: float) -> Column:
    """Linearly interpolated quantile of a sorted array column."""
    at = (F.size(values) - 1) * F.lit(p)
    k = F.floor(at).cast("int")
    low = F.try_element_at(values, k + 1)
    high = F.coalesce(F.try_element_at(values, k + 2), low)
    return low + (at - k) * (high - low)


def peak_outliers(table: DataFrame, candidate: str, value: str = "peak", factor: float = 10.0) -> DataFrame:
    """Cases where the candidate's peak exceeds `factor` times the largest other peak."""
    is_c = F.col("model") == candidate
    out = table.groupBy("case").agg(
        F.max(F.when(is_c, F.col(value))).alias("candidate_peak"), F.max(F.when(~is_c, F.col(value))).alias("peer_peak")
    )
    return out.withColumn("ratio", F.try_divide("candidate_peak", "peer_peak")).withColumn(
        "outlier", (F.col("peer_peak") > 0) & (F.col("candidate_peak") > factor * F.col("peer_peak"))
    )


def spread_outliers(table: DataFrame, value: str = "peak", factor: float = 3.0) -> DataFrame:
    """Each model's value against the upper quartile plus `factor` ranges of the case's other models.

    The sorted values of a case (one per model) come as an array; leaving the own
    one out is two slices, so no pair of rows is formed.
    """
    case = Window.partitionBy("case")
    order = case.orderBy(value, "model")
    t = table.where(F.col(value).isNotNull()).withColumns(
        {"_r": F.row_number().over(order), "_all": F.sort_array(F.collect_list(value).over(case))}
    )
    t = t.where(F.size("_all") > 1).withColumn(
        "_rest", F.concat(F.slice("_all", F.lit(1), F.col("_r") - 1), F.slice("_all", F.col("_r") + 1, F.size("_all")))
    )
    q1, q3 = array_quantile(F.col("_rest"), 0.25), array_quantile(F.col("_rest"), 0.75)
    return t.withColumn("limit", q3 + factor * (q3 - q1)).select(
        "case", "model", value, "limit", (F.col(value) > F.col("limit")).alias("outlier")
    )


def coarsen_mean(cells: DataFrame, k: int, value: str = "z") -> DataFrame:
    """Mean of k x k blocks, missing values left out; NULL for a block without any."""
    b = lambda c: F.floor(F.col(c) / k).cast("int").alias(c)
    return cells.groupBy(*grain(cells), b("i"), b("j")).agg(F.avg(value).alias(value))


def coarsen_mask(cells: DataFrame, k: int, threshold: float = 0.5, flag: str = "inside") -> DataFrame:
    """Blocks of which at least `threshold` of the cells are set."""
    b = lambda c: F.floor(F.col(c) / k).cast("int").alias(c)
    return cells.groupBy(*grain(cells), b("i"), b("j")).agg((F.avg(F.col(flag).cast("int")) >= threshold).alias(flag))


def source_rates(faces: DataFrame, damping: float, eps: float = 1e-12) -> DataFrame:
    """Inflow through shoreline faces, summed per target cell and time: Q, Qu, Qv.

    A face (nx, ny inward, length, sampled h, hu, hv) counts where deeper than `eps`
    with inward flux above `eps`; faces without a sample count as zero.
    """
    flux = F.col("hu") * F.col("nx") + F.col("hv") * F.col("ny")
    f = faces.withColumn("_flux", flux).where((F.col("h") > eps) & (F.col("_flux") > eps))
    q = damping * F.col("_flux") * F.col("length")
    return f.groupBy("run", "t", "target_x", "target_y").agg(
        F.sum(q).alias("q"), F.sum(q * (F.col("hu") / F.col("h"))).alias("qu"), F.sum(q * (F.col("hv") / F.col("h"))).alias("qv")
    )


def source_face_counts(faces: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Per run and time: active faces and faces without a sample."""
    flux = F.col("hu") * F.col("nx") + F.col("hv") * F.col("ny")
    lacking = F.col("h").isNull() | F.col("hu").isNull() | F.col("hv").isNull()
    return faces.groupBy("run", "t").agg(
        F.count_if((F.col("h") > eps) & (flux > eps)).alias("active"), F.count_if(lacking).alias("replaced")
    )


def source_ledger(rates: DataFrame, rho: float) -> DataFrame:
    """Injected volume and momentum per run: trapezoids over time of the summed rates."""
    total = rates.groupBy("run", "t").agg(*[F.sum(c).alias(c) for c in ("q", "qu", "qv")])
    w = Window.partitionBy("run").orderBy("t")
    step = F.lead("t").over(w) - F.col("t")
    area = lambda c: (F.col(c) + F.lead(c).over(w)) / 2 * step
    parts = total.withColumns({f"_{c}": area(c) for c in ("q", "qu", "qv")})
    out = parts.groupBy("run").agg(*[F.coalesce(F.sum(f"_{c}"), F.lit(0.0)).alias(n) for c, n in (("q", "volume"), ("qu", "depth_momentum_x"), ("qv", "depth_momentum_y"))])
    return out.withColumns({"momentum_x": rho * F.col("depth_momentum_x"), "momentum_y": rho * F.col("depth_momentum_y")})


def composite_integral(cells: DataFrame, value: str = "h", area: Column | float = 1.0) -> DataFrame:
    """Integral per frame over its finest level, and the area that level covers."""
    area = area if isinstance(area, Column) else F.lit(float(area))
    per_level = cells.groupBy("run", "frame", "level").agg(F.sum(F.col(value) * area).alias("integral"), F.sum(area).alias("covered"))
    top = F.max_by(F.struct("integral", "covered"), "level")
    return per_level.groupBy("run", "frame").agg(F.max("level").alias("level"), top.alias("_t")).select(
        "run", "frame", "level", F.col("_t.integral").alias("integral"), F.col("_t.covered").alias("covered")
    )


def composite_change(per_frame: DataFrame, domain_area: float | None = None) -> DataFrame:
    """First and last integral of each run and their relative change; partial coverage is an error."""
    checked = per_frame
    if domain_area is not None:
        full = close(F.col("covered"), F.lit(float(domain_area)), 1e-12 * max(1.0, domain_area))
        bad = F.raise_error(F.lit("the finest level does not cover the domain")).cast("double")
        checked = per_frame.withColumn("integral", F.when(full, F.col("integral")).otherwise(bad))
    out = checked.groupBy("run").agg(F.min_by("integral", "frame").alias("first"), F.max_by("integral", "frame").alias("last"))
    return out.withColumn("relative_change", F.try_divide(F.col("last") - F.col("first"), F.col("first")))


def infer_geometry(cells: DataFrame) -> DataFrame:
    """Grid geometry of each field from its axes: counts, median spacing, outer edges, regularity."""
    by = grain(cells)
    out = None
    for a, n in (("x", "ncols"), ("y", "nrows")):
        axis = cells.select(*by, a).distinct()
        axis = axis.withColumn("_d", F.col(a) - F.lag(a).over(Window.partitionBy(*by).orderBy(a)))
        d = F.median("_d")
        even = (F.min("_d") > 0) & (F.max("_d") - F.min("_d") <= 1e-8 + 1e-5 * d)
        g = axis.groupBy(*by).agg(
            F.count("*").cast("int").alias(n), d.alias(f"d{a}"), (F.min(a) - d / 2).alias(f"{a}min"),
            (F.max(a) + d / 2).alias(f"{a}max"), F.coalesce(even, F.lit(False)).alias(f"_{a}"),
        )
        out = g if out is None else out.join(g, by)
    return out.withColumn("regular", F.col("_x") & F.col("_y")).drop("_x", "_y")


def flow_envelope(cells: DataFrame, value: str) -> DataFrame:
    """Maximum across the flow per column."""
    return cells.groupBy(*grain(cells), "i").agg(F.max(value).alias(value))


def section_mean_depth(frames: DataFrame, middle: int, wet: float = 1e-10) -> DataFrame:
    """Mean surface of the wet cells of each column minus the centre line's bed."""
    return frames.groupBy(*grain(frames), "i").agg(
        (F.avg(F.when(F.col("h") > wet, F.col("h") + F.col("b"))) - F.max(F.when(F.col("j") == middle, F.col("b")))).alias("depth")
    )


def error_norms(frames: DataFrame, value: str, exact: str) -> DataFrame:
    d = F.abs(F.col(value) - F.col(exact))
    return frames.groupBy(*grain(frames)).agg(F.max(d).alias("linf"), F.avg(d).alias("l1"), F.sqrt(F.avg(d * d)).alias("l2"))


def front_rear(frames: DataFrame, reference: float, moving: float = 1e-5, energy: float = 0.0, rel: float = 1e-3) -> DataFrame:
    """Per frame: furthest moving and resolved x, furthest moving x, edge of undisturbed depth, top resolved speed.

    Needs `u`. A cell is resolved where sqrt(h) |u| exceeds `energy`.
    """
    h, u, x = F.col("h"), F.col("u"), F.col("x")
    resolved = F.sqrt(F.greatest(h, F.lit(0.0))) * F.abs(u) > energy
    return frames.groupBy(*grain(frames)).agg(
        F.min("t").alias("t"),
        F.max(F.when((u > moving) & resolved, x)).alias("front"),
        F.max(F.when(u > moving, x)).alias("front_raw"),
        F.max(F.when(F.abs(h - reference) <= rel * reference, x)).alias("rear"),
        F.coalesce(F.max(F.when(resolved, F.abs(u))), F.lit(0.0)).alias("resolved_speed"),
    )


def peak_audit(maxima: DataFrame, terrain: DataFrame, value: str = "max_s", time: str = "time_s", depth: str = "max_h") -> DataFrame:
    """The cell of the largest value per run with its time, depth, local slope and kinetic head.

    Missing terrain takes the run's mean before slopes are taken.
    """
    by = grain(maxima)
    best = F.min_by(
        F.struct("i", "j", F.col(value).alias("peak"), F.col(time).alias("peak_time"), F.col(depth).alias("peak_depth")),
        F.struct(-F.col(value), "j", "i"),
    )
    top = maxima.where(F.col(value).isNotNull()).groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")
    mean = terrain.groupBy(*by).agg(F.avg("z").alias("_mean"))
    filled = terrain.join(mean, by).withColumn("z", F.coalesce("z", "_mean")).drop("_mean")
    # Only cells within one step of a peak are needed for its slope; edges stay edges of the grid.
    near = filled.join(top.select(*by, F.col("i").alias("_pi"), F.col("j").alias("_pj")), by).where(
        (F.abs(F.col("i") - F.col("_pi")) <= 1) & (F.abs(F.col("j") - F.col("_pj")) <= 1)
    ).drop("_pi", "_pj")
    slopes = slope_terms(near, "z").select(*by, "i", "j", "x", "y", "angle")
    return top.join(slopes, [*by, "i", "j"], "left").withColumn("kinetic_head", F.col("peak") * F.col("peak") / (2.0 * schema.GRAVITY))


def last_frames(frames: DataFrame, n: int) -> DataFrame:
    """Rows of the last `n` frames of each run."""
    by = grain(frames, "frame")
    listing = frames.select(*by, "frame").distinct()
    w = Window.partitionBy(*by).orderBy(F.col("frame").desc())
    keep = listing.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    return frames.join(keep, [*by, "frame"], "left_semi")


def deep_water_check(
    cells: DataFrame, regions: Sequence[tuple[float, float, float, float]], min_depth: float, frames: int = 4,
    tol: float = 0.01, sea_level: float = 0.0,
) -> DataFrame:
    """Mean surface of deep level-1 cells in each region box over the last frames; `unstable` beyond `tol`.

    A box is (west, south, east, north), edges included. Boxes are settings, so they
    become one array and no range join is planned.
    """
    coarse = last_frames(cells.where("level = 1"), frames)
    boxes = F.array(*[F.struct(F.lit(k).alias("region"), *[F.lit(float(v)).alias(n) for n, v in zip(("w", "s", "e", "n"), r)]) for k, r in enumerate(regions)])
    inside = F.filter(boxes, lambda b: F.col("x").between(b["w"], b["e"]) & F.col("y").between(b["s"], b["n"]))
    deep = coarse.where(F.col("eta") - F.col("h") < -min_depth).select("run", "frame", F.col("eta"), F.explode(inside).alias("_b"))
    out = deep.groupBy("run", "frame", F.col("_b.region").alias("region")).agg((F.avg("eta") - sea_level).alias("mean_surface"))
    return out.withColumn("unstable", F.abs("mean_surface") > tol)


def boundary_flux(cells: DataFrame, domain: Geometry, frames: int = 1, max_level: int | None = None) -> DataFrame:
    """Largest |flux| and |current| across each domain edge and overall, over the last frames."""
    c = last_frames(cells, frames)
    if max_level is not None:
        c = c.where(F.col("level") <= max_level)
    west = F.abs(F.col("x") - F.col("dx") / 2 - domain.xmin) < 1e-3 * F.col("dx")
    east = F.abs(F.col("x") + F.col("dx") / 2 - domain.xmax) < 1e-3 * F.col("dx")
    south = F.abs(F.col("y") - F.col("dy") / 2 - domain.ymin) < 1e-3 * F.col("dx")
    north = F.abs(F.col("y") + F.col("dy") / 2 - domain.ymax) < 1e-3 * F.col("dx")
    fx, fy = F.abs(F.col("hu")), F.abs(F.col("hv"))
    cx, cy = (F.try_divide(f, F.col("h")) for f in (fx, fy))
    sides = (("w", west, fx, cx), ("e", east, fx, cx), ("s", south, fy, cy), ("n", north, fy, cy))
    return c.groupBy("run").agg(
        *[F.max(F.when(on, f)).alias(f"flux_{n}") for n, on, f, _ in sides],
        *[F.max(F.when(on, k)).alias(f"current_{n}") for n, on, _, k in sides],
        F.max(fx).alias("flux_x"), F.max(fy).alias("flux_y"), F.max(cx).alias("current_x"), F.max(cy).alias("current_y"),
    )


def amr_census(patches: DataFrame) -> DataFrame:
    """Patches, cells and covered area per frame and level; rows with NULL level are frame totals."""
    return (
        patches.groupBy("run", "frame", "level")
        .agg(
            F.count("*").alias("patches"), F.sum(F.col("mx").cast("long") * F.col("my")).alias("cells"),
            F.sum(F.col("mx") * F.col("dx") * F.col("my") * F.col("dy")).alias("area"),
        )
        .unionByName(
            patches.groupBy("run", "frame").agg(
                F.lit(None).cast("int").alias("level"), F.count("*").alias("patches"),
                F.sum(F.col("mx").cast("long") * F.col("my")).alias("cells"),
                F.sum(F.col("mx") * F.col("dx") * F.col("my") * F.col("dy")).alias("area"),
            )
        )
    )


def timing_by_level(timing: DataFrame, by: list[str] = ["run"], order: str = "t") -> DataFrame:
    """Per level and time: cumulative and per-step cells and cpu, cells per cpu second, and the time's overhead.

    `timing(run, t, level, wall, cpu, cells)` is cumulative; level 0 holds totals.
    """
    from gridspark.functions import shifted

    levels = timing.where("level > 0")
    steps = shifted(levels, [*by, "level"], order, {"_cpu": "cpu", "_cells": "cells", "_wall": "wall"})
    d = lambda c: F.col(c) - F.coalesce(f"_{c}", F.lit(0.0))
    steps = steps.withColumns({f"step_{c}": d(c) for c in ("wall", "cpu", "cells")}).drop("_cpu", "_cells", "_wall")
    per_time = timing.groupBy(*by, order).agg(
        F.sum(F.when(F.col("level") == 0, F.col("cpu")).otherwise(-F.col("cpu"))).alias("overhead_cpu"),
        F.sum(F.when(F.col("level") == 0, F.col("wall")).otherwise(-F.col("wall"))).alias("overhead_wall"),
    )
    return steps.join(per_time, [*by, order], "left").withColumn("cells_per_cpu", F.try_divide("step_cells", "step_cpu"))


def checksums(frames: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums of components per frame, for comparison with stored ones."""
    return frames.groupBy(*grain(frames)).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in columns])


def completeness(frames: DataFrame, end: float, step: float) -> DataFrame:
    """Expected frames that a run lacks or has at another time; empty when every run is complete."""
    count = round(end / step)
    if abs(end / step - count) > 1e-10 * max(1.0, end / step) or count < 2:
        raise ValueError("the end must be a whole number of at least two output steps")
    by = grain(frames, "frame")
    have = frames.groupBy(*by, "frame").agg(F.min("t").alias("t"))
    want = have.select(*by).distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(count)))).withColumn(
        "expected_t", F.col("frame") * F.lit(float(step))
    )
    both = want.join(have, [*by, "frame"], "full_outer")
    issue = (
        F.when(F.col("t").isNull(), "missing").when(F.col("expected_t").isNull(), "unexpected")
        .when(~close(F.col("t"), F.col("expected_t")), "off cadence")
    )
    return both.withColumn("issue", issue).where("issue is not null")


def historical_max_profile(samples: DataFrame, upto: int, by: list[str], value: str) -> DataFrame:
    """Largest sampled value per profile point through frame `upto`, missing values ignored."""
    return samples.where(F.col("frame") <= upto).groupBy(*by).agg(F.max(value).alias(value))


def moment(subfaults: DataFrame) -> DataFrame:
    """Seismic moment and magnitude per fault from rigidity, area (length x width) and slip."""
    mo = F.sum(F.col("mu") * F.col("length") * F.col("width") * F.abs(F.col("slip")))
    return subfaults.groupBy("fault").agg(mo.alias("moment")).withColumn(
        "magnitude", F.when(F.col("moment") > 0, 2.0 / 3.0 * (F.log10(F.when(F.col("moment") > 0, F.col("moment"))) - 9.05))
    )


def rise_fraction(subfaults: DataFrame, times: Sequence[float], kind: str = "quadratic") -> DataFrame:
    """Share of final slip at each time: 0 up to rupture, 1 after the rise, linear or quadratic pieces between.

    Pieces meet at `rise_starting` after rupture, half the rise when NULL or absent.
    Times are settings and become an array.
    """
    out = subfaults.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in times])))
    rise = F.col("rise_time")
    first = F.coalesce("rise_starting", rise / 2) if "rise_starting" in subfaults.columns else rise / 2
    since, second = F.col("t") - F.col("rupture_time"), rise - first
    if kind == "linear":
        up = 0.5 * since / first
        down = 0.5 + 0.5 * (since - first) / second
    elif kind == "quadratic":
        up = since * since / (rise * first)
        down = 1.0 - (since - rise) * (since - rise) / (rise * second)
    else:
        raise ValueError("kind is linear or quadratic")
    share = F.when(since <= 0, F.lit(0.0)).when(since > rise, F.lit(1.0)).when(since <= first, up).otherwise(down)
    return out.withColumn("fraction", share)


def superpose(subfaults: DataFrame, unit_response: DataFrame, times: Sequence[float], tol: float = 1e-12, kind: str = "quadratic") -> DataFrame:
    """Deformation in time: sum over subfaults of slip x unit response x rise share.

    `unit_response(fault, sub, i, j, dz)` is the large side. Shares of all times ride
    along as one array per subfault, so its rows are read and joined once.
    """
    active = subfaults.where(F.abs("slip") >= tol)
    shares = (
        rise_fraction(active, times, kind)
        .groupBy("fault", "sub")
        .agg(F.max("slip").alias("slip"), F.collect_list(F.struct("t", "fraction")).alias("_s"))
    )
    hit = unit_response.join(shares, ["fault", "sub"]).select("fault", "i", "j", "slip", "dz", F.inline("_s"))
    return hit.groupBy("fault", "t", "i", "j").agg(F.sum(F.col("slip") * F.col("dz") * F.col("fraction")).alias("dz"))
