"""Operators along lines, frames and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import running, shifted


def resample_lines(lines: DataFrame, spacing: float | None = None, count: int | None = None) -> DataFrame:
    """Equally spaced samples along polylines (line_id, pts), both ends included.

    Zero-length segments vanish. With `spacing` there are ceil(length / spacing) + 1
    samples. Each segment emits the samples that fall on it; no sample is searched.
    """
    if (spacing is None) == (count is None):
        raise ValueError("give either spacing or count")
    v = lines.select("line_id", F.posexplode("pts").alias("k", "p"))
    w = Window.partitionBy("line_id").orderBy("k")
    x, y = F.col("p.x"), F.col("p.y")
    seg = v.select(
        "line_id", "k", F.lag(x).over(w).alias("x0"), F.lag(y).over(w).alias("y0"), x.alias("x1"), y.alias("y1")
    ).where("x0 is not null and (x0 <> x1 or y0 <> y1)")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    seg = seg.withColumn("_len", F.sqrt(dx * dx + dy * dy)).withColumn("_c1", F.sum("_len").over(w))
    seg = seg.withColumns(
        {
            "_c0": F.coalesce(F.lag("_c1").over(w), F.lit(0.0)),
            "_first": F.row_number().over(w) == 1,
            "_total": F.max("_c1").over(Window.partitionBy("line_id")),
        }
    )
    n = F.lit(count - 1) if count is not None else F.ceil(F.col("_total") / F.lit(float(spacing)))
    seg = seg.withColumn("_n", n.cast("long")).withColumn("_ds", F.col("_total") / F.col("_n"))
    last = F.col("_c1") == F.col("_total")
    low = F.when(F.col("_first"), F.lit(0)).otherwise(F.floor(F.col("_c0") / F.col("_ds")) + 1)
    high = F.when(last, F.col("_n")).otherwise(F.floor(F.col("_c1") / F.col("_ds")))
    hit = seg.withColumns({"_lo": low, "_hi": high}).where("_lo <= _hi").withColumn("k", F.explode(F.sequence("_lo", "_hi")))
    s = F.when(F.col("k") == F.col("_n"), F.col("_total")).otherwise(F.col("k") * F.col("_ds"))
    part = (F.col("distance") - F.col("_c0")) / F.col("_len")
    return hit.withColumn("distance", s).select(
        "line_id", F.col("k").cast("int").alias("k"), "distance",
        (F.col("x0") + part * dx).alias("x"), (F.col("y0") + part * dy).alias("y"),
    )


def frame_intervals(frames: DataFrame, origin: str | Column | None = None) -> DataFrame:
    """Half-open [start_ms, end_ms) of every frame; the last repeats the step before it (at least 1 ms).

    With an `origin` timestamp, `start_ts` and `end_ts` are added.
    """
    listing = frames.groupBy("run", "frame").agg(F.min("t").alias("t"))
    w = Window.partitionBy("run").orderBy("t")
    start = F.round(F.col("t") * 1000).cast("long")
    out = listing.withColumn("start_ms", start)
    step = F.coalesce(F.col("start_ms") - F.lag("start_ms").over(w), F.lit(1))
    out = out.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(w), F.col("start_ms") + F.greatest(step, F.lit(1))))
    late = F.raise_error(F.lit("frame times do not increase")).cast("long")
    out = out.withColumn("end_ms", F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms")).otherwise(late))
    if origin is not None:
        base = F.to_timestamp(F.lit(origin)) if isinstance(origin, str) else origin
        at = lambda c: F.timestamp_millis(F.unix_millis(base) + F.col(c))
        out = out.withColumns({"start_ts": at("start_ms"), "end_ts": at("end_ms")})
    return out


def running_envelope(fronts: DataFrame, value: str = "front", order: str = "t") -> DataFrame:
    """Largest value so far per run, NULL until there is one. One row per frame goes in."""
    w = Window.partitionBy("run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return fronts.withColumn("envelope", F.max(value).over(w))


def sustained_rest(history: DataFrame, fraction: float = 0.01, samples: int = 3, by: list[str] = ["run"], order: str = "t",
                   value: str = "moving_fraction") -> DataFrame:
    """First time after which the moving share stays low to the end, and its confirmation `samples` - 1 later.

    Runs without such a time have NULLs. Rows after the last high sample are
    numbered by a chunked running count, so long histories need no single-task window.
    """
    high = F.coalesce(F.col(value) > fraction, F.lit(True))
    last = history.groupBy(*by).agg(F.max(F.when(high, F.col(order))).alias("_last"))
    quiet = history.join(last, by).where(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).select(*by, order)
    quiet = running(quiet, by, order, {"_n": ("sum", F.lit(1))})
    found = quiet.groupBy(*by).agg(
        F.min(F.when(F.col("_n") == samples, F.col(order))).alias("confirmed"), F.min(order).alias("rest")
    )
    return last.select(*by).join(found, by, "left").withColumn(
        "rest", F.when(F.col("confirmed").isNotNull(), F.col("rest"))
    )


def islands(series: DataFrame, by: list[str], order: str, active: Column, position: str | None = None) -> DataFrame:
    """Contiguous stretches of rows where `active` holds: first, last and extent of `position`, row count."""
    at = position or order
    flagged = series.select(*by, order, *([at] if at != order else []), F.coalesce(active, F.lit(False)).alias("_on"))
    flagged = shifted(flagged, by, order, {"_was": "_on"})
    start = F.when(F.col("_on") & ~F.coalesce("_was", F.lit(False)), 1).otherwise(0)
    numbered = running(flagged, by, order, {"island": ("sum", start)}).where("_on")
    return numbered.groupBy(*by, "island").agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("rows")
    ).withColumn("extent", F.col("last") - F.col("first"))


def longest_island(series: DataFrame, by: list[str], order: str, active: Column, position: str | None = None, pick: str = "longest") -> DataFrame:
    """The stretch of largest extent per series (the further end wins a tie), or the last one."""
    found = islands(series, by, order, active, position)
    key = F.struct("extent", "last") if pick == "longest" else F.struct("last")
    row = F.max_by(F.struct("first", "last", "extent", "rows"), key)
    return found.groupBy(*by).agg(row.alias("_r")).select(*by, "_r.*")


def increasing_report(series: DataFrame, by: list[str], order: list[str], time: str = "t") -> DataFrame:
    """Per series: samples whose time is missing, not finite or not above the previous one."""
    s = shifted(series.select(*by, *dict.fromkeys([*order, time])), by, order, {"_prev": time})
    bad = F.col(time).isNull() | F.isnan(time) | (F.abs(time) == float("inf")) | (F.col(time) <= F.col("_prev"))
    return s.groupBy(*by).agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("violations"))


def assert_increasing(series: DataFrame, by: list[str], order: list[str], time: str = "t") -> DataFrame:
    """The same series, or an error naming one where times do not strictly increase."""
    bad = increasing_report(series, by, order, time).where("violations > 0").first()
    if bad is not None:
        raise ValueError(f"times do not strictly increase in {[bad[k] for k in by]}")
    return series


def backfill(df: DataFrame, columns: list[str], by: list[str], order: list[str]) -> DataFrame:
    """Missing values take the next one of their series."""
    out = running(df, by, order, {f"_f_{c}": ("last", c) for c in columns}, backward=True)
    return out.withColumns({c: F.col(f"_f_{c}") for c in columns}).select(*df.columns)


def rank_candidates(scores: DataFrame, by: list[str] = ["case"]) -> DataFrame:
    """Order candidates by normalised RMSE, then support, then pattern disagreement, then name."""
    order = ["normalized_median_rmse", "normalized_median_support", "normalized_median_pattern", "candidate"]
    keys = [F.col(c).asc_nulls_last() for c in order]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*keys)))


def landfall_offset(tracks: DataFrame, time: str = "ts") -> DataFrame:
    """Reference time of each storm: its last landfall, else its last time."""
    return tracks.groupBy("storm").agg(
        F.coalesce(F.max(F.when(F.col("event") == "L", F.col(time))), F.max(time)).alias("offset")
    )
