"""Running values and neighbours along an ordered series of any length.

A plain window by series key puts the whole series in one task, however long.
Here a series is cut into chunks that hold about equally many of its rows, wherever
those lie; windows run inside chunks, one small row per chunk carries the state
across, and the two are joined back. Results equal the plain window's.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.keys import col

ROWS_PER_CHUNK = 1_000_000
#: Sampled rows per chunk, and chunks of one series, beyond which they grow.
SAMPLES, CHUNKS = 64, 1024


def splitters(df: DataFrame, by: list[str], order: str, rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """(by, _splits): values of `order` that part a series into runs of about `rows` rows; none or no row for a short series.

    They are quantiles of a sample picked by a hash of the value, so the same data give the same splitters however often and
    in whatever order they are read, and one far value costs one sampled row at most."""
    at = F.col(order).cast("double")
    every = max(1, rows // SAMPLES)
    picked = df.where(F.pmod(F.xxhash64(at), F.lit(every)) == 0).where(at.isNotNull()).select(*by, at.alias("_at"))
    sample = picked.groupBy(*by).agg(F.sort_array(F.collect_list("_at")).alias("_s"))
    per = F.greatest(F.lit(max(1, rows // every)), F.ceil(F.size("_s") / F.lit(CHUNKS)).cast("int"))
    cut = F.when(F.size("_s") > per, F.transform(F.sequence(per, F.size("_s") - 1, per), lambda k: F.get("_s", k)))
    return sample.select(*by, F.array_distinct(F.coalesce(cut, F.array().cast("array<double>"))).alias("_splits"))


def chunked(df: DataFrame, by: list[str], order: str, rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add `_chunk`, growing with `order` within each series: the number of splitters up to the row's value."""
    at, splits = F.col(order).cast("double"), F.col("_splits")
    # Binary search by halving steps.
    steps = F.array(*[F.lit(1 << k) for k in range(CHUNKS.bit_length(), -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda n, k: F.when((n + k <= F.size(splits)) & (F.get(splits, n + k - 1) <= at), n + k).otherwise(n))
    part = F.when((F.size(splits) > 0) & at.isNotNull(), found).otherwise(F.lit(0))
    return df.join(splitters(df, by, order, rows), by, "left").withColumn("_chunk", part.cast("long")).drop("_splits")


def _windows(by: list[str], order: list[str], backward: bool):
    keys = [F.col(o).desc() if backward else F.col(o).asc() for o in order]
    chunk = F.col("_chunk").desc() if backward else F.col("_chunk").asc()
    inner = Window.partitionBy(*by, "_chunk").orderBy(*keys)
    outer = Window.partitionBy(*by).orderBy(chunk)
    return inner, outer


def running(
    df: DataFrame,
    by: list[str],
    order: str | list[str],
    values: Mapping[str, tuple[str, str | Column]],
    backward: bool = False,
    rows: int = ROWS_PER_CHUNK,
    ahead: Mapping[str, tuple[str, str | Column]] | None = None,
) -> DataFrame:
    """Add running values up to and including each row.

    `values` maps a new column to (kind, expression), kind being sum, min, max or
    last (latest non-null). `backward` runs from the end of the series instead; `ahead` are
    values that run the other way, over the same chunks.
    """
    order = [order] if isinstance(order, str) else list(order)
    both = {**{n: (*v, backward) for n, v in values.items()}, **{n: (*v, not backward) for n, v in (ahead or {}).items()}}
    names = list(both)
    base = df.withColumns({f"_v_{n}": col(both[n][1]) for n in names})
    base = chunked(base, by, order[0], rows)
    keys = [F.col(o) for o in order]
    windows = {way: _windows(by, order, way) for way in (False, True)}

    def over(n: str, c: Column, outer: bool) -> Column:
        inner, chunks = windows[both[n][2]]
        w = chunks.rowsBetween(Window.unboundedPreceding, -1) if outer else inner.rowsBetween(Window.unboundedPreceding, 0)
        kind = both[n][0]
        return (F.last(c, ignorenulls=True) if kind == "last" else {"sum": F.sum, "min": F.min, "max": F.max}[kind](c)).over(w)

    def total(n: str) -> Column:
        kind, c = both[n][0], F.col(f"_v_{n}")
        if kind == "last":
            pick = F.min_by if both[n][2] else F.max_by
            at = F.when(c.isNotNull(), F.struct(*keys))
            return pick(c, at)
        return {"sum": F.sum, "min": F.min, "max": F.max}[kind](c)

    def join(n: str) -> Column:
        kind, a, b = both[n][0], F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if kind == "sum":
            return F.when(b.isNull(), a).when(a.isNull(), b).otherwise(a + b)
        if kind == "last":
            return F.coalesce(a, b)
        return F.least(a, b) if kind == "min" else F.greatest(a, b)

    heads = base.groupBy(*by, "_chunk").agg(*[total(n).alias(f"_t_{n}") for n in names])
    heads = heads.select(*by, "_chunk", *[over(n, F.col(f"_t_{n}"), True).alias(f"_c_{n}") for n in names])
    out = base.withColumns({f"_l_{n}": over(n, F.col(f"_v_{n}"), False) for n in names}).join(heads, [*by, "_chunk"], "left")
    return out.withColumns({n: join(n) for n in names}).select(*df.columns, *names)


def shifted(
    df: DataFrame,
    by: list[str],
    order: str | list[str],
    values: Mapping[str, str | Column],
    ahead: bool = False,
    rows: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add the previous row's values (the next row's when `ahead`), NULL at the end."""
    order = [order] if isinstance(order, str) else list(order)
    names = list(values)
    base = df.withColumn("_row", F.struct(*[col(values[n]).alias(n) for n in names]))
    base = chunked(base, by, order[0], rows)
    inner, outer = _windows(by, order, backward=ahead)
    pick = F.min_by if ahead else F.max_by
    edges = base.groupBy(*by, "_chunk").agg(pick("_row", F.struct(*order)).alias("_edge"))
    edges = edges.select(*by, "_chunk", F.lag("_edge").over(outer).alias("_edge"))
    out = base.withColumn("_near", F.lag("_row").over(inner)).join(edges, [*by, "_chunk"], "left")
    near = F.coalesce(F.col("_near"), F.col("_edge"))
    return out.withColumns({n: near[n] for n in names}).select(*df.columns, *names)
