"""Storm tracks: best values per time, agency choice, categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.units import convert

# Lower bounds in knots and names of the wind scales (fixed values).
NHC = (
    (float("-inf"), -1, "Tropical Depression"),
    (30.0, 0, "Tropical Storm"),
    (64.0, 1, "Category 1 Hurricane"),
    (83.0, 2, "Category 2 Hurricane"),
    (96.0, 3, "Category 3 Hurricane"),
    (113.0, 4, "Category 4 Hurricane"),
    (135.0, 5, "Category 5 Hurricane"),
)
BEAUFORT = (
    (float("-inf"), 0, "Calm"),
    (1.0, 1, "Light air"),
    (4.0, 2, "Light breeze"),
    (7.0, 3, "Gentle breeze"),
    (11.0, 4, "Moderate breeze"),
    (17.0, 5, "Fresh breeze"),
    (22.0, 6, "Strong breeze"),
    (28.0, 7, "High wind"),
    (34.0, 8, "Gale"),
    (41.0, 9, "Strong gale"),
    (48.0, 10, "Whole gale"),
    (56.0, 11, "Violent storm"),
    (64.0, 12, "Hurricane"),
)


def storm_category(tracks: DataFrame, scale: str = "NHC", wind: str = "vmax", unit: str = "m/s") -> DataFrame:
    """`category` and its name from wind speed."""
    table = {"NHC": NHC, "BEAUFORT": BEAUFORT}[scale.upper()]
    knots = convert(F.col(wind), unit, "knots")
    number: Column = F.lit(None).cast("int")
    name: Column = F.lit(None).cast("string")
    for low, k, text in table:
        here = knots.isNotNull() if low == float("-inf") else knots >= low
        number, name = F.when(here, F.lit(k)).otherwise(number), F.when(here, F.lit(text)).otherwise(name)
    return tracks.withColumns({"category": number, "category_name": name})


def best_track(decks: DataFrame, columns: Sequence[str], radii: Sequence[str] = (), issued: str = "issued", lead_hours: str = "tau_h") -> DataFrame:
    """One row per storm and valid time: each column from the shortest lead with a value; 0 means missing.

    `radii` average to `radius_mean`, missing ones left out. Rows without position are dropped.
    """
    valid = F.col(issued) + F.make_dt_interval(F.lit(0), F.col(lead_hours).cast("int"))
    d = decks.withColumns({"ts": valid} | {c: F.nullif(F.col(c), F.lit(0.0)) for c in (*columns, *radii)})
    at = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(lead_hours), F.col("row_no"), F.col(c).alias("v"))))["v"]
    out = d.groupBy("storm", "ts").agg(*[at(c).alias(c) for c in (*columns, *radii)])
    if radii:
        n = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in radii), F.lit(0))
        total = sum((F.coalesce(c, F.lit(0.0)) for c in radii), F.lit(0.0))
        out = out.withColumn("radius_mean", F.try_divide(total, n)).drop(*radii)
    return out.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())


def agency_coalesce(obs: DataFrame, values: Sequence[str], required: Sequence[str], agencies: Sequence[str]) -> DataFrame:
    """One value per quantity from several agencies.

    `obs` has `official_{v}`, `{agency}_{v}` and `provider`. Required quantities take the
    official value, then the row's provider, then agencies in order, and rows lacking
    one are dropped; the others take agencies in order.
    """
    out = obs
    for v in values:
        have = [a for a in agencies if f"{a}_{v}" in obs.columns]
        ordered = [F.col(f"{a}_{v}") for a in have]
        if v in required:
            named = [F.when(F.col("provider") == a, F.col(f"{a}_{v}")) for a in have]
            ordered = [F.col(f"official_{v}"), F.coalesce(*named), *ordered]
        out = out.withColumn(v, F.coalesce(*ordered))
    for v in required:
        out = out.where(F.col(v).isNotNull())
    keep = [c for c in obs.columns if not any(c.endswith(f"_{v}") for v in values) and c != "provider"]
    return out.select(*keep, *values)
