"""Run, configuration and score tables: comparison, validation, limits, text and time keys."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import grain
from gridspark.functions.keys import finite


def dense_rates(rates: DataFrame) -> DataFrame:
    """Every cell active at any time of a run at all of the run's times, absent rates as zero."""
    cells = rates.select("run", "target_x", "target_y").distinct()
    times = rates.select("run", "t").distinct()
    out = cells.join(times, "run").join(rates, ["run", "t", "target_x", "target_y"], "left")
    return out.select("run", "t", "target_x", "target_y", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("q", "qu", "qv")])


def config_keys_diff(config: DataFrame, required: Sequence[str]) -> DataFrame:
    """Per run, required keys it lacks and keys it has beyond them; `config(run, key, value)`."""
    want = F.array(*[F.lit(k) for k in required])
    missing = config.select("run").distinct().withColumn("key", F.explode(want)).join(config.select("run", "key"), ["run", "key"], "left_anti")
    extra = config.select("run", "key").where(~F.col("key").isin(*required)).distinct()
    return missing.withColumn("issue", F.lit("missing")).unionByName(extra.withColumn("issue", F.lit("extra")))


def config_diff(config: DataFrame, base: Column, other: Column) -> DataFrame:
    """Keys whose values differ between the runs picked by two conditions, missing ones included."""
    a = config.where(base).select("key", F.col("value").alias("base"))
    b = config.where(other).select("key", F.col("value").alias("other"))
    return a.join(b, "key", "full_outer").where(~F.col("base").eqNullSafe(F.col("other")))


def validate_table(table: DataFrame, keys: list[str], values: list[str], per_case: int | None = None,
                   expected: DataFrame | None = None) -> DataFrame:
    """All problems of a score table as (issue, key, n): absent columns, NULL or repeated keys,
    keys against `expected`, rows per case, missing, non-finite or negative values."""
    absent = [c for c in (*keys, *values) if c not in table.columns]
    spark = table.sparkSession
    if absent:
        return spark.createDataFrame([("column absent", c, 1) for c in absent], "issue string, key string, n long")
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    tag = lambda df, issue, k: df.select(F.lit(issue).alias("issue"), k.alias("key"), F.col("n"))
    null_key = None
    for k in keys:
        null_key = F.col(k).isNull() if null_key is None else null_key | F.col(k).isNull()
    parts = [
        tag(table.where(null_key).groupBy(key.alias("_k")).agg(F.count("*").alias("n")), "key is NULL", F.col("_k")),
        tag(table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "key is repeated", key),
    ]
    for v in values:
        bad = table.where(F.coalesce(~finite(F.col(v)) | (F.col(v) < 0), F.lit(True)))
        parts.append(tag(bad.groupBy(*keys).agg(F.count("*").alias("n")), f"{v} is missing, not finite or negative", key))
    if per_case is not None:
        parts.append(tag(table.groupBy(keys[0]).agg(F.count("*").alias("n")).where(F.col("n") != per_case), "row count of case", F.col(keys[0]).cast("string")))
    if expected is not None:
        one = F.lit(1).cast("long").alias("n")
        have, want = table.select(*keys).distinct(), expected.select(*keys).distinct()
        parts.append(tag(want.exceptAll(have).select(*keys, one), "key is absent", key))
        parts.append(tag(have.exceptAll(want).select(*keys, one), "key is not expected", key))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def single_cohort(runs: DataFrame, label: str, identity: list[str]) -> DataFrame:
    """Distinct identities per label and whether there is exactly one."""
    return (
        runs.select(label, *identity).distinct().groupBy(label).agg(F.count("*").alias("identities"))
        .withColumn("single", F.col("identities") == 1)
    )


def first_violation(records: DataFrame, bad: Column, order: str, columns: list[str], by: list[str] = ["run"]) -> DataFrame:
    """The first record of each run, by `order`, for which `bad` holds."""
    hit = F.min(F.when(bad, F.struct(order, *columns)))
    return records.groupBy(*by).agg(hit.alias("_r")).where("_r is not null").select(*by, "_r.*")


def latest_runs(runs: DataFrame, k: int, created: str = "created") -> DataFrame:
    """The `k` newest completed runs, newest first."""
    return runs.where("status = 'completed'").orderBy(F.col(created).desc(), F.col("run")).limit(k)


def top_cells(cells: DataFrame, k: int, value: str) -> DataFrame:
    """The `k` largest cells of each field with their rank; row then column breaks ties.

    Tiles keep their own first `k`, then fields rank those: no window gathers a field.
    """
    by = grain(cells)
    order = [F.col(value).desc(), F.col("j"), F.col("i")]
    part = [F.floor(F.col("i") / 256).alias("_a"), F.floor(F.col("j") / 256).alias("_b")]
    rows = cells.where(F.col(value).isNotNull()).select("*", *part)
    tile = Window.partitionBy(*by, "_a", "_b").orderBy(*order)
    best = rows.withColumn("_n", F.row_number().over(tile)).where(F.col("_n") <= k).drop("_n", "_a", "_b")
    field = Window.partitionBy(*by).orderBy(*order)
    return best.withColumn("rank", F.row_number().over(field)).where(F.col("rank") <= k)


def flatten_config(runs: DataFrame, column: str = "conf") -> DataFrame:
    """Nested JSON objects to (run, key, value) with dotted keys, to any depth; lists stay JSON text."""
    out = runs.select("run", F.lit("").alias("_p"), F.col(column).alias("value"), F.lit(True).alias("_open"))
    while not out.where("_open").isEmpty():
        nested = F.from_json(F.when(F.col("_open"), F.col("value")), "map<string,string>")
        kv = out.select("run", "_p", "value", "_open", F.explode_outer(nested).alias("_k", "_v"))
        key = F.when(F.col("_p") == "", F.col("_k")).otherwise(F.concat_ws(".", "_p", "_k"))
        went = F.col("_k").isNotNull()
        out = kv.select(
            "run", F.when(went, key).otherwise(F.col("_p")).alias("_p"), F.when(went, F.col("_v")).otherwise(F.col("value")).alias("value"),
            (went & F.coalesce(F.startswith("_v", F.lit("{")), F.lit(False))).alias("_open"),
        )
    return out.select("run", F.col("_p").alias("key"), "value")


def merge_config(template: Column, overrides: Column, controlled: Sequence[str], defaults: Mapping[str, str] | None = None) -> Column:
    """Template map with controlled keys replaced by overrides; keys added later fall back to `defaults`.

    Overrides of other keys are ignored and template keys nobody controls are kept.
    """
    allowed = F.map_filter(overrides, lambda k, v: k.isin(*controlled) & v.isNotNull())
    kept = F.map_filter(template, lambda k, v: ~F.map_contains_key(allowed, k))
    merged = F.map_concat(kept, allowed)
    if not defaults:
        return merged
    later = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.map_concat(merged, F.map_filter(later, lambda k, v: ~F.map_contains_key(merged, k)))


def model_from_filename(name: str | Column) -> Column:
    """Model part of an output file name: what follows `_null_`, else the last underscore part."""
    name = F.col(name) if isinstance(name, str) else name
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    after = F.regexp_extract(stem, r"(?i)_null_(.+)$", 1)
    return F.when(after != "", after).otherwise(F.substring_index(stem, "_", -1))


def frame_from_filename(name: str | Column) -> Column:
    """Frame number at the end of a name such as fgout0001.q0012; NULL without one."""
    name = F.col(name) if isinstance(name, str) else name
    digits = F.regexp_extract(name, r"\.[a-z](\d{4,})$", 1)
    return F.when(digits != "", digits.cast("int"))


def civil_time(t: Column, *origins: Column) -> Column:
    """Timestamp of elapsed seconds after the first origin text that parses."""
    base = F.coalesce(*[F.try_to_timestamp(o) for o in origins])
    return F.timestamp_millis(F.unix_millis(base) + F.round(t * 1000).cast("long"))


def fingerprint(files: DataFrame, by: list[str] = ["run"]) -> DataFrame:
    """A digest per run over its files' name, size and modification time, whatever their order or number.

    Digests of the single files are added up, so no list of files is ever gathered.
    """
    one = F.sha2(F.concat_ws(":", "name", "size", "mtime"), 256)
    part = lambda k: F.sum(F.conv(F.substring(one, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")).cast("string")
    return files.groupBy(*by).agg(
        F.count("*").alias("files"),
        F.sha2(F.concat_ws("-", F.count("*").cast("string"), *[part(k) for k in range(4)]), 256).alias("fingerprint"),
    )


def great_circle_samples(pairs: DataFrame, n: int) -> DataFrame:
    """`n` equally spaced points on the great circle of each (pair, lon0, lat0, lon1, lat1), ends included.

    Longitudes run on continuously from the first point.
    """
    r = lambda c: F.radians(F.col(c))
    a = F.pow(F.sin((r("lat1") - r("lat0")) / 2), F.lit(2)) + F.cos(r("lat0")) * F.cos(r("lat1")) * F.pow(F.sin((r("lon1") - r("lon0")) / 2), F.lit(2))
    out = pairs.withColumn("_d", 2 * F.asin(F.sqrt(a))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    f = F.col("k") / F.lit(float(n - 1))
    wa = F.when(F.col("_d") > 0, F.sin((1 - f) * F.col("_d")) / F.sin("_d")).otherwise(1 - f)
    wb = F.when(F.col("_d") > 0, F.sin(f * F.col("_d")) / F.sin("_d")).otherwise(f)
    cart = lambda g: wa * g("0") + wb * g("1")
    x = cart(lambda k: F.cos(r(f"lat{k}")) * F.cos(r(f"lon{k}")))
    y = cart(lambda k: F.cos(r(f"lat{k}")) * F.sin(r(f"lon{k}")))
    z = cart(lambda k: F.sin(r(f"lat{k}")))
    lon = F.degrees(F.atan2(y, x))
    turn = 360.0 * F.floor((lon - F.col("lon0") + 180.0) / 360.0)
    return out.select("pair", F.col("k").cast("int").alias("k"), (lon - turn).alias("lon"), F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"))
