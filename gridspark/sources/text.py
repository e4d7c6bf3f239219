"""Scans of text outputs from many runs, line by line.

Files are read as splittable lines, never as one value per file, so a large raster
is parsed by many tasks. `numbered_lines` restores each line's place in its file
from the split it came from.
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.functions import running
from gridspark.functions.units import convert, kind_of
from gridspark.operators.filters import nodata_to_null

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eEdD][-+]?\d+)?"


def run_of(file: str | Column = "file") -> Column:
    """Run name of a file: the folder it lies in, without a leading `key=`."""
    file = F.col(file) if isinstance(file, str) else file
    folder = F.substring_index(F.substring_index(file, "/", -2), "/", 1)
    return F.regexp_replace(folder, r"^[A-Za-z_]+=", "")


def stem_of(file: Column) -> Column:
    """File name without its ending."""
    return F.regexp_replace(F.substring_index(file, "/", -1), r"\.[^.]*$", "")


def lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(run, file, text) of all matching files below `path`."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return raw.select(run_of(F.col("_metadata.file_path")).alias("run"), F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def numbered_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(run, file, line_no, text), line numbers from zero.

    A split's lines come in file order, so they are ranked within their split (a
    bounded number of bytes) and offset by the lines of the splits before it.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    raw = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"), F.col("value").alias("text"),
    )
    ranked = raw.withColumn("_k", F.row_number().over(Window.partitionBy("file", "_b").orderBy("_m")) - 1)
    before = Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = raw.groupBy("file", "_b").agg(F.count("*").alias("_n")).select("file", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return ranked.join(starts, ["file", "_b"]).select(run_of().alias("run"), "file", (F.col("_o") + F.col("_k")).alias("line_no"), "text")


def tokens(text: str | Column = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.split(F.trim(F.regexp_replace(text, r"[\s,]+", " ")), " ")


def number(c: Column) -> Column:
    """A printed number, D exponents included; NULL for anything else."""
    return F.regexp_replace(c, "[dD]", "E").try_cast("double")


def axis_index(df: DataFrame, by: list[str], axis: str, name: str) -> DataFrame:
    """Add the zero-based rank of `axis` among the distinct values of its group."""
    values = df.select(*by, axis).distinct()
    values = values.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(axis)) - 1).cast("int"))
    return df.join(values, [*by, axis])


# Header words of the raster dialects (fixed values).
HEADER_WORDS = (
    "ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "xlower", "ylower", "cellsize", "nodata_value",
    "north", "south", "east", "west", "rows", "cols",
)


def scan_raster_text(
    spark: SparkSession, path: str, glob: str = "*.asc", nodata: float = -9999.0, by_folder: bool = False
) -> tuple[DataFrame, DataFrame]:
    """ASCII rasters to (cells, grids), the run being the file's name without its ending, or its folder's.

    Headers may read `key value`, `value key` or name compass edges. Coordinates are
    cell centres; rows are turned south to north; a row or file of another size than
    declared is an error.
    """
    words = "|".join(HEADER_WORDS)
    ln = numbered_lines(spark, path, glob).where(F.trim("text") != "")
    if not by_folder:
        ln = ln.withColumn("run", stem_of(F.col("file")))
    key_first = rf"(?i)^\s*({words})\s*:?\s+({NUMBER})\s*$"
    value_first = rf"(?i)^\s*({NUMBER})\s+(?:=:\s*)?({words})\b"
    a, b = F.regexp_extract("text", key_first, 1), F.regexp_extract("text", value_first, 2)
    key = F.lower(F.when(a != "", a).otherwise(b))
    val = F.when(a != "", F.regexp_extract("text", key_first, 2)).otherwise(F.regexp_extract("text", value_first, 1))
    ln = ln.withColumns({"_key": key, "_val": number(val)})
    h = ln.groupBy("file", "run").agg(
        F.count_if(F.col("_key") != "").alias("_head"), F.count_if(F.col("_key") == "").alias("_body"), *[F.max(F.when(F.col("_key") == w, F.col("_val"))).alias(f"_{w}") for w in HEADER_WORDS]
    )
    ncols, nrows = F.coalesce("_ncols", "_cols").cast("int"), F.coalesce("_nrows", "_rows").cast("int")
    short = F.raise_error(F.concat(F.lit("raster shape differs from its header: "), "file")).cast("int")
    h = h.withColumns({"ncols": ncols, "nrows": F.when(F.col("_body") == nrows, nrows).otherwise(short)})
    cell = F.coalesce("_cellsize", (F.col("_east") - F.col("_west")) / F.col("ncols"))
    h = h.withColumn("cellsize", cell)
    edge = lambda corner, low, side, centre: F.coalesce(corner, low, side, F.col(centre) - F.col("cellsize") / 2)
    h = h.withColumns({
        "xmin": edge("_xllcorner", "_xlower", "_west", "_xllcenter"), "ymin": edge("_yllcorner", "_ylower", "_south", "_yllcenter"),
        "nodata": F.coalesce("_nodata_value", F.lit(nodata)),
    })
    h = h.withColumns({"xmax": F.col("xmin") + F.col("ncols") * F.col("cellsize"), "ymax": F.col("ymin") + F.col("nrows") * F.col("cellsize")})
    grids = h.select("run", "xmin", "xmax", "ymin", "ymax", "ncols", "nrows", "cellsize", "nodata")
    body = ln.where("_key = ''").join(h.select("file", "_head", "ncols", "nrows", "xmin", "ymin", "cellsize", "nodata"), "file")
    body = body.withColumns({"_t": tokens(), "j": (F.col("nrows") - 1 - (F.col("line_no") - F.col("_head"))).cast("int")})
    fits = (F.size("_t") == F.col("ncols")) & (F.col("j") >= 0)
    wrong = F.raise_error(F.concat(F.lit("raster shape differs from its header: "), "file")).cast("array<string>")
    body = body.withColumn("_t", F.when(fits, F.col("_t")).otherwise(wrong))
    cells = body.select("run", "j", "xmin", "ymin", "cellsize", "nodata", F.posexplode("_t").alias("i", "_v"))
    cells = cells.select(
        "run", "i", "j", (F.col("xmin") + (F.col("i") + F.lit(0.5)) * F.col("cellsize")).alias("x"),
        (F.col("ymin") + (F.col("j") + F.lit(0.5)) * F.col("cellsize")).alias("y"), number(F.col("_v")).alias("z"), "nodata",
    )
    return nodata_to_null(cells, F.col("nodata")).drop("nodata"), grids


def scan_xyz(spark: SparkSession, path: str, glob: str = "*.xyz", region: tuple[float, float, float, float] | None = None,
             flip: bool = False, gridded: bool = True) -> DataFrame:
    """x y z triples to cells (or points when not gridded); `region` is x0, x1, y0, y1; `flip` negates z."""
    t = tokens()
    p = lines(spark, path, glob).where(F.trim("text") != "").select(
        "run", number(t[0]).alias("x"), number(t[1]).alias("y"), (number(t[2]) * (-1 if flip else 1)).alias("z")
    ).where("x is not null and y is not null")
    if region is not None:
        x0, x1, y0, y1 = region
        p = p.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    if not gridded:
        return p
    return axis_index(axis_index(p, ["run"], "x", "i"), ["run"], "y", "j").select("run", "i", "j", "x", "y", "z")


def scan_maxima(spark: SparkSession, path: str, glob: str = "fgmax*.txt") -> DataFrame:
    """Per-cell maxima of 7, 9 or 15 columns: x y level b h s [extra values] times arrival.

    Values up to -1e90 mean none. Depth and speed that are not positive are zero;
    negative times are missing, zero is a time.
    """
    t = F.transform(tokens(), number)
    m = lines(spark, path, glob).where(F.trim("text") != "").select("run", F.transform(t, lambda v: F.when(v > -1e90, v)).alias("_t"))
    m = m.withColumn("_n", F.size("_t"))
    wrong = F.raise_error(F.concat(F.lit("maxima row has another column count: "), F.col("_n").cast("string"))).cast("int")
    m = m.withColumn("_n", F.when(F.col("_n").isin(7, 9, 15), F.col("_n")).otherwise(wrong))
    at = lambda k: F.col("_t")[k]
    positive = lambda c: F.when(c > 0, c).otherwise(F.lit(0.0))
    time = lambda c: F.when(c >= 0, c)
    by_width = lambda c7, c9, c15: F.when(F.col("_n") == 7, c7).when(F.col("_n") == 9, c9).otherwise(c15)
    none = F.lit(None).cast("double")
    # Column places: 7 has h and its time, 9 adds s, 15 adds hs, hss, hmin and their times.
    out = m.select(
        "run", at(0).alias("x"), at(1).alias("y"), at(2).cast("int").alias("level"), at(3).alias("b"), positive(at(4)).alias("max_h"),
        by_width(none, positive(at(5)), positive(at(5))).alias("max_s"),
        by_width(none, none, at(6)).alias("max_hs"), by_width(none, none, at(7)).alias("max_hss"), by_width(none, none, -at(8)).alias("min_h"),
        by_width(time(at(5)), time(at(6)), time(at(9))).alias("time_h"), by_width(none, time(at(7)), time(at(10))).alias("time_s"),
        by_width(time(at(6)), time(at(8)), time(at(14))).alias("arrival"),
    )
    return axis_index(axis_index(out, ["run"], "x", "i"), ["run"], "y", "j")


def scan_gauges(spark: SparkSession, path: str, glob: str = "gauge*.txt") -> DataFrame:
    """Gauge series of all gauge files below `path`, see `parse_gauges`; a header that names a binary form has its samples
    in a file of the same name ending in `.bin`, which `ranges` reads piece by piece."""
    from gridspark.sources import gauges

    ln = lines(spark, path, glob)
    return parse_gauges(ln).unionByName(gauges.binary_series(spark, path, glob, gauge_headers(ln)))


def gauge_headers(ln: DataFrame) -> DataFrame:
    """(run, file, gauge, x, y, kind, num_eqn, format) of each gauge file; a header's id must match its file's name."""
    named = F.regexp_extract("file", r"gauge0*(\d+)[^/]*$", 1).cast("long")
    head = ln.where(F.startswith("text", F.lit("#"))).withColumn("_t", tokens())
    first = F.contains("text", F.lit("gauge_id"))
    place = F.regexp_extract_all("text", F.lit(r"\(([^)]*)\)"), F.lit(1))
    form = F.regexp_extract(F.lower("text"), r"file format\W*(binary32|binary64|binary)", 1)
    h = head.groupBy("run", "file").agg(
        F.max(F.when(first, F.col("_t")[2].cast("long"))).alias("gauge"),
        F.max(F.when(first, tokens(F.try_element_at(place, F.lit(1))))).alias("_xy"),
        F.max(F.contains(F.lower("text"), F.lit("lagrangian"))).alias("_lag"),
        F.max(F.when(first, F.regexp_extract("text", r"num_eqn\s*=\s*(\d+)", 1).try_cast("int"))).alias("num_eqn"), F.max(form).alias("format"),
    )
    wrong = F.raise_error(F.concat(F.lit("gauge id differs from its file name: "), "file")).cast("long")
    return h.select(
        "run", "file", F.when(F.col("gauge") == named, F.col("gauge")).otherwise(wrong).alias("gauge"), number(F.col("_xy")[0]).alias("x"),
        number(F.try_element_at("_xy", F.lit(2))).alias("y"), F.when(F.col("_lag"), "lagrangian").otherwise("stationary").alias("kind"), "num_eqn",
        F.when(F.col("format") != "", F.col("format")).otherwise("ascii").alias("format"),
    )


def parse_gauges(ln: DataFrame) -> DataFrame:
    """(run, file, text) lines to (run, gauge, x, y, kind, level, t, q)."""
    rows = ln.where(~F.startswith("text", F.lit("#")) & (F.trim("text") != "")).select("run", "file", F.transform(tokens(), number).alias("_t"))
    return rows.join(gauge_headers(ln), ["run", "file"]).select(
        "run", "gauge", "x", "y", "kind", F.col("_t")[0].cast("int").alias("level"), F.col("_t")[1].alias("t"), F.slice("_t", F.lit(3), F.size("_t") - 2).alias("q"),
    )


def scan_timing(spark: SparkSession, path: str, glob: str = "timing*.csv") -> DataFrame:
    """Wide timing tables to (run, t, level, wall, cpu, cells); level 0 holds the totals."""
    n = F.transform(tokens(), number)
    t = lines(spark, path, glob).select("run", n.alias("_t")).where(F.col("_t")[0].isNotNull())
    last = (F.size("_t") / 3).cast("int") - 1
    per = F.transform(
        F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(k.alias("level"), F.col("_t")[3 * k].alias("wall"), F.col("_t")[3 * k + 1].alias("cpu"), F.col("_t")[3 * k + 2].alias("cells")),
    )
    total = F.array(F.struct(F.lit(0).alias("level"), F.col("_t")[1].alias("wall"), F.col("_t")[2].alias("cpu"), F.lit(0.0).alias("cells")))
    return t.select("run", F.col("_t")[0].alias("t"), F.inline(F.concat(total, per)))


def scan_met(spark: SparkSession, path: str, glob: str = "*.win") -> DataFrame:
    """Repeated header and matrix blocks to (run, ts, i, j, lon, lat, value).

    A block's number is the running count of headers; values follow in rows from the
    south-west corner, wrapped over any number of lines.
    """
    ln = numbered_lines(spark, path, glob).where(~F.startswith("text", F.lit("Oceanweather")) & (F.trim("text") != ""))
    head = F.contains("text", F.lit("DT="))
    ln = ln.withColumns({"_h": head.cast("int"), "_n": F.when(head, F.lit(0)).otherwise(F.size(tokens()))})
    ln = running(ln, ["run", "file"], "line_no", {"_block": ("sum", "_h"), "_end": ("sum", "_n")})
    part = lambda name: F.regexp_replace(F.regexp_extract("text", rf"{name}=\s*(-?\s*{NUMBER})", 1), r"\s", "")
    h = ln.where("_h = 1").select(
        "file", "_block", F.col("_end").alias("_base"), part("iLong").cast("int").alias("_nx"), part("iLat").cast("int").alias("_ny"),
        part("DX").cast("double").alias("_dx"), part("DY").cast("double").alias("_dy"), part("SWLat").cast("double").alias("_lat"),
        part("SWLon").cast("double").alias("_lon"), F.to_timestamp(F.substring(part("DT"), 1, 12), "yyyyMMddHHmm").alias("ts"),
    )
    v = ln.where("_h = 0").join(h, ["file", "_block"]).select(
        "run", "ts", "_nx", "_dx", "_dy", "_lat", "_lon", (F.col("_end") - F.col("_n") - F.col("_base")).alias("_k"), F.posexplode(tokens()).alias("_p", "_v")
    )
    k = F.col("_k") + F.col("_p")
    v = v.withColumns({"i": (k % F.col("_nx")).cast("int"), "j": F.floor(k / F.col("_nx")).cast("int")})
    return v.select(
        "run", "ts", "i", "j", (F.col("_lon") + F.col("i") * F.col("_dx")).alias("lon"), (F.col("_lat") + F.col("j") * F.col("_dy")).alias("lat"),
        number(F.col("_v")).alias("value"),
    )


def scan_deform(spark: SparkSession, path: str, glob: str = "*.tt3", kind: int = 3) -> DataFrame:
    """Deformation in time to (run, t, i, j, x, y, dz).

    Kind 1 lists t x y dz; 2 and 3 have nine header lines, then one value, or one row of
    values, per line, north first.
    """
    if kind == 1:
        n = F.transform(tokens(), number)
        p = lines(spark, path, glob).where(F.trim("text") != "").select("run", n.alias("_t")).select(
            "run", *[F.col("_t")[k].alias(c) for k, c in enumerate(("t", "x", "y", "dz"))]
        )
        return axis_index(axis_index(p, ["run"], "x", "i"), ["run"], "y", "j").select("run", "t", "i", "j", "x", "y", "dz")
    ln = numbered_lines(spark, path, glob)
    names = ("mx", "my", "mt", "x0", "y0", "t0", "dx", "dy", "dt")
    h = ln.where("line_no < 9").groupBy("file").agg(
        *[F.max(F.when(F.col("line_no") == k, number(tokens()[0]))).alias(f"_{c}") for k, c in enumerate(names)]
    )
    body = ln.where("line_no >= 9").join(h, "file").withColumn("_k", F.col("line_no") - 9)
    if kind == 2:
        body = body.withColumns({"i": F.col("_k") % F.col("_mx"), "_k": F.floor(F.col("_k") / F.col("_mx")), "_v": tokens()[0]})
    else:
        body = body.select("*", F.posexplode(tokens()).alias("i", "_v"))
    i, j = F.col("i").cast("int"), (F.col("_my") - 1 - F.col("_k") % F.col("_my")).cast("int")
    return body.select(
        "run", (F.col("_t0") + F.floor(F.col("_k") / F.col("_my")) * F.col("_dt")).alias("t"), i.alias("i"), j.alias("j"),
        (F.col("_x0") + i * F.col("_dx")).alias("x"), (F.col("_y0") + j * F.col("_dy")).alias("y"), number(F.col("_v")).alias("dz"),
    ).where("dz is not null")


# Column names of subfault tables, other spellings, and standard units (fixed values).
SUBFAULT_COLUMNS = (
    "longitude", "latitude", "length", "width", "depth", "strike", "dip", "rake", "slip", "mu", "rupture_time", "rise_time", "rise_time_ending", "rise_time_starting",
)
SUBFAULT_ALIASES = {"rigidity": "mu", "rupture time": "rupture_time", "rise time": "rise_time"}
STANDARD_UNITS = {"length": "m", "pressure": "Pa", "speed": "m/s", "moment": "N-m"}


#: Different headings of one scan, at most: each is a reading of its own.
HEADINGS = 64


def scan_subfaults(spark: SparkSession, path: str, glob: str = "*.csv", units: dict[str, str] | None = None) -> DataFrame:
    """Subfault tables, each read by its own heading, so columns may stand in any order and be missing (NULL); units in a heading's
    parentheses, or in `units`, go to standard ones."""
    ln = numbered_lines(spark, path, glob).where(F.trim("text") != "")
    first = ln.groupBy("file").agg(F.min_by("text", "line_no").alias("_heading"), F.min("line_no").alias("_first"))
    found = sorted(r["_heading"] for r in first.select("_heading").distinct().limit(HEADINGS + 1).collect())
    if len(found) > HEADINGS:
        raise ValueError(f"more than {HEADINGS} different headings below {path}")
    rows, parts = ln.join(first, "file").where("line_no > _first"), []
    for heading in found:
        names = next(csv.reader([heading]), [])
        cells = F.from_csv("text", ", ".join(f"c{k} string" for k in range(len(names))))
        cols = {}
        for k, name in enumerate(names):
            head, _, rest = name.partition("(")
            plain = head.strip().lower()
            plain = SUBFAULT_ALIASES.get(plain, plain)
            if plain not in SUBFAULT_COLUMNS:
                continue
            value = F.col(f"_c.c{k}").try_cast("double")
            unit = rest.rstrip(") ").strip() or (units or {}).get(plain)
            if unit:
                value = convert(value, unit, STANDARD_UNITS[kind_of(unit)])
            cols[plain] = value
        one = rows.where(F.col("_heading") == heading).withColumn("_c", cells)
        parts.append((one, cols))
    given = [c for c in dict.fromkeys(c for _, cols in parts for c in cols)]
    none = F.lit(None).cast("double")
    out = [one.select(F.col("run").alias("fault"), *[cols.get(c, none).alias(c) for c in given]) for one, cols in parts]
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "fault string")


RUN_SCHEMA = "status string, crs string, rho double, origin string, created string, updated string"


def scan_runs(spark: SparkSession, path: str, glob: str = "run.json") -> DataFrame:
    """Run markers and settings of all marker files, one small JSON object each; see `parse_runs`."""
    from gridspark.sources.ranges import files_below

    return parse_runs(files_below(spark, path, glob, content=True).select(run_of().alias("run"), "value"))


def parse_runs(raw: DataFrame) -> DataFrame:
    """(run, value) JSON to (run, status, crs, rho, origin, created, updated, conf), completed and readable runs only."""
    r = raw.select("run", F.from_json("value", RUN_SCHEMA).alias("_r"), F.get_json_object("value", "$.configuration").alias("conf"))
    return r.select("run", "_r.*", "conf").where("status = 'completed'")


def scan_polygons(spark: SparkSession, path: str, glob: str = "*.geojson") -> DataFrame:
    """Polygon layers, one file each; see `parse_polygons`."""
    from gridspark.sources.ranges import files_below

    return parse_polygons(files_below(spark, path, glob, content=True).select(stem_of(F.col("file")).alias("run"), "value"))


def parse_polygons(raw: DataFrame) -> DataFrame:
    """(run, value) feature collections to rings (run, pid, exterior, holes).

    Empty geometries are skipped and rings of fewer than three vertices dropped.
    """
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    f = raw.select("run", F.posexplode(F.from_json("value", schema)["features"]).alias("_f", "f"))
    rings = "array<array<array<double>>>"
    many = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", f"array<{rings}>")).when(
        F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", rings))
    )
    p = f.select("run", "_f", F.posexplode(many).alias("_p", "rings")).where(F.size("rings") > 0)
    point = lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))
    p = p.withColumn("rings", F.transform("rings", lambda r: F.transform(r, point))).where(F.size(F.col("rings")[0]) >= 3)
    holes = F.filter(F.slice("rings", F.lit(2), F.size("rings")), lambda r: F.size(r) >= 3)
    # Numbered by feature and part, which keeps ids free of any global order.
    pid = F.col("_f").cast("long") * F.lit(1 << 20) + F.col("_p")
    return p.select("run", pid.alias("pid"), F.col("rings")[0].alias("exterior"), holes.alias("holes"))


def scan_rates(spark: SparkSession, path: str, glob: str = "*.inflow") -> DataFrame:
    """Point rates, format version 2: counts, times, then per cell its place and one line per time."""
    ln = numbered_lines(spark, path, glob).withColumn("_t", F.transform(tokens(), number))
    h = ln.groupBy("file").agg(
        F.max(F.when(F.col("line_no") == 0, F.col("_t")[0])).alias("_version"),
        F.max(F.when(F.col("line_no") == 1, F.col("_t")[0].cast("int"))).alias("_nt"),
        F.max(F.when(F.col("line_no") == 2, F.col("_t"))).alias("_times"),
    )
    other = F.raise_error(F.concat(F.lit("not a version 2 rate file: "), "file")).cast("int")
    h = h.withColumn("_nt", F.when(F.col("_version") == 2, F.col("_nt")).otherwise(other))
    body = ln.where("line_no >= 3").join(h, "file").withColumn("_k", F.col("line_no") - 3)
    body = body.withColumns({"_cell": F.floor(F.col("_k") / (F.col("_nt") + 1)), "_at": (F.col("_k") % (F.col("_nt") + 1)).cast("int")})
    place = body.where("_at = 0").select("file", "_cell", F.col("_t")[0].alias("target_x"), F.col("_t")[1].alias("target_y"))
    return body.where("_at > 0").join(place, ["file", "_cell"]).select(
        "run", F.element_at("_times", F.col("_at")).alias("t"), "target_x", "target_y", *[F.col("_t")[k].alias(c) for k, c in enumerate(("q", "qu", "qv"))]
    )
