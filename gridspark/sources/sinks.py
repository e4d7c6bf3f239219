"""Sinks: partitioned tables, CSV series and solver text inputs."""

from __future__ import annotations

from collections.abc import Mapping
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import grain
from gridspark.session import checkpoint_dir, configure
from gridspark.sources.ranges import put_text


def _files(df: DataFrame, by: list[str], *order) -> DataFrame:
    """Rows of one output file together and in order."""
    configure(df.sparkSession)
    return df.repartition(*by).sortWithinPartitions(*by, *order)


def _exists(spark, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
        return True
    except Exception as err:
        if "PATH_NOT_FOUND" in str(err) or "UNABLE_TO_INFER_SCHEMA" in str(err):
            return False
        raise


def write_cells(df: DataFrame, path: str, fingerprints: DataFrame | None = None) -> DataFrame | None:
    """Cells as Parquet by run and frame; with `fingerprints(run, fingerprint)` only changed runs are written.

    Then each write is a version of its own, and the manifest that names the valid version of each run is switched
    last: what a changed run no longer has is gone with its old version, and a failed job leaves older versions
    valid and is simply repeated. `published_cells` reads the valid versions. Returns the runs written.
    """
    by = [k for k in ("run", "variable", "frame") if k in df.columns]
    spark = df.sparkSession
    if fingerprints is None:
        # Rows sorted by place let row-group statistics skip most of a frame.
        _files(df, by, "j", "i").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
        return None
    checkpoint_dir(spark)
    known, changed = f"{path}_manifest", fingerprints.select("run", "fingerprint")
    if _exists(spark, known):
        changed = changed.join(spark.read.parquet(known).select("run", "fingerprint"), ["run", "fingerprint"], "left_anti")
    changed = changed.checkpoint()
    if changed.isEmpty():
        return changed
    version = uuid4().hex
    out = _files(df.join(changed.select("run"), "run", "left_semi"), by, "j", "i")
    out.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", *by).parquet(path)
    switched = changed.select("fingerprint", F.lit(version).alias("version"), "run")
    switched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(known)
    return changed


def published_cells(spark, path: str) -> DataFrame:
    """Cells of the valid version of every run that `write_cells` has written with fingerprints."""
    valid = spark.read.parquet(f"{path}_manifest").select("run", "version")
    return spark.read.parquet(path).join(valid, ["run", "version"], "left_semi").drop("version")


def drop_old_versions(spark, path: str) -> list[str]:
    """Delete the versions that no run refers to any more, once nothing reads them; returns their names."""
    valid = {r["version"] for r in spark.read.parquet(f"{path}_manifest").select("version").distinct().collect()}  # a row per write
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system, gone = folder.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("version=") and name.removeprefix("version=") not in valid:
            system.delete(status.getPath(), True)
            gone.append(name.removeprefix("version="))
    return gone


def write_profile(df: DataFrame, path: str, by: str = "line_id") -> None:
    """Profiles as CSV, one folder per line: (frame,) distance, x, y, value, blank for missing."""
    cols = [c for c in ("t", "distance", "x", "y", "value") if c in df.columns]
    order = [c for c in ("t", "distance") if c in df.columns]
    _files(df.select(by, *cols), [by], *order).write.mode("overwrite").partitionBy(by).option("header", True).option(
        "nullValue", ""
    ).csv(path)


def write_series(df: DataFrame, path: str, by: list[str], order: str = "t") -> None:
    """Gauge or volume histories as CSV, sorted by series and time over range partitions."""
    df.repartitionByRange(*by, order).sortWithinPartitions(*by, order).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def raster_lines(cells: DataFrame, grids: DataFrame, nodata: float = -9999.0, dialect: str = "esri") -> DataFrame:
    """Lines (keys, line_no, text) of one raster per field: six header lines, then rows from the north.

    Numbers print with the digits that read back exactly. Cells of the grid that have no row are nodata.
    """
    by = grain(cells)
    value = F.coalesce(F.col("z"), F.lit(nodata)).cast("string")
    g = grids.select("run", "ncols", "nrows", "xmin", "ymin", "cellsize")
    fields = cells.select(*by).distinct().join(g, "run")
    given = cells.groupBy(*by, "j").agg(F.sort_array(F.collect_list(F.struct("i", value.alias("v")))).alias("_c"))
    rows = fields.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nrows") - 1))).join(given, [*by, "j"], "left")
    whole = F.transform(F.array_repeat(F.lit(str(nodata)), F.col("ncols")), lambda v, i: F.coalesce(F.element_at(F.map_from_entries("_c"), i), v))
    texts = F.when(F.size("_c") == F.col("ncols"), F.transform("_c", lambda s: s["v"])).when(F.size("_c") >= 0, whole).otherwise(F.array_repeat(F.lit(str(nodata)), F.col("ncols")))
    rows = rows.withColumn("text", F.array_join(texts, " ")).select(*by, (F.col("nrows") + 5 - F.col("j")).cast("int").alias("line_no"), "text")
    words = (("ncols", "ncols"), ("nrows", "nrows"), ("xllcorner", "xmin"), ("yllcorner", "ymin"), ("cellsize", "cellsize"))
    if dialect == "solver":
        words = (("ncols", "ncols"), ("nrows", "nrows"), ("xlower", "xmin"), ("ylower", "ymin"), ("cellsize", "cellsize"))
    pair = lambda k, v: F.concat_ws(" ", v, F.lit(k)) if dialect == "solver" else F.concat_ws(" ", F.lit(k), v)
    head = F.array(*[pair(k, F.col(c).cast("string")) for k, c in words], pair("nodata_value", F.lit(str(nodata))))
    return fields.select(*by, F.posexplode(head).alias("line_no", "text")).unionByName(rows)


def export_raster_text(cells: DataFrame, grids: DataFrame, path: str, nodata: float = -9999.0, dialect: str = "esri") -> None:
    """Rasters as text, one file per field below `path`/key=value folders."""
    by = grain(cells)
    out = raster_lines(cells, grids, nodata, dialect)
    _files(out, by, "line_no").select(*by, "text").write.mode("overwrite").partitionBy(*by).text(path)


def rate_lines(rates: DataFrame) -> DataFrame:
    """Lines (run, part, cell, line_no, text) of format version 2: header, then each cell's place and its rates by time."""
    num = lambda *c: F.concat_ws(" ", *[F.col(x).cast("string") for x in c])
    times = rates.select("run", "t").distinct().groupBy("run").agg(F.sort_array(F.collect_list("t")).alias("_ts"))
    cells = rates.select("run", "target_x", "target_y").distinct()
    n = cells.groupBy("run").agg(F.count("*").alias("_nc"))
    head = times.join(n, "run").select(
        "run", F.posexplode(F.array(F.lit("2"), F.concat_ws(" ", F.size("_ts").cast("string"), F.col("_nc").cast("string")),
                                   F.array_join(F.transform("_ts", lambda t: t.cast("string")), " "))).alias("_k", "text")
    ).select("run", F.lit(None).cast("double").alias("target_x"), F.lit(None).cast("double").alias("target_y"), F.col("_k").cast("double").alias("at"), "text")
    place = cells.select("run", "target_x", "target_y", F.lit(float("-inf")).alias("at"), num("target_x", "target_y").alias("text"))
    rows = rates.select("run", "target_x", "target_y", F.col("t").alias("at"), num("q", "qu", "qv").alias("text"))
    return head.unionByName(place).unionByName(rows)


def write_rates(rates: DataFrame, path: str) -> None:
    """Dense rates of every run as one text file each, cells in order and times within."""
    out = _files(rate_lines(rates), ["run"], F.col("target_x").asc_nulls_first(), F.col("target_y").asc_nulls_first(), "at")
    out.select("run", "text").write.mode("overwrite").partitionBy("run").text(path)


def track_rows(tracks: DataFrame, offset: DataFrame | None = None, fill: Mapping[str, Column] | None = None, skip: bool = True) -> DataFrame:
    """Rows of the native storm table: repeated times dropped, gaps filled or their rows skipped, seconds from the offset.

    `fill` gives an expression per column; without one a missing value drops the row,
    or is an error when not `skip`. The offset is the storm's own (storm, offset), else
    its first kept time.
    """
    order = Window.partitionBy("storm", "ts").orderBy(*[c for c in ("row_no",) if c in tracks.columns] or ["ts"])
    out = tracks.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    need = ("vmax", "pmin", "rmw", "router")
    out = out.withColumns({c: F.coalesce(F.col(c), e) for c, e in (fill or {}).items()})
    for c in need:
        if skip:
            out = out.where(F.col(c).isNotNull())
        else:
            gap = F.raise_error(F.concat(F.lit(f"no {c} in storm "), F.col("storm").cast("string"))).cast("double")
            out = out.withColumn(c, F.coalesce(F.col(c), gap))
    first = out.groupBy("storm").agg(F.min("ts").alias("_first"))
    out = out.join(first, "storm")
    base = F.col("_first")
    if offset is not None:
        out = out.join(offset.select("storm", F.col("offset").alias("_given")), "storm", "left")
        base = F.coalesce("_given", "_first")
    seconds = (F.unix_millis("ts") - F.unix_millis(base)) / 1000.0
    return out.select("storm", base.alias("offset"), seconds.alias("seconds"), "lon", "lat", "vmax", "rmw", "pmin", "router")


def write_tracks(rows: DataFrame, path: str) -> None:
    """Native storm tables as CSV, one folder per storm in time order."""
    configure(rows.sparkSession)
    removed(rows.sparkSession, path)
    cols = [c for c in rows.columns if c != "storm"]
    put_text(rows.withColumn("text", F.to_csv(F.struct(*cols))), path, "storm", F.lit("track.csv"), "seconds", header=",".join(cols) + "\n")


def removed(spark, path: str) -> None:
    """Delete what is at `path`, which is written anew."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def union_metrics(*tables: DataFrame) -> DataFrame:
    """Metric rows of differing columns in one table, NULL where a table has none."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_metrics(tables: list[DataFrame], path: str) -> None:
    union_metrics(*tables).write.mode("overwrite").option("header", True).csv(path)
