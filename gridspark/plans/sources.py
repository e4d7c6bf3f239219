"""Queries that write derived tables in the outputs' formats and scan them back."""

from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridspark.operators import aggs as A
from gridspark.operators import tables as B
from gridspark.operators.windows import landfall_offset
from gridspark.plans.aggs import RATES_SQL, TIMING_SQL, face_samples, timing
from gridspark.plans.registry import query
from gridspark.session import checkpoint_dir
from gridspark.sources import decks, frames, sinks, text
from gridspark.sources.ranges import put, put_files, put_text


def scratch(fx, name: str) -> str:
    """A fresh folder next to the shared checkpoints."""
    return f"{checkpoint_dir(fx.spark)}/{name}-{uuid4().hex}"


def put_lines(df, path: str, *order: str):
    """Write (run, ..., text) as one text file per run with its lines in order."""
    put_text(df, path, "run", F.lit("run.txt"), *order)
    return path


def put_markers(df, path: str):
    """Write (run, text) as one small file per run. Each task writes its files in place: a committer would move them one by one."""

    def write(parts):
        for pdf in parts:
            for run, content in zip(pdf["run"], pdf["text"]):
                put(f"{path}/run={run}/run.txt", (content + "\n").encode())
            yield pdf[["run"]].head(0)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(tasks, "run").mapInPandas(write, "run string").count()
    return path


def gauge_file(end: str):
    """Name of a gauge's file: the id with five digits, or all of a longer one."""
    k = F.col("gauge").cast("string")
    return F.concat(F.lit("gauge"), F.lpad(k, F.greatest(F.length(k), F.lit(5)), F.lit("0")), F.lit(end))


num = lambda *c: F.concat_ws(" ", *[(F.col(x) if isinstance(x, str) else x).cast("string") for x in c])


@query("scan_raster_text", "select * from cells")
def _(fx):
    path = scratch(fx, "raster")
    # Each raster is as high as its run's rows reach.
    own = fx.grids.drop("nrows").join(fx.cells.groupBy("run").agg((F.max("j") + 1).alias("nrows")), "run")
    sinks.export_raster_text(fx.cells, own, path)
    return text.scan_raster_text(fx.spark, path, "*.txt", by_folder=True)[0]


@query("scan_raster_grids", "select distinct run, 0e0 as xmin, 64e0 as xmax, 0e0 as ymin, 50e0 as ymax, 64 as ncols, 50 as nrows, 1e0 as cellsize, -1e0 as nodata from cells")
def _(fx):
    path = scratch(fx, "raster")
    sinks.export_raster_text(fx.cells, fx.grids, path, nodata=-1.0, dialect="solver")
    return text.scan_raster_text(fx.spark, path, "*.txt", by_folder=True)[1]


@query("scan_xyz", "select run, cast(i-10 as int) as i, cast(j-5 as int) as j, x, y, -z as z from cells where i between 10 and 40 and j between 5 and 30 and not (i*7+j*13)%97=1000")
def _(fx):
    c = fx.cells.withColumn("z", F.coalesce("z", F.lit("nan").cast("double")))
    path = put_lines(c.select("run", "i", "j", num("x", "y", "z").alias("text")), scratch(fx, "xyz"), "j", "i")
    out = text.scan_xyz(fx.spark, path, "*.txt", region=(10.0, 41.0, 5.0, 31.0), flip=True)
    return out.withColumn("z", F.when(~F.isnan("z"), F.col("z")))


@query("scan_maxima", """with m as (select run, i, j, max(h) as max_h, max(hv) as hv, case when max(hu)>0.125 then max(t) end as t1 from frames group by all)
select run, i, j, i+0.5e0 as x, j+0.5e0 as y, 1 as level, 0e0 as b, max_h, greatest(hv,0) as max_s, null::double as max_hs, null::double as max_hss, null::double as min_h, t1 as time_h, 0e0 as time_s, t1 as arrival from m""")
def _(fx):
    m = fx.frames.groupBy("run", "i", "j").agg(F.max("h").alias("h"), F.max("hv").alias("s"), F.when(F.max("hu") > 0.125, F.max("t")).alias("t1"))
    none = F.coalesce("t1", F.lit(-1e99))
    row = num(F.col("i") + F.lit(0.5), F.col("j") + F.lit(0.5), F.lit(1), F.lit(0.0), "h", "s", none, F.lit(0.0), none)
    path = put_lines(m.select("run", "i", "j", row.alias("text")), scratch(fx, "maxima"), "i", "j")
    return text.scan_maxima(fx.spark, path, "*.txt")


@query("scan_gauges", "select concat('g', gauge%4) as run, gauge, gauge*1e0 as x, gauge*0.5e0 as y, 'stationary' as kind, 1 as level, t, q1, q1*2 as q2 from series")
def _(fx):
    name = F.concat(F.lit("out/"), gauge_file(".txt"))
    run = F.concat(F.lit("g"), (F.col("gauge") % 4).cast("string"))
    head = fx.series.select("gauge").distinct().select(
        run.alias("run"), name.alias("file"),
        F.concat(F.lit("# gauge_id= "), F.col("gauge").cast("string"), F.lit(" location=( "), num(F.col("gauge") * 1.0, F.col("gauge") * 0.5), F.lit(" ) num_eqn= 2")).alias("text"),
    )
    rows = fx.series.select(run.alias("run"), name.alias("file"), num(F.lit(1), "t", "q1", F.col("q1") * 2).alias("text"))
    return text.parse_gauges(head.unionByName(rows)).select("run", "gauge", "x", "y", "kind", "level", "t", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"))


@query("scan_timing", "with " + TIMING_SQL + """, w as (select cast(run%5 as varchar) as run, run*100000+t as t, sum(wall) filter (level=0) as w0, sum(cpu) filter (level=0) as c0, coalesce(sum(wall) filter (level=1),0) as w1, coalesce(sum(cpu) filter (level=1),0) as c1, coalesce(sum(cells) filter (level=1),0) as n1, coalesce(sum(wall) filter (level=2),0) as w2, coalesce(sum(cpu) filter (level=2),0) as c2, coalesce(sum(cells) filter (level=2),0) as n2 from al group by all)
select run, t, 0 as level, w0 as wall, c0 as cpu, 0e0 as cells from w union all select run, t, 1, w1, c1, n1 from w union all select run, t, 2, w2, c2, n2 from w""")
def _(fx):
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    w = timing(fx).groupBy("run", "t").agg(*[
        zero(F.sum(F.when(F.col("level") == k, F.col(c)))).alias(f"{c}{k}") for k in (0, 1, 2) for c in ("wall", "cpu", "cells")
    ])
    row = num(F.col("run") * 100000 + F.col("t"), "wall0", "cpu0", "wall1", "cpu1", "cells1", "wall2", "cpu2", "cells2")
    out = w.select((F.col("run") % 5).cast("string").alias("run"), F.col("t").alias("at"), F.regexp_replace(row, " ", ",").alias("text"))
    return text.scan_timing(fx.spark, put_lines(out, scratch(fx, "timing"), "at"), "*.txt")


@query("scan_met", "select run, timestamp '2024-01-01'+to_hours(frame) as ts, i, j, -82e0+i*0.25 as lon, 22e0+j*0.25 as lat, hu as value from frames")
def _(fx):
    row = F.transform(F.sort_array(F.collect_list(F.struct("i", "hu"))), lambda s: s["hu"].cast("string"))
    rows = fx.frames.groupBy("run", "frame", "j").agg(F.array_join(row, " ").alias("text"))
    head = fx.frames.select("run", "frame").distinct().select(
        "run", "frame", F.lit(-1).alias("j"),
        F.concat(F.lit("iLat=  50iLong=  64DX=0.2500DY=0.2500SWLat=22.00000SWLon=-82.0000DT=20240101"), F.lpad(F.col("frame").cast("string"), 2, "0"), F.lit("00")).alias("text"),
    )
    path = put_lines(head.unionByName(rows), scratch(fx, "met"), "frame", "j")
    return text.scan_met(fx.spark, path, "*.txt").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _deform_head(fx):
    v = ("64 mx", "50 my", None, "0.5 xlower", "0.5 ylower", "0.0 t0", "1.0 dx", "1.0 dy", "10.0 dt")
    mt = F.concat((F.max("frame") + 1).cast("string"), F.lit(" mt"))
    return fx.frames.groupBy("run").agg(F.array(*[F.lit(x) if x else mt for x in v]).alias("v")).select("run", F.posexplode("v").alias("k", "text")).select(
        "run", F.lit(-1).alias("frame"), F.col("k").alias("r"), F.lit(0).alias("i"), "text"
    )


def _deform_values(fx):
    """(run, frame, r, i, text), rows from the north; headers tell whole frames, so cells that have no row are written as nan."""
    every = lambda c, last: F.explode(F.sequence(F.lit(0), last)).alias(c)
    places = fx.frames.groupBy("run").agg(F.max("frame").alias("last")).select("run", every("frame", F.col("last")))
    places = places.select("*", every("r", F.lit(49))).select("*", every("i", F.lit(63)))
    there = fx.frames.select("run", "frame", (49 - F.col("j")).alias("r"), "i", F.col("hu").cast("string").alias("text"))
    return places.join(there, ["run", "frame", "r", "i"], "left").withColumn("text", F.coalesce("text", F.lit("nan")))


@query("scan_deform", "select run, t, i, j, x, y, hu as dz from frames")
def _(fx):
    row = F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda s: s["text"])
    rows = _deform_values(fx).groupBy("run", "frame", "r").agg(F.lit(0).alias("i"), F.array_join(row, " ").alias("text"))
    path = put_lines(_deform_head(fx).unionByName(rows), scratch(fx, "deform"), "frame", "r")
    return text.scan_deform(fx.spark, path, "*.txt", kind=3).where("not isnan(dz)")


@query("scan_deform_single_column", "select run, t, i, j, x, y, hu as dz from frames")
def _(fx):
    path = put_lines(_deform_head(fx).unionByName(_deform_values(fx)), scratch(fx, "deform"), "frame", "r", "i")
    return text.scan_deform(fx.spark, path, "*.txt", kind=2).where("not isnan(dz)")


@query("scan_deform_points", "select run, t, i, j, x, y, hu as dz from frames")
def _(fx):
    rows = fx.frames.select("run", "frame", "i", "j", num("t", "x", "y", "hu").alias("text"))
    return text.scan_deform(fx.spark, put_lines(rows, scratch(fx, "deform"), "frame", "j", "i"), "*.txt", kind=1)


@query("scan_subfaults", "select s_suppkey*1e0 as longitude, s_nationkey*1e0 as latitude, s_suppkey%50*1000e0 as depth, s_acctbal as slip, 4e10 as mu from supplier")
def _(fx):
    s = fx.table("supplier")
    path = scratch(fx, "faults")
    s.select(
        F.col("s_suppkey").alias("Longitude"), F.col("s_nationkey").alias("Latitude"), (F.col("s_suppkey") % 50).alias("Depth(km)"),
        F.col("s_acctbal").alias("Slip"), F.lit(40.0).alias("Rigidity (GPa)"), F.col("s_name").alias("UnitSrc"),
    ).write.option("header", True).csv(f"{path}/fault1")
    return text.scan_subfaults(fx.spark, path).drop("fault")


@query("scan_runs", "select cast(p_partkey as varchar) as run, 'completed' as status, p_brand as crs, p_size*10e0 as rho from part where p_size%4=0")
def _(fx):
    s = F.col("p_size")
    good = F.to_json(F.struct(F.when(s % 4 == 0, "completed").otherwise("failed").alias("status"), F.col("p_brand").alias("crs"), (s * 10.0).alias("rho")))
    raw = fx.table("part").select(F.col("p_partkey").cast("string").alias("run"), F.when(s % 4 == 1, "{broken").when(s % 4 == 2, "[]").otherwise(good).alias("text"))
    path = put_markers(raw, scratch(fx, "runs"))
    return text.scan_runs(fx.spark, path, "*.txt").select("run", "status", "crs", "rho")


@query("scan_polygons", """select cast(s_suppkey as varchar) as run, cast(f*1048576 as bigint) as pid, case when f=0 then 5 else 4 end as vertices, case when f=0 then 1 else 0 end as holes, s_suppkey*1e0+f as x0 from supplier cross join (values (0),(1)) t(f) where f=0 or s_suppkey%3<>0""")
def _(fx):
    k = F.col("s_suppkey").cast("string")
    box = lambda x, n: F.concat(F.lit("["), F.lit("["), x, F.lit(",0.0],["), x, F.lit(",9.0],[70.5,9.0],[70.5,0.5]"), F.when(F.lit(n == 5), F.concat(F.lit(",["), x, F.lit(",0.0]"))).otherwise(""), F.lit("]"))
    x0, x1 = F.concat(k, F.lit(".0")), F.concat((F.col("s_suppkey") + 1).cast("string"), F.lit(".0"))
    many = F.concat(F.lit('{"type":"Feature","properties":{"id":"1"},"geometry":{"type":"MultiPolygon","coordinates":[['), box(x0, 5), F.lit(",[[1,1],[2,1],[2,2]],[[1,1],[2,1]]]]}}"))
    one = F.when(F.col("s_suppkey") % 3 == 0, F.lit('{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":[[[1,1],[2,2]]]}}')).otherwise(
        F.concat(F.lit('{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":['), box(x1, 4), F.lit("]}}"))
    )
    raw = fx.table("supplier").select(k.alias("run"), F.concat(F.lit('{"type":"FeatureCollection","features":['), many, F.lit(","), one, F.lit("]}")).alias("value"))
    return text.parse_polygons(raw).select("run", "pid", F.size("exterior").alias("vertices"), F.size("holes").alias("holes"), F.col("exterior")[0]["x"].alias("x0"))


DENSE_SQL = RATES_SQL + """, c as (select distinct run, target_x, target_y from r), tt as (select distinct run, t from r),
dn as (select c.run, tt.t, c.target_x, c.target_y, coalesce(q,0) as q, coalesce(qu,0) as qu, coalesce(qv,0) as qv from c join tt on tt.run=c.run left join r on r.run=c.run and r.t=tt.t and r.target_x=c.target_x and r.target_y=c.target_y)"""


@query("scan_rates", "with " + DENSE_SQL + " select run, t, target_x, target_y, round(q,6) as q, round(qu,6) as qu, round(qv,6) as qv from dn")
def _(fx):
    path = scratch(fx, "rates")
    sinks.write_rates(B.dense_rates(A.source_rates(face_samples(fx), 0.5)), path)
    out = text.scan_rates(fx.spark, path, "*.txt")
    return out.withColumns({c: F.round(c, 6) for c in ("q", "qu", "qv")})


def payloads(df, order, values, path: str, name, kind: str = "float64", ghosts: int = 0, shape: tuple[int, ...] = ()):
    """Write each group (run, frame, name) of rows as one binary file, groups in parallel.

    With the `shape` (patches, rows, columns) of a file, cells that have no row are NaN, as are `ghosts` rings around each patch."""
    if not shape:
        encode = lambda part: np.column_stack([part[c].to_numpy(zero_copy_only=False) for c in values]).astype(kind).tobytes()
        put_files(df, path, "run", name, order, values, encode)
        return

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        q = pdf[values].to_numpy(kind)
        whole = np.full((*shape, len(values)), np.nan, kind)
        whole[pdf["patch"].to_numpy() - 1, pdf["j"].to_numpy(), pdf["i"].to_numpy()] = q
        q = np.pad(whole, ((0, 0), (ghosts, ghosts), (ghosts, ghosts), (0, 0)), constant_values=np.nan)
        put(f"{path}/run={pdf['run'].iloc[0]}/{pdf['name'].iloc[0]}", q.tobytes())
        return pdf[["run"]].head(1)

    df.withColumn("name", name).groupBy("run", "name").applyInPandas(write, "run string").count()


def put_named(df, path: str):
    """Write lines (run, name, line_no, text) as files of these names, files in parallel."""
    put_text(df, path, "run", F.col("name"), "line_no")
    return path


def file_name(stem: str, letter: str):
    return F.concat(F.lit(f"{stem}.{letter}"), F.lpad(F.col("frame").cast("string"), 4, "0"))


def time_lines(frames_, stem: str, form: str, meqn: int, ghosts: int = 0):
    """Time files of (run, frame, t)."""
    text = F.array(*[F.concat_ws(" ", v, F.lit(w)) for v, w in ((F.col("t").cast("string"), "time"), (F.lit(meqn), "meqn"), (F.lit(ghosts), "num_ghost"), (F.lit(form), "file_format"))])
    return frames_.select("run", file_name(stem, "t").alias("name"), F.posexplode(text).alias("line_no", "text"))


GRID_WORDS = (("1", "grid_number"), ("1", "AMR_level"), ("64", "mx"), (None, "my"), ("0.0", "xlow"), ("0.0", "ylow"), ("1.0", "dx"), ("1.0", "dy"))
FRAMES_SQL = "select run, frame, t, i, j, x, y, h, hu, hv, b from frames"


def grid_lines(fx):
    """Header files of the fixed grid, each as high as its frame's rows reach."""
    words = F.array(*[F.concat_ws(" ", F.lit(v) if v else F.col("my").cast("string"), F.lit(w)) for v, w in GRID_WORDS])
    high = fx.frames.groupBy("run", "frame").agg((F.max("j") + 1).alias("my"))
    return high.select("run", file_name("fgout0001", "q").alias("name"), F.posexplode(words).alias("line_no", "text"))


@query("scan_frames", FRAMES_SQL)
def _(fx):
    path, times = scratch(fx, "frames"), fx.frames.select("run", "frame", "t").distinct()
    payloads(fx.frames, ["j", "i"], ["h", "hu", "hv", "b"], path, file_name("fgout0001", "b"))
    heads = grid_lines(fx)
    put_named(time_lines(times, "fgout0001", "binary64", 4).unionByName(heads), path)
    return frames.scan_frames(fx.spark, path)


@query("scan_frames_text", FRAMES_SQL)
def _(fx):
    path, times = scratch(fx, "frames"), fx.frames.select("run", "frame", "t").distinct()
    heads = grid_lines(fx)
    body = fx.frames.select("run", file_name("fgout0001", "q").alias("name"), (100 + F.col("j") * 64 + F.col("i")).alias("line_no"), num("h", "hu", "hv", "b").alias("text"))
    put_named(time_lines(times, "fgout0001", "ascii", 4).unionByName(heads).unionByName(body), path)
    return frames.scan_frames(fx.spark, path)


def binary_patches(fx):
    """Patch frames in binary form with two rings of ghost cells, read back."""
    path, times = scratch(fx, "patches"), fx.patches.select("run", "frame", "t").distinct()
    payloads(fx.patch_cells, ["patch", "j", "i"], ["h", "hu", "hv"], path, file_name("fort", "b"), "float32", 2, (2, 50, 64))
    heads = patch_lines(fx).where("line_no % 10000 < 100").select("run", file_name("fort", "q").alias("name"), "line_no", "text")
    put_named(time_lines(times, "fort", "binary32", 3, 2).unionByName(heads), path)
    return frames.scan_patches(fx.spark, path)


# Both patches of a frame are stored, so frames of one patch only are none.
@query("scan_patch_cells_binary", "select run, frame, t, patch, level, i, j, h, hu, cast(cast(hv as float) as double) as hv from patch_cells")
def _(fx):
    # Headers tell whole patches; cells that have no row are NaN in the payload.
    return binary_patches(fx)[1].where(~F.isnan(F.col("q")[0])).select("run", "frame", "t", "patch", "level", "i", "j", *[F.col("q")[k].alias(c) for k, c in enumerate(("h", "hu", "hv"))])


@query("scan_patches_binary", "select run, frame, t, patch, level, xlow, ylow, dx, dy, mx, my from patches")
def _(fx):
    return binary_patches(fx)[0]


@query("scan_gauges_binary", "select concat('g', gauge%4) as run, gauge, gauge*1e0 as x, gauge*0.5e0 as y, 'stationary' as kind, 1 as level, t, q1, q1*2 as q2 from series")
def _(fx):
    path, run = scratch(fx, "gauges"), F.concat(F.lit("g"), (F.col("gauge") % 4).cast("string"))
    rows = fx.series.select(run.alias("run"), "gauge", F.lit(1.0).alias("level"), "t", "q1", (F.col("q1") * 2).alias("q2"))
    payloads(rows, ["t"], ["level", "t", "q1", "q2"], path, gauge_file(".bin"))
    head = F.array(
        F.concat(F.lit("# gauge_id= "), F.col("gauge").cast("string"), F.lit(" location=( "), num(F.col("gauge") * 1.0, F.col("gauge") * 0.5), F.lit(" ) num_eqn= 2")),
        F.lit("# Stationary gauge"), F.lit("# level, time, q[ 1 2], eta"), F.lit("# file format: binary64, time series in .bin file"),
    )
    put_named(fx.series.select("gauge").distinct().select(run.alias("run"), gauge_file(".txt").alias("name"), F.posexplode(head).alias("line_no", "text")), path)
    return text.scan_gauges(fx.spark, path).select("run", "gauge", "x", "y", "kind", "level", "t", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"))


def patch_lines(fx):
    """Text frames derived from the patch tables."""
    head = fx.patches.select("run", "frame", "patch", F.posexplode(F.array(*[
        F.concat_ws(" ", F.col(c).cast("string"), F.lit(w)) for c, w in (("patch", "grid_number"), ("level", "AMR_level"), ("mx", "mx"), ("my", "my"), ("xlow", "xlow"), ("ylow", "ylow"), ("dx", "dx"), ("dy", "dy"))
    ])).alias("k", "text")).select("run", "frame", (F.col("patch") * 10000 + F.col("k")).alias("line_no"), "text")
    body = fx.patch_cells.select("run", "frame", (F.col("patch") * 10000 + 100 + F.col("j") * 66 + F.col("i")).alias("line_no"), num("h", "hu", "hv").alias("text"))
    gap = fx.patch_cells.where("i = 63").select("run", "frame", (F.col("patch") * 10000 + 100 + F.col("j") * 66 + 64).alias("line_no"), F.lit("  ").alias("text"))
    out = head.unionByName(body).unionByName(gap)
    return out.withColumn("file", F.concat(F.col("run"), F.lit("/fort.q"), F.lpad(F.col("frame").cast("string"), 4, "0")))


@query("scan_patch_cells", "select run, frame, t, patch, level, i, j, h, hu, hv from patch_cells")
def _(fx):
    cells = frames.parse_patches(patch_lines(fx), fx.patches.select("run", "frame", "t").distinct())[1]
    return cells.select("run", "frame", "t", "patch", "level", "i", "j", *[F.col("q")[k].alias(c) for k, c in enumerate(("h", "hu", "hv"))])


@query("scan_patches", "select run, frame, t, patch, level, xlow, ylow, dx, dy, mx, my from patches")
def _(fx):
    return frames.parse_patches(patch_lines(fx), fx.patches.select("run", "frame", "t").distinct())[0]


def deck(fx, text_col):
    """Deck lines of all tracks, eight files of many storms."""
    return fx.tracks.select(F.concat(F.lit("s"), (F.col("storm") % 8).cast("string")).alias("run"), "row_no", "storm", text_col.alias("text"))


def deg(c, scale, pos, neg):
    return F.concat(F.round(F.abs(F.col(c)) * scale).cast("int").cast("string"), F.when(F.col(c) < 0, neg).otherwise(pos))


def stamp(fmt: str):
    """Row time as deck text: one hour per row from 2024-01-01."""
    return F.date_format(F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit("2024-01-01"))) + F.col("row_no") * 3600), fmt)


def tidy(df, *cols):
    return df.select("storm", F.col("ts").cast("timestamp_ntz").alias("ts"), *[F.round(c, 6).alias(c) if c not in ("cls", "event", "tau_h") else c for c in cols])


DEG_SQL = "round(sign(lon)*round(abs(lon)*10)*0.1,6) as lon, round(round(abs(lat)*10)*0.1,6) as lat"


@query("scan_tracks_atcf", f"""select concat('AL', lpad(cast(storm as varchar),4,'0')) as storm, timestamp '2024-01-01'+to_hours(row_no+tau_h) as ts, cast(tau_h as int) as tau_h, {DEG_SQL}, round(case when vmax<>0 then vmax*0.51444444 end,6) as vmax, round(mslp*100,6) as pmin, round(case when row_no%4<>0 then row_no%4*1852e0 end,6) as rmw, case when event='L' then 'HU' else 'TS' end as cls from tracks""")
def _(fx):
    f = F.concat_ws(", ", F.lit("AL"), F.lpad(F.col("storm").cast("string"), 4, "0"), stamp("yyyyMMddHH"), F.lit("  "), F.lit("BEST"), F.col("tau_h").cast("string"),
                    deg("lat", 10, "N", "S"), deg("lon", 10, "E", "W"), F.col("vmax").cast("int").cast("string"), F.col("mslp").cast("int").cast("string"),
                    F.when(F.col("event") == "L", "HU").otherwise("TS"), F.lit("34, NEQ, 0, 0, 0, 0, 1011"), F.lit("   "), (F.col("row_no") % 4).cast("string"), F.lit("0"))
    out = decks.scan_tracks(fx.spark, put_lines(deck(fx, f), scratch(fx, "atcf"), "row_no"), "atcf", "*.txt")
    return tidy(out, "tau_h", "lon", "lat", "vmax", "pmin", "rmw", "cls")


@query("scan_tracks_hurdat", f"""select concat('AL', lpad(cast(storm as varchar),4,'0'), '2024') as storm, timestamp '2024-01-01'+to_hours(row_no) as ts, {DEG_SQL}, round(case when vmax<>0 then vmax*0.51444444 end,6) as vmax, round(mslp*100,6) as pmin, 'TS' as cls, nullif(event,'') as event from tracks""")
def _(fx):
    tenth = lambda c, p, n: F.concat((F.round(F.abs(F.col(c)) * 10) / 10).cast("string"), F.when(F.col(c) < 0, n).otherwise(p))
    f = F.concat_ws(", ", stamp("yyyyMMdd"), stamp("HHmm"), F.when(F.col("event") == "", " ").otherwise(F.col("event")), F.lit("TS"), tenth("lat", "N", "S"), tenth("lon", "E", "W"),
                    F.col("vmax").cast("int").cast("string"), F.col("mslp").cast("int").cast("string"), F.lit("-999, -999"))
    rows = deck(fx, f)
    head = rows.select("run", "storm").distinct().select("run", F.lit(-1).alias("row_no"), "storm", F.concat(F.lit("AL"), F.lpad(F.col("storm").cast("string"), 4, "0"), F.lit("2024,   NAME,   9,")).alias("text"))
    out = decks.scan_tracks(fx.spark, put_lines(rows.unionByName(head), scratch(fx, "hurdat"), "storm", "row_no"), "hurdat", "*.txt")
    return tidy(out, "lon", "lat", "vmax", "pmin", "cls", "event")


# Years of this deck have two digits, which stand for 1951 to 2050.
@query("scan_tracks_jma", """select lpad(cast(storm as varchar),4,'0') as storm, tm-to_years(cast(100*((year(tm)-1951)//100) as int)) as ts, round(round(abs(lon)*10)/10,6) as lon, round(round(abs(lat)*10)/10,6) as lat, round(case when vmax<>0 then vmax*0.51444444 end,6) as vmax, round(mslp*100,6) as pmin, '2' as cls from tracks cross join lateral (select timestamp '2024-01-01'+to_hours(row_no) as tm) y""")
def _(fx):
    ten = lambda c: F.round(F.abs(F.col(c)) * 10).cast("int").cast("string")
    f = F.concat_ws(" ", stamp("yyMMddHH"), F.lit("002"), F.lit("2"), ten("lat"), ten("lon"), F.col("mslp").cast("int").cast("string"), F.lpad(F.col("vmax").cast("int").cast("string"), 3, "0"))
    rows = deck(fx, f)
    head = rows.select("run", "storm").distinct().select("run", F.lit(-1).alias("row_no"), "storm", F.concat(F.lit("66666 "), F.lpad(F.col("storm").cast("string"), 4, "0"), F.lit("  06       5209 1 0 NAME                 20240716")).alias("text"))
    out = decks.scan_tracks(fx.spark, put_lines(rows.unionByName(head), scratch(fx, "jma"), "storm", "row_no"), "jma", "*.txt")
    return tidy(out, "lon", "lat", "vmax", "pmin", "cls")


@query("scan_tracks_tcvitals", f"""select concat(lpad(cast(storm as varchar),3,'0'),'L') as storm, timestamp '2024-01-01'+to_hours(row_no) as ts, {DEG_SQL}, case when vmax<>0 then vmax end as vmax, round(mslp*100,6) as pmin, case when row_no%5<>0 then row_no%5*1000e0 end as rmw, 278000e0 as router from tracks""")
def _(fx):
    f = F.concat_ws(" ", F.lit("NHC "), F.concat(F.lpad(F.col("storm").cast("string"), 3, "0"), F.lit("L")), F.lit("NAME"), stamp("yyyyMMdd"), stamp("HHmm"), deg("lat", 10, "N", "S"), deg("lon", 10, "E", "W"),
                    F.lit("290 062"), F.col("mslp").cast("int").cast("string"), F.lit("1012 0278"), F.col("vmax").cast("int").cast("string"), F.when(F.col("row_no") % 5 == 0, "-999").otherwise((F.col("row_no") % 5).cast("string")), F.lit("-999 M"))
    out = decks.scan_tracks(fx.spark, put_lines(deck(fx, f), scratch(fx, "tcv"), "row_no"), "tcvitals", "*.txt")
    return tidy(out, "lon", "lat", "vmax", "pmin", "rmw", "router")


def full_tracks(fx):
    """Tracks with repeated times and gaps, for the native table."""
    k = F.col("row_no")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.floor(k / 2) * 3600)
    return fx.tracks.select("storm", "row_no", ts.alias("ts"), "lon", "lat", F.when(F.col("vmax") > 0, F.col("vmax")).alias("vmax"), (F.col("mslp") * 100).alias("pmin"),
                            F.when(k % 3 != 0, F.lit(40000.0)).alias("rmw"), F.when(k % 5 != 0, F.lit(3e5)).alias("router"), "event")


TRACK_ROWS_SQL = """with k as (select storm, row_no, floor(row_no/2)*3600 as s, lon, lat, nullif(vmax,0) as vmax, mslp*100 as pmin, case when row_no%3<>0 then 40000e0 else 5000e0 end as rmw, case when row_no%5<>0 then 3e5 end as router, event, row_number() over (partition by storm, floor(row_no/2) order by row_no) as n from tracks),
f as (select storm, coalesce(max(s) filter (event='L'), max(s)) as base from k group by storm)
select k.storm, timestamp '2024-01-01'+to_seconds(base) as "offset", s-base as seconds, lon, lat, vmax, rmw, pmin, router from k join f on f.storm=k.storm where n=1 and vmax is not null and router is not null"""


@query("track_rows", TRACK_ROWS_SQL)
def _(fx):
    t = full_tracks(fx)
    out = sinks.track_rows(t, landfall_offset(t), {"rmw": F.lit(5000.0)})
    return out.withColumn("offset", F.col("offset").cast("timestamp_ntz"))


@query("write_tracks", TRACK_ROWS_SQL)
def _(fx):
    t, path = full_tracks(fx), scratch(fx, "storms")
    rows = sinks.track_rows(t, landfall_offset(t), {"rmw": F.lit(5000.0)})
    sinks.write_tracks(rows, path)
    out = fx.spark.read.option("header", True).schema(rows.drop("storm").schema).csv(path)
    return out.select(*[F.col(c).cast(kind) for c, kind in rows.dtypes]).withColumn("offset", F.col("offset").cast("timestamp_ntz"))


@query("scan_tracks_native", """with k as (select storm, row_no, floor(row_no/2)*3600 as s, lon, lat, nullif(vmax,0) as vmax, mslp*100 as pmin, case when row_no%3<>0 then 40000e0 else 5000e0 end as rmw, case when row_no%5<>0 then 3e5 end as router, row_number() over (partition by storm, floor(row_no/2) order by row_no) as n from tracks)
select cast(storm as varchar) as storm, timestamp '2024-01-01'+to_seconds(s) as ts, lon, lat, vmax, rmw, pmin, router from k where n=1 and vmax is not null and router is not null""")
def _(fx):
    t = sinks.track_rows(full_tracks(fx), None, {"rmw": F.lit(5000.0)})
    rows = t.select(F.col("storm").cast("string").alias("run"), F.col("seconds").alias("at"), num("seconds", "lon", "lat", "vmax", "rmw", "pmin", "router").alias("text"))
    head = t.groupBy("storm").agg(F.max("offset").alias("offset"), F.count("*").alias("n")).select(
        F.col("storm").cast("string").alias("run"), F.posexplode(F.array(F.col("n").cast("string"), F.date_format("offset", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))).alias("at", "text")
    ).select("run", (F.col("at") - 10.0).alias("at"), "text")
    out = decks.scan_tracks(fx.spark, put_lines(head.unionByName(rows), scratch(fx, "native"), "at"), "native", "*.txt")
    return tidy(out, "lon", "lat", "vmax", "rmw", "pmin", "router")


@query("write_cells", "select run, frame, i, j, h from frames where not (run='r0' and frame>=8)")
def _(fx):
    path = scratch(fx, "cells")
    of = lambda rows: B.fingerprint(rows.select("run", F.col("frame").alias("name"), F.lit(1).alias("size"), F.col("t").alias("mtime")).distinct())
    data = fx.frames.select("run", "frame", "i", "j", "h")
    sinks.write_cells(data, path, of(fx.frames))
    # Unchanged fingerprints leave every run as it is, so this rewrite writes nothing.
    sinks.write_cells(data.withColumn("h", F.lit(-1.0)), path, of(fx.frames))
    # A run that has lost frames gets a version without them; the others stay.
    kept = "not (run = 'r0' and frame >= 8)"
    sinks.write_cells(data.where(kept), path, of(fx.frames.where(kept)))
    return sinks.published_cells(fx.spark, path).select("run", F.col("frame").cast("int").alias("frame"), "i", "j", "h")


@query("write_series", "select gauge, sample_no, t, case when sample_no%6<>0 then q1 end as q1 from series")
def _(fx):
    path = scratch(fx, "series")
    s = fx.series.select("gauge", "sample_no", "t", F.when(F.col("sample_no") % 6 != 0, F.col("q1")).alias("q1"))
    sinks.write_series(s, path, ["gauge"])
    return fx.spark.read.option("header", True).schema("gauge long, sample_no long, t double, q1 double").csv(path)


@query("write_profile", "select concat(run, '_', frame) as line_id, x as distance, x, 25.5e0 as y, case when h>0 then h end as value from frames where j=25")
def _(fx):
    path = scratch(fx, "profile")
    p = fx.frames.where("j = 25").select(F.concat_ws("_", "run", "frame").alias("line_id"), F.col("x").alias("distance"), "x", "y", F.when(F.col("h") > 0, F.col("h")).alias("value"))
    sinks.write_profile(p, path)
    return fx.spark.read.option("header", True).schema("distance double, x double, y double, value double, line_id string").csv(path)


@query("union_metrics", """select "case", model, max(v) as peak, null::double as mass from ensemble group by "case", model union all select "case", null, null, sum(v) from ensemble group by "case" """)
def _(fx):
    e = fx.ensemble
    return sinks.union_metrics(e.groupBy("case", "model").agg(F.max("v").alias("peak")), e.groupBy("case").agg(F.sum("v").alias("mass")))


@query("write_metrics", """select "case", model, max(v) as peak, null::double as mass from ensemble group by "case", model union all select "case", null, null, sum(v) from ensemble group by "case" """)
def _(fx):
    e, path = fx.ensemble, scratch(fx, "metrics")
    sinks.write_metrics([e.groupBy("case", "model").agg(F.max("v").alias("peak")), e.groupBy("case").agg(F.sum("v").alias("mass"))], path)
    return fx.spark.read.option("header", True).schema("case string, model string, peak double, mass double").csv(path)
