"""Queries for projections, filters and predicates."""

from pyspark.sql import functions as F

from gridspark.operators import filters as P
from gridspark.plans.registry import query

# Outline used by the polygon queries: a notched shape and a square with a hole (fixed values).
RINGS = [
    (1, [(8.3, 6.2), (30.6, 6.2), (30.6, 20.7), (19.4, 13.3), (8.3, 20.7)], []),
    (2, [(35.2, 10.4), (55.8, 10.4), (55.8, 40.6), (35.2, 40.6)], [[(40.3, 15.2), (50.7, 15.2), (50.7, 30.9), (40.3, 30.9)]]),
]


def polygons(spark, rings=RINGS):
    ring = "array<struct<x:double,y:double>>"
    return spark.createDataFrame(rings, f"pid int, exterior {ring}, holes array<{ring}>")


@query("crop", """
select run, cast((i-8)/3 as int) as i, cast((j-6)/3 as int) as j, x, y, z from cells
where i between 8 and 50 and (i-8)%3=0 and j between 6 and 42 and (j-6)%3=0""")
def _(fx):
    return P.crop(fx.cells, fx.grids, (10.0, 50.0, 8.0, 42.0), coarsen=3, buffer=1, align=(2.5, 0.5))


@query("crop_to_polygons", """
select run, cast(i-8 as int) as i, cast(j-6 as int) as j, x, y, z from cells where i between 8 and 56 and j between 6 and 41""")
def _(fx):
    return P.crop_to_polygons(fx.cells, fx.grids, polygons(fx.spark))


@query("trim_to_multiple", """
select run, cast(i-2 as int) as i, cast(j-2 as int) as j, x, y, z from cells where i between 2 and 61 and j between 2 and 46
""")
def _(fx):
    # 64 = 4 * 15 + 4 -> two off each side at ratio 15; 50 = 3 * 15 + 5 -> two south, three north.
    return P.trim_to_multiple(fx.cells, fx.grids, 15.0)


DOMAINS_SQL = """d as (select p_partkey as domain, concat('r', p_partkey%10) as run, (p_partkey%13)*2.0e0-2 as xmin, (p_partkey%13)*2.0e0-2+p_size*1e0 as xmax,
 (p_partkey%7)*3.0e0 as ymin, (p_partkey%7)*3.0e0+(p_size%20)*0.5e0+4 as ymax from part)"""


def domains(fx):
    k, s = F.col("p_partkey"), F.col("p_size")
    x0, y0 = (k % 13) * F.lit(2.0) - 2, (k % 7) * F.lit(3.0)
    return fx.table("part").select(
        k.alias("domain"), F.concat(F.lit("r"), (k % 10).cast("string")).alias("run"), x0.alias("xmin"),
        (x0 + s).alias("xmax"), y0.alias("ymin"), (y0 + (s % 20) * F.lit(0.5) + 4).alias("ymax"),
    )


@query("fit_domain", "with " + DOMAINS_SQL + """,
n as (select d.*, cast(xmax-xmin as int) as nx, cast(floor(ymax-ymin) as int) as ny,
 case when xmin<0 or xmax>64 or ymax>50 then 'outside the terrain'
  when ymax<>floor(ymax) then 'not aligned with the terrain'
  when floor((xmax-xmin)/3)<2 or floor((ymax-ymin)/3)<2 then 'fewer than two cells' end as issue from d
  where run in (select distinct run from cells))
select domain, run, xmin, xmax, ymin, ymax,
 case when issue is null then xmin+floor((nx%3)/2) end as fit_xmin, case when issue is null then xmax-(nx%3-floor((nx%3)/2)) end as fit_xmax,
 case when issue is null then ymin+floor((ny%3)/2) end as fit_ymin, case when issue is null then ymax-(ny%3-floor((ny%3)/2)) end as fit_ymax, issue from n""")
def _(fx):
    return P.fit_domain(domains(fx), fx.grids, 3.0)


@query("overlapping", "with " + DOMAINS_SQL + """,
r as (select s_suppkey as run, (s_suppkey%40)*2e0 as xmin, (s_suppkey%40)*2e0+6 as xmax, (s_suppkey%9)*4e0 as ymin, (s_suppkey%9)*4e0+5 as ymax,
 case s_nationkey%3 when 0 then 'EPSG:2056' when 1 then 'epsg:2056 ' else 'EPSG:4326' end as crs from supplier)
select d.domain, r.run from d join r on d.xmax>r.xmin and d.xmin<r.xmax and d.ymax>r.ymin and d.ymin<r.ymax
where d.domain%5=0 or (d.domain%5<>0 and trim(upper(r.crs))=case when d.domain%5<3 then 'EPSG:2056' else 'EPSG:4326' end)""")
def _(fx):
    k, n = F.col("s_suppkey"), F.col("s_nationkey") % 3
    x0, y0 = (k % 40) * F.lit(2.0), (k % 9) * F.lit(4.0)
    runs = fx.table("supplier").select(
        k.alias("run"), x0.alias("xmin"), (x0 + 6).alias("xmax"), y0.alias("ymin"), (y0 + 5).alias("ymax"),
        F.when(n == 0, "EPSG:2056").when(n == 1, "epsg:2056 ").otherwise("EPSG:4326").alias("crs"),
    )
    m = F.col("domain") % 5
    crs = F.when(m == 0, "").when(m < 3, "epsg:2056").otherwise("EPSG:4326")
    return P.overlapping(domains(fx).withColumn("crs", crs), runs, bin_size=16.0)


@query("wet_mask", """select run, frame, i, j, case when h>=0.001 then h else 0 end as depth,
 round(case when h>=0.05 then hu/h else 0 end, 6) as u, round(case when h>=0.05 then hv/h else 0 end, 6) as v from frames""")
def _(fx):
    return P.wet_mask(fx.frames).select("run", "frame", "i", "j", "depth", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@query("clean_nonneg", "select run, frame, i, j, case when hu>0 then hu else 0 end as hu from frames")
def _(fx):
    return P.clean_nonneg(fx.frames, "hu").select("run", "frame", "i", "j", "hu")


@query("nodata_to_null", "select run, i, j, z from cells")
def _(fx):
    coded = fx.cells.withColumn("z", F.coalesce("z", F.when(F.col("i") % 2 == 0, -9999.0).otherwise(float("nan"))))
    return P.nodata_to_null(coded, -9999.0).select("run", "i", "j", "z")


@query("in_ruled_region", """select run, i, j, case when x<4.5 or x>40.5 then false
 when x<20.5 then y between 10+(x-4.5)/16*(5-10) and 20+(x-4.5)/16*(40-20)
 else y between 5+(x-20.5)/20*(15-5) and 40+(x-20.5)/20*(30-40) end as inside from cells""")
def _(fx):
    return P.in_ruled_region(
        fx.cells, [4.5, 20.5, 40.5], [10, 5, 15], [20, 40, 30], "x", linear=True
    ).select("run", "i", "j", "inside")


@query("in_ruled_region_stepped", """select run, i, j, case when y<8 or y>44 then false
 when y<20 then x between 10 and 20 when y<32 then x between 4 and 50 when y<44 then x between 14 and 30 else x between 14 and 30 end as inside from cells""")
def _(fx):
    return P.in_ruled_region(
        fx.cells, [8, 20, 32, 44], [10, 4, 14, 14], [20, 50, 30, 30], "y"
    ).select("run", "i", "j", "inside")


@query("thin_frames", "select run, frame, t, i, j, h from frames where frame%3=0")
def _(fx):
    return P.thin_frames(fx.frames, 3).select("run", "frame", "t", "i", "j", "h")


@query("convert_units", """select storm, row_no, round(vmax*0.51444444,6) as vmax, round(mslp*100/1000,6) as mslp, round((lon*9/5)+32,6) as lon from tracks""")
def _(fx):
    out = P.convert_units(fx.tracks, {"vmax": ("knots", "m/s"), "mslp": ("mbar", "KPa"), "lon": ("C", "F")})
    return out.select("storm", "row_no", *[F.round(c, 6).alias(c) for c in ("vmax", "mslp", "lon")])


@query("convert_units_by_row", """select storm, row_no, round(case event when 'L' then mslp*100 else mslp*1000 end,6) as pa from tracks""")
def _(fx):
    from gridspark.functions.units import convert_by_column

    unit = F.when(F.col("event") == "L", "mbar").otherwise("KPa")
    return fx.tracks.select("storm", "row_no", F.round(convert_by_column(F.col("mslp"), unit, "Pa"), 6).alias("pa"))


@query("clip_to_active", """with b as (select run, min(i) i0, max(i) i1, min(j) j0, max(j) j1 from cells where z>14 group by run)
select c.run, c.i-i0 as i, c.j-j0 as j, x, y, z from cells c join b on b.run=c.run where i between i0 and i1 and j between j0 and j1""")
def _(fx):
    return P.clip_to_active(fx.cells, F.col("z") > 14)


@query("invalid_cells", """with b as (select * from cells where i<40 and (z is null or z<0.5))
select c.run, count(b.i) as invalid, min(b.j) as first_row, min(b.i) filter (b.j=(select min(b2.j) from b b2 where b2.run=c.run)) as first_column
from (select distinct run from cells) c left join b on b.run=c.run group by c.run""")
def _(fx):
    return P.invalid_cells(fx.cells.withColumn("z", F.col("z") - 0.5), F.col("i") < 40)


@query("altitude_zone", """select run, i, j, case when z is null then 0 when z<3 then 1 when z<7.5 then 2 when z<12 then 3 else 4 end as zone from cells""")
def _(fx):
    return fx.cells.select("run", "i", "j", P.altitude_zone("z", [3.0, 7.5, 12.0]).alias("zone"))


CONFIG_SQL = """p as (select p_partkey as run, p_size-5.0e0 as d0, p_partkey%4 as period_return, p_size%11*1e0 as t_max,
 p_partkey%6*0.5e0 as cell_size, p_size%9-1e0 as reg_depth, p_size%5 as outputs, p_size%7*0.25e0 as cfl_target, p_partkey%5*0.25e0 as cfl_max,
 p_partkey%8*1e0 as delta_t, case p_partkey%4 when 0 then 'Coulomb' when 1 then 'Voellmy' when 2 then 'Water' else 'Bingham' end as rheology,
 p_size%3 as k, p_partkey%9*1.0e0 as xmax, p_size*0.5e0 as ymax, p_partkey%3*0.5e0 as source_cell_size from part)"""


def config_runs(fx):
    k, s = F.col("p_partkey"), F.col("p_size")
    third = s % 3
    lists = lambda vals: F.when(third == 0, F.array(*vals[:1])).otherwise(F.array(*vals))
    d = lambda *v: [F.lit(float(x)) for x in v]
    m = k % 4
    return fx.table("part").select(
        k.alias("run"), (s - 5.0).alias("d0"), (k % 4).alias("period_return"), (s % 11).cast("double").alias("t_max"),
        (k % 6 * 0.5).alias("cell_size"), (s % 9 - 1.0).alias("reg_depth"), (s % 5).alias("outputs"),
        (s % 7 * 0.25).alias("cfl_target"), (k % 5 * 0.25).alias("cfl_max"), (k % 8).cast("double").alias("delta_t"),
        F.when(m == 0, "Coulomb").when(m == 1, "Voellmy").when(m == 2, "Water").otherwise("Bingham").alias("rheology"),
        lists(d(0.3, -0.1)).alias("mu"), F.array(*d(1000, 900)).alias("xi"), lists(d(-5, 1)).alias("cohesion"),
        F.when(third == 1, F.array(*d(1, 2))).otherwise(F.array(*d(2))).alias("z_breaks"),
        F.lit(0.0).alias("xmin"), (k % 9).cast("double").alias("xmax"), F.lit(0.0).alias("ymin"), (s * 0.5).alias("ymax"),
        (k % 3 * 0.5).alias("source_cell_size"),
    )


@query("validate_config", "with " + CONFIG_SQL + """,
q as (select *, case when cell_size<>0 then xmax/cell_size end as nx, case when cell_size<>0 then ymax/cell_size end as ny,
 case when source_cell_size<>0 then cell_size/source_cell_size end as ratio, case rheology when 'Water' then 4 else 10 end as need from p),
r as (select run, unnest([
 case when d0<0 then 'release depth must be non-negative and finite' end,
 case when period_return<1 then 'return period must be at least one year' end,
 case when t_max<=0 then 'end time must be positive' end,
 case when cell_size<=0 then 'cell size must be positive' end,
 case when reg_depth<0 then 'regularisation depth must be non-negative and finite' end,
 case when outputs<1 then 'output counts must be at least one' end,
 case when cfl_target>cfl_max then 'target CFL exceeds maximum CFL' end,
 case when delta_t>t_max then 'check interval exceeds end time' end,
 case when rheology='Bingham' then 'rheology is not known' end,
 case when k=0 then 'zone lists differ in length' end,
 case when k in (0,1) then 'zones need one break fewer than values' end,
 case when k<>0 then 'friction values must be positive' end,
 'cohesion must be non-negative',
 case when coalesce(not (xmax>0 and abs(nx-round(nx))<=1e-8), true) then 'x span is not a whole number of cells' end,
 case when coalesce(not (ymax>0 and abs(ny-round(ny))<=1e-8), true) then 'y span is not a whole number of cells' end,
 case when xmax>0 and coalesce(abs(nx-round(nx))<=1e-8, true) and coalesce(round(nx)<need,true) then 'x span has too few cells' end,
 case when ymax>0 and coalesce(abs(ny-round(ny))<=1e-8, true) and coalesce(round(ny)<need,true) then 'y span has too few cells' end,
 case when coalesce(source_cell_size<=0 or ratio<1 or abs(ratio-round(ratio))>1e-8, true) then 'terrain cell must divide the cell' end]) as issue from q)
select * from r where issue is not null""")
def _(fx):
    return P.validate_config(config_runs(fx))


@query("validate_regular_rectangle", """with c as (select run, x, y from cells where not (run='r1' and i=5) union all select run, x, y from cells where run='r2' and i=3 and j=4),
n as (select run, cast(sum(c) as bigint) as n, cast(sum(c-1) as bigint) as duplicates from (select run, x, y, count(*) c from c group by all) group by run),
ax as (select run, count(*) nx, min(d) dx_min, max(d) dx_max from (select run, x-lag(x) over (partition by run order by x) d from (select distinct run, x from c)) group by run),
ay as (select run, count(*) ny, min(d) dy_min, max(d) dy_max from (select run, y-lag(y) over (partition by run order by y) d from (select distinct run, y from c)) group by run)
select run, n, duplicates, nx, dx_min, dx_max, ny, dy_min, dy_max, duplicates=0 and nx*ny=n and dx_min=dx_max and dy_min=dy_max as regular from n join ax using (run) join ay using (run)""")
def _(fx):
    c = fx.cells.select("run", "x", "y", "i", "j")
    gap = c.where(~((F.col("run") == "r1") & (F.col("i") == 5)))
    twice = c.where((F.col("run") == "r2") & (F.col("i") == 3) & (F.col("j") == 4))
    return P.validate_regular_rectangle(gap.unionByName(twice).select("run", "x", "y"))
