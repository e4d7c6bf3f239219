"""Queries for sampling and joins."""

from pyspark.sql import functions as F

from gridspark.functions import Geometry
from gridspark.operators import joins as J
from gridspark.operators import sampling as S
from gridspark.plans.fixtures import FRAME_GRID
from gridspark.plans.registry import query

PTS_SQL = """pts as (select event_id as pid, (event_id%700)*0.09375e0-0.5 as x, (event_id%560)*0.09375e0-0.5 as y, (event_id%180)*0.625e0-2.5 as t,
 concat('r', cast(floor(event_id/10000) as int)) as run from events),
pk as (select *, x between 0.5 and 63.5 and y between 0.5 and 49.5 as hull, least(floor(x-0.5),62) as a, least(floor(y-0.5),48) as b from pts),
pw as (select *, x-0.5-a as tx, y-0.5-b as ty from pk)"""


def points(fx, *cols):
    e = F.col("event_id")
    return fx.table("events").select(
        e.alias("pid"),
        (e % 700 * F.lit(0.09375) - 0.5).alias("x"),
        (e % 560 * F.lit(0.09375) - 0.5).alias("y"),
        (e % 180 * F.lit(0.625) - 2.5).alias("t"),
        F.concat(F.lit("r"), F.floor(e / 10000).cast("string")).alias("run"),
    ).select("pid", "x", "y", *cols)


def bilinear_sql(src: str, z: str, keys: str, extra: str = "") -> str:
    on = lambda n, i, j: (
        f"left join {src} {n} on {' and '.join(f'{n}.{k}=k.{k}' for k in keys.split(', '))} and {n}.i={i} and {n}.j={j}"
    )
    return (
        f"select {', '.join('k.' + k for k in keys.split(', '))}, p.pid, p.x, p.y{extra}, "
        f"case when hull then (1-tx)*(1-ty)*c0.{z}+tx*(1-ty)*c1.{z}+(1-tx)*ty*c2.{z}+tx*ty*c3.{z} end as {z} "
        f"from pw p cross join (select distinct {keys} from {src}) k "
        + " ".join(on(n, i, j) for n, i, j in (("c0", "a", "b"), ("c1", "a+1", "b"), ("c2", "a", "b+1"), ("c3", "a+1", "b+1")))
    )


@query("sample_bilinear", "with " + PTS_SQL + " " + bilinear_sql("cells", "z", "run"))
def _(fx):
    return S.sample_bilinear(fx.cells, points(fx), FRAME_GRID, "z")


@query("sample_nearest", "with " + PTS_SQL + """ select k.run, p.pid, p.x, p.y, c.z from pts p cross join (select distinct run from cells) k
left join cells c on c.run=k.run and p.x>=0 and p.x<64 and p.y>=0 and p.y<50 and c.i=floor(p.x) and c.j=floor(p.y)""")
def _(fx):
    return S.sample_nearest(fx.cells, points(fx), FRAME_GRID, "z")


@query("sample_wet_bilinear", "with " + PTS_SQL + """,
q as (select *, x>=0 and x<64 and y>=0 and y<50 as ins, greatest(0,least(floor(x-0.5),62)) as a2, greatest(0,least(floor(y-0.5),48)) as b2 from pts),
w as (select *, greatest(0e0,least(1e0,x-0.5-a2)) as tx, greatest(0e0,least(1e0,y-0.5-b2)) as ty from q)
select k.run, k.frame, pid, w.x, w.y, case when ins then case when c0.h>=0.1e0*0.25e0 and c1.h>=0.1e0*0.25e0 and c2.h>=0.1e0*0.25e0 and c3.h>=0.1e0*0.25e0 and c0.hu+c1.hu+c2.hu+c3.hu is not null
 then (1-tx)*(1-ty)*c0.hu+tx*(1-ty)*c1.hu+(1-tx)*ty*c2.hu+tx*ty*c3.hu else o.hu end end as hu
from w cross join (select distinct run, frame from frames) k
left join frames c0 on c0.run=k.run and c0.frame=k.frame and c0.i=a2 and c0.j=b2
left join frames c1 on c1.run=k.run and c1.frame=k.frame and c1.i=a2+1 and c1.j=b2
left join frames c2 on c2.run=k.run and c2.frame=k.frame and c2.i=a2 and c2.j=b2+1
left join frames c3 on c3.run=k.run and c3.frame=k.frame and c3.i=a2+1 and c3.j=b2+1
left join frames o on o.run=k.run and o.frame=k.frame and o.i=floor(w.x) and o.j=floor(w.y)""")
def _(fx):
    return S.sample_wet_bilinear(fx.frames, points(fx), FRAME_GRID, "hu", dry=0.25)


SPACE_TIME_SQL = "with " + PTS_SQL + """,
rn as (select distinct run from frames),
u as (select rn.run as frun, pw.*, t>=0 and t<=90 as intime, least(greatest(floor(t/10),0),8) as f0 from pw cross join rn),
u2 as (select *, greatest(0e0, least(1e0,(t-f0*10)/10)) as wt from u),
v as (select frun, pid, f.frame, sum(h*(case when f.i=a then 1-tx else tx end)*(case when f.j=b then 1-ty else ty end)) as h
 from u2 join (select run as fr, frame, i, j, h from frames) f on f.fr=frun and f.frame in (f0, f0+1) and f.i in (a,a+1) and f.j in (b,b+1) where hull group by all)
select frun as run, u2.pid, x, y, t, case when hull {GATE} then (1-wt)*v0.h+wt*v1.h end as h from u2
left join v v0 on v0.frun=u2.frun and v0.pid=u2.pid and v0.frame=f0 left join v v1 on v1.frun=u2.frun and v1.pid=u2.pid and v1.frame=f0+1"""


def timed_points(fx):
    """Sample points with a time each; the run column is left off so that every run answers."""
    return points(fx, "t")


@query("interp_space_time", SPACE_TIME_SQL.replace("frun", "run0").replace("run0 as run,", "u2.run0 as run,").replace("{GATE}", "and intime"))
def _(fx):
    return S.interp_space_time(fx.frames, timed_points(fx), FRAME_GRID, "h", width=10.0)


@query("interp_space_time_held", SPACE_TIME_SQL.replace("frun", "run0").replace("run0 as run,", "u2.run0 as run,").replace("{GATE}", ""))
def _(fx):
    return S.interp_space_time(fx.frames, timed_points(fx), FRAME_GRID, "h", width=10.0, hold=True)


SERIES_Q_SQL = """s as (select gauge, t, q1 from series where kind<>'click'), q as (select gauge, t, sample_no from series where kind='click' union all select gauge, t+0.5, sample_no+1000000 from series where kind='view'),
b as (select q.*, a.t as t0, a.q1 as v0 from q asof left join s a on a.gauge=q.gauge and q.t>=a.t),
c as (select b.*, d.t as t1, d.q1 as v1 from b asof left join s d on d.gauge=b.gauge and b.t<d.t)"""


def series_queries(fx):
    s = fx.series
    q = s.where("kind = 'click'").select("gauge", "t", "sample_no")
    return q.unionByName(s.where("kind = 'view'").select("gauge", (F.col("t") + 0.5).alias("t"), (F.col("sample_no") + 1000000).alias("sample_no")))


@query("interp_series", "with " + SERIES_Q_SQL + """ select gauge, t, sample_no, case when t0 is null then null when t1 is null then case when t=t0 then v0 end else v0+(t-t0)/(t1-t0)*(v1-v0) end as q1 from c""")
def _(fx):
    s = fx.series.where("kind <> 'click'")
    return S.interp_series(s, series_queries(fx), ["gauge"], ["q1"])


@query("interp_particles", "with " + SERIES_Q_SQL + """, f as (select gauge, min(t) as first from s group by gauge)
select c.gauge, t, sample_no, case when t<=first or t0 is null then null when t1 is null then v0 else v0+(t-t0)/(t1-t0)*(v1-v0) end as q1 from c left join f on f.gauge=c.gauge""")
def _(fx):
    s = fx.series.where("kind <> 'click'")
    return S.interp_series(s, series_queries(fx), ["gauge"], ["q1"], extend="max", open_start=True)


@query("compare_to_reference", """with r as (select run, frame, avg(x) as x, sum(h) as value from frames where i%4=0 group by run, frame, i), p as (select run, frame, x, sum(h) as value from frames group by run, frame, x),
b as (select p.*, a.x as x0, a.value as v0 from p asof left join r a on a.run=p.run and a.frame=p.frame and p.x>=a.x),
c as (select b.*, d.x as x1, d.value as v1 from b asof left join r d on d.run=b.run and d.frame=b.frame and b.x<d.x),
e as (select run, frame, x, value, case when x0 is null then v1 when x1 is null then v0 else v0+(x-x0)/(x1-x0)*(v1-v0) end as reference from c)
select *, value-reference as difference from e""")
def _(fx):
    profile = fx.frames.groupBy("run", "frame", "x").agg(F.sum("h").alias("value"))
    ref = fx.frames.where("i % 4 = 0").groupBy("run", "frame", "x").agg(F.sum("h").alias("value"))
    return S.compare_to_reference(profile, ref, ["run", "frame"])


FINEST_SQL = "with " + PTS_SQL + """,
cand as (select distinct pts.*, p.frame, p.patch, p.level, least(greatest((x-xlow)/dx-0.5,0e0),63e0) as cx, least(greatest((y-ylow)/dy-0.5,0e0),49e0) as cy from pts join patches p on p.run=pts.run
 and x>=xlow-0.001*dx and x<=xlow+mx*dx+0.001*dx and y>=ylow-0.001*dy and y<=ylow+my*dy+0.001*dy),
k as (select *, least(floor(cx),62) as a2, least(floor(cy),48) as b2 from cand),
c4 as (select k.run, k.pid, k.frame, k.patch, k.level, c.h, c.hu, (case when c.i=a2 then 1-(cx-a2) else cx-a2 end)*(case when c.j=b2 then 1-(cy-b2) else cy-b2 end) as w
 from k join patch_cells c on c.run=k.run and c.frame=k.frame and c.patch=k.patch and c.i in (a2,a2+1) and c.j in (b2,b2+1)),
s as (select run, pid, frame, patch, level, case when count(h)=4 then sum(h*w) end as h, case when count(hu)=4 then sum(hu*w) end as hu from c4 group by run, pid, frame, patch, level),
z as (select run, pid, frame, first(h order by level desc, patch desc) filter (where h is not null) as h, first(hu order by level desc, patch desc) filter (where hu is not null) as hu from s group by run, pid, frame)
select pts.run, pts.pid, pts.x, pts.y, f.frame, f.t, z.h, z.hu from pts join (select distinct run, frame, t from patches) f on f.run=pts.run
 left join z on z.run=pts.run and z.pid=pts.pid and z.frame=f.frame"""


@query("sample_finest", FINEST_SQL)
def _(fx):
    return S.sample_finest(fx.patch_cells, fx.patches, points(fx, "run"), ["h", "hu"])


@query("sample_finest_nearest", "with " + PTS_SQL + """,
cand as (select distinct pts.run, pts.pid, p.frame, p.level, p.patch, least(greatest(floor((x-xlow)/dx),0),63) as a, least(greatest(floor((y-ylow)/dy),0),49) as b from pts join patches p on p.run=pts.run
 and x>=xlow-0.001*dx and x<=xlow+mx*dx+0.001*dx and y>=ylow-0.001*dy and y<=ylow+my*dy+0.001*dy),
z as (select k.run, k.pid, k.frame, first(c.hv order by k.level desc, k.patch desc) filter (where c.hv is not null) as hv
 from cand k join patch_cells c on c.run=k.run and c.frame=k.frame and c.patch=k.patch and c.i=k.a and c.j=k.b group by k.run, k.pid, k.frame)
select pts.run, pts.pid, pts.x, pts.y, f.frame, f.t, z.hv from pts join (select distinct run, frame, t from patches) f on f.run=pts.run
 left join z on z.run=pts.run and z.pid=pts.pid and z.frame=f.frame""")
def _(fx):
    return S.sample_finest(fx.patch_cells, fx.patches, points(fx, "run"), ["hv"], method="nearest")


@query("assign_patch", "with " + PTS_SQL + """ select pts.run, pid, pts.x, pts.y, f.frame, max(p.patch) as patch, max(p.level) as level from pts join (select distinct run, frame from patches) f on f.run=pts.run
left join patches p on p.run=f.run and p.frame=f.frame and pts.x between xlow and xlow+mx*dx and pts.y between ylow and ylow+my*dy group by all""")
def _(fx):
    return S.assign_patch(points(fx, "run"), fx.patches)


@query("active_cells", """select run, frame, patch, i, j, h from pcx where not (level=1 and x between 16 and 48 and y between 10 and 35)""")
def _(fx):
    return S.active_cells(fx.patch_cells, fx.patches).select("run", "frame", "patch", "i", "j", "h")


@query("align_mask", "select run, i, j, ((i+4)*3+(j+2)*5)%7<3 as masked from cells")
def _(fx):
    mask = fx.spark.range(72 * 56).select(
        (F.col("id") % 72).cast("int").alias("i"), F.floor(F.col("id") / 72).cast("int").alias("j")
    ).withColumn("flag", (F.col("i") * 3 + F.col("j") * 5) % 7 < 3)
    return J.align_mask(fx.cells, mask, -4.0, -2.0, 1.0).select("run", "i", "j", "masked")


ZERO_SQL = """m as (select distinct i, j from cells where z>17),
t as (select distinct least(63,floor((m.i-0.25)*1.0)+d) as i, least(49,floor((m.j-0.25)*1.0)+e) as j from m, (values (0),(1),(2)) a(d), (values (0),(1),(2)) b(e)
 where floor(m.i-0.25)+d < m.i+1.25 and floor(m.j-0.25)+e < m.j+1.25 and floor(m.i-0.25)+d>=0 and floor(m.j-0.25)+e>=0)"""


@query("zero_where", "with " + ZERO_SQL + " select run, frame, f.i, f.j, t.i is not null as zeroed, case when t.i is not null then 0 else h end as h from frames f left join t on t.i=f.i and t.j=f.j")
def _(fx):
    foot = fx.cells.where("z > 17").select("x", "y").distinct()
    return J.zero_where(fx.frames, foot, FRAME_GRID, 1.5).select("run", "frame", "i", "j", "zeroed", "h")


@query("zeroed_summary", "with " + ZERO_SQL + " select run, frame, max(case when t.i is not null then 0 else h end) as peak, count(t.i) as zeroed from frames f left join t on t.i=f.i and t.j=f.j group by run, frame")
def _(fx):
    foot = fx.cells.where("z > 17").select("x", "y").distinct()
    return J.zeroed_summary(J.zero_where(fx.frames, foot, FRAME_GRID, 1.5))


@query("grid_pairs", """with g as (select concat('c', n_regionkey) as "case", concat('m', n_nationkey) as model, 100+case when n_nationkey%7=0 then 1 else 0 end as ncols, case when n_nationkey%6=0 then 5.5e0 else 5e0 end as cellsize, case when n_nationkey%5=0 then 1e-3 else 1e-10*n_nationkey end as xmin from nation)
select "case", model, case when ncols<>100 then 'shape differs' when cellsize<>5 then 'cell size differs' when abs(xmin-1e-10)>1e-8 then 'x centres differ' end as reason from g
where model<>'m1' and "case" in (select "case" from g where model='m1')""")
def _(fx):
    n = F.col("n_nationkey")
    grids = fx.table("nation").select(
        F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("case"), F.concat(F.lit("m"), n.cast("string")).alias("model"),
        F.when(n % 7 == 0, 101).otherwise(100).alias("ncols"), F.lit(80).alias("nrows"),
        F.when(n % 6 == 0, 5.5).otherwise(5.0).alias("cellsize"),
        F.when(n % 5 == 0, 1e-3).otherwise(n * 1e-10).alias("xmin"), F.lit(0.0).alias("ymin"),
    )
    return J.grid_pairs(grids, "m1")


FILES_SQL = """f as (select concat('c', cast(floor(p_partkey/100) as int)) as "case", concat('run', cast(floor(p_partkey/40) as int), case when floor(p_partkey/4)%2=0 then '_null_' else '_' end, 'mod', cast(floor(p_partkey/8) as int)) as stem, p_partkey, p_size from part)"""


@query("pair_outputs", "with " + FILES_SQL + """, n as (select distinct "case", concat(stem, case (p_partkey*7+p_size)%4 when 0 then '_pft' when 1 then '_pfv' when 2 then '_h_max' else '_s_max' end, case p_size%3 when 0 then '.asc' when 1 then '' else '.tif' end) as name from f),
m as (select "case", name, regexp_extract(name, '^(.*)_(pft|pfv|h_max|s_max)(\\.asc|\\.tif)?$', 1) as stem, regexp_extract(name, '^(.*)_(pft|pfv|h_max|s_max)(\\.asc|\\.tif)?$', 2) as kind, regexp_extract(name, '^(.*)_(pft|pfv|h_max|s_max)(\\.asc|\\.tif)?$', 3) as ext from n),
m2 as (select *, case when contains(stem,'_null_') then regexp_extract(stem,'_null_(.+)$',1) else regexp_extract(stem,'([^_]*)$',1) end as model from m),
p as (select a."case", a.model, a.name as thickness, a.kind, (select min_by(b.name, case b.ext when '' then 0 when '.asc' then 1 else 2 end) from m2 b where b."case"=a."case" and b.stem=a.stem and b.kind=case a.kind when 'pft' then 'pfv' else 's_max' end) as speed from m2 a where a.kind in ('pft','h_max'))
select "case", model, thickness, speed from p where speed is not null and not (kind='h_max' and exists (select 1 from p q where q."case"=p."case" and q.model=p.model and q.kind='pft' and q.speed is not null))""")
def _(fx):
    k, s = F.col("p_partkey"), F.col("p_size")
    stem = F.concat(F.lit("run"), F.floor(k / 40).cast("string"), F.when(F.floor(k / 4) % 2 == 0, "_null_").otherwise("_"), F.lit("mod"), F.floor(k / 8).cast("string"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("_pft", "_pfv", "_h_max", "_s_max")]), ((k * 7 + s) % 4 + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(x) for x in (".asc", "", ".tif")]), (s % 3 + 1).cast("int"))
    files = fx.table("part").select(F.concat(F.lit("c"), F.floor(k / 100).cast("string")).alias("case"), F.concat(stem, kind, ext).alias("name")).distinct()
    return J.pair_outputs(files)[0]


@query("complete_frames", "select distinct run, frame, t from frames where frame%3<>1")
def _(fx):
    times = fx.frames.select("run", "frame", "t").distinct()
    data = fx.frames.where("frame % 3 <> 1").select("run", "frame")
    return J.complete_frames(times, data)[0]


@query("missing_frames", "select distinct run, frame, t from frames where frame%3=1")
def _(fx):
    times = fx.frames.select("run", "frame", "t").distinct()
    data = fx.frames.where("frame % 3 <> 1").select("run", "frame")
    return J.complete_frames(times, data)[1]


@query("observed_vs_predicted", """select coalesce(a.gauge, b.gauge) as station, coalesce(a.t, b.t) as t, a.q1 as observed, b.q1 as predicted
from (select * from series where kind in ('view','click')) a full join (select gauge, floor(t/2)*2 as t, max(q1) as q1 from series group by all) b on a.gauge=b.gauge and a.t=b.t""")
def _(fx):
    obs = fx.series.where("kind in ('view', 'click')").select(F.col("gauge").alias("station"), "t", F.col("q1").alias("value"))
    pred = fx.series.groupBy(F.col("gauge").alias("station"), (F.floor(F.col("t") / 2) * F.lit(2.0)).alias("t")).agg(F.max("q1").alias("value"))
    return J.observed_vs_predicted(obs, pred, strict=False)


@query("compare_series", """with a as (select * from series where sample_no%50<>3), b as (select gauge, sample_no, t+case when gauge%4=0 then 0.25 else 0 end as t, q1+case when gauge%5=0 then 0.5 else 0 end as q1 from series where not (gauge%7=0 and sample_no%40=5)),
f as (select coalesce(a.gauge,b.gauge) as gauge, abs(a.t-b.t) as dt, abs(a.q1-b.q1) as dq, a.gauge is null as nb, b.gauge is null as na from a full join b on a.gauge=b.gauge and a.sample_no=b.sample_no)
select gauge, max(dt) as max_t, max(dq) as max_q1, count(*) filter (na) as only_first, count(*) filter (nb) as only_second,
 coalesce(max(dt),0)<=1e-8 and coalesce(max(dq),0)<=1e-8 and count(*) filter (na or nb)=0 as passed from f group by gauge""")
def _(fx):
    a = fx.series.where("sample_no % 50 <> 3")
    b = fx.series.where("not (gauge % 7 = 0 and sample_no % 40 = 5)").select(
        "gauge", "sample_no", (F.col("t") + F.when(F.col("gauge") % 4 == 0, 0.25).otherwise(0.0)).alias("t"),
        (F.col("q1") + F.when(F.col("gauge") % 5 == 0, 0.5).otherwise(0.0)).alias("q1"),
    )
    return J.compare_series(a, b, ["q1"])


@query("zone_parameters", """select run, i, j, zone, mu from (select *, case when z is null then 0 when z<4 then 1 when z<11 then 2 else 3 end as zone from cells) left join (values (1,0.3e0),(2,0.25e0),(3,0.2e0)) p(zone2,mu) on zone2=zone""")
def _(fx):
    zones = fx.spark.createDataFrame([(1, 0.3), (2, 0.25), (3, 0.2)], "zone int, mu double")
    return J.zone_parameters(fx.cells, [4.0, 11.0], zones).select("run", "i", "j", "zone", "mu")


@query("region_roughness", """select run, i, j, case when x>20 and x<=40.5 and y>5 and y<=30.5 and z>=0 and z<6 then 0.05e0 when x>20 and x<=40.5 and y>5 and y<=30.5 and z>=6 and z<20 then 0.04e0
 when x>4.5 and x<=30 and y>2 and y<=20 and z>=2 and z<12 then 0.03e0 else 0.025e0 end as roughness from cells""")
def _(fx):
    regions = [
        {"lower": (4.5, 2.0), "upper": (30.0, 20.0), "depths": [12.0, 2.0], "coefficients": [0.03]},
        {"lower": (20.0, 5.0), "upper": (40.5, 30.5), "depths": [20.0, 6.0, 0.0], "coefficients": [0.04, 0.05]},
    ]
    return J.region_roughness(fx.cells, regions, 0.025).select("run", "i", "j", "roughness")


HAV = "2*6367500e0*asin(sqrt(pow(sin(radians(lat-s_lat)/2),2)+cos(radians(s_lat))*cos(radians(lat))*pow(sin(radians(lon-s_lon)/2),2)))/1000"


@query("storm_proximity", f"""with s as (select s_suppkey as station, -92+(s_suppkey%60)*0.75e0+0.0625e0 as s_lon, 11+(s_suppkey%25)*0.75e0+0.0625e0 as s_lat from supplier),
d as (select storm, row_no, station, lon, lat, s_lon, s_lat, {HAV} as km from tracks join s on abs(lat-s_lat)<1.5)
select storm, row_no, station, round(km,6) as distance_km, round((degrees(atan2(sin(radians(lon-s_lon))*cos(radians(lat)), cos(radians(s_lat))*sin(radians(lat))-sin(radians(s_lat))*cos(radians(lat))*cos(radians(lon-s_lon))))+360)%360,6) as bearing from d where km<=120""")
def _(fx):
    k = F.col("s_suppkey")
    st = fx.table("supplier").select(
        k.alias("station"), (-92 + k % 60 * F.lit(0.75) + 0.0625).alias("lon"), (11 + k % 25 * F.lit(0.75) + 0.0625).alias("lat")
    )
    return J.storm_proximity(fx.tracks, st, 120.0, digits=6).select("storm", "row_no", "station", "distance_km", "bearing")


FILL_SQL = """tr as (select storm, row_no*1e0 as t, row_no, nullif(vmax,0) as rmw from tracks), a as (select * from tr where row_no%2=0), o as (select storm, t, rmw from tr where row_no%2=1 and rmw is not null),
g as (select * from a where rmw is null), h as (select * from a where rmw is not null),
fo as (select g.row_no, p.t t0, p.rmw v0, n.t t1, n.rmw v1 from g asof left join o p on p.storm=g.storm and g.t>=p.t asof left join o n on n.storm=g.storm and g.t<n.t),
fh as (select g.row_no, p.t t0, p.rmw v0, n.t t1, n.rmw v1 from g asof left join h p on p.storm=g.storm and g.t>=p.t asof left join h n on n.storm=g.storm and g.t<n.t)"""


@query("fill_from_other", "with " + FILL_SQL + """ select a.storm, a.t, a.row_no, round(coalesce(a.rmw, case when fo.t0 is not null and fo.t1 is not null then fo.v0+(a.t-fo.t0)/(fo.t1-fo.t0)*(fo.v1-fo.v0) end,
 case when fh.t0 is not null and fh.t1 is not null then fh.v0+(a.t-fh.t0)/(fh.t1-fh.t0)*(fh.v1-fh.v0) end, -1),6) as rmw from a left join fo on fo.row_no=a.row_no left join fh on fh.row_no=a.row_no""")
def _(fx):
    tr = fx.tracks.select("storm", F.col("row_no").cast("double").alias("t"), "row_no", F.expr("nullif(vmax, 0)").alias("rmw"))
    out = J.fill_from_other(tr.where("row_no % 2 = 0"), tr.where("row_no % 2 = 1"), "rmw")
    return out.withColumn("rmw", F.round("rmw", 6))
