"""Queries for lines, series, tables, configuration and logs."""

from pyspark.sql import functions as F

from gridspark.operators import aggs as A
from gridspark.operators import logs as G
from gridspark.operators import sampling as S
from gridspark.operators import tables as B
from gridspark.operators import windows as W
from gridspark.plans.aggs import RATES_SQL, SCORE_SQL, face_samples, scores
from gridspark.plans.fixtures import FRAME_GRID
from gridspark.plans.registry import query

LINES_SQL = """v as (select storm as line_id, row_no as k, lon+90 as x, lat+10 as y from tracks),
sg as (select line_id, k, lag(x) over w as x0, lag(y) over w as y0, x as x1, y as y1 from v window w as (partition by line_id order by k)),
s1 as (select *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) as len from sg where x0 is not null and (x0<>x1 or y0<>y1)),
s2 as (select *, sum(len) over (partition by line_id order by k) as c1, sum(len) over (partition by line_id) as total, row_number() over (partition by line_id order by k) as rn, count(*) over (partition by line_id) as rc from s1),
s3 as (select *, coalesce(lag(c1) over (partition by line_id order by k),0) as c0 from s2)"""


def lines(fx):
    p = F.struct((F.col("lon") + 90).alias("x"), (F.col("lat") + 10).alias("y"))
    pts = F.transform(F.sort_array(F.collect_list(F.struct("row_no", p.alias("p")))), lambda r: r["p"])
    return fx.tracks.groupBy(F.col("storm").alias("line_id")).agg(pts.alias("pts"))


def resample_sql(n: str) -> str:
    return ("with " + LINES_SQL + f""", q as (select line_id, max(total) as total, cast({n} as bigint) as n from s3 group by line_id),
sm as (select line_id, total, n, unnest(generate_series(0, n)) as k from q),
d as (select line_id, k, case when k=n then total else k*(total/n) end as distance from sm),
m as (select d.line_id, d.k, d.distance, s3.x0+(d.distance-c0)/len*(x1-x0) as x, s3.y0+(d.distance-c0)/len*(y1-y0) as y, row_number() over (partition by d.line_id, d.k order by s3.k) as pick
 from d join s3 on s3.line_id=d.line_id and d.distance<=c1+1e-9)
select line_id, cast(k as int) as k, round(distance,6) as distance, round(x,6) as x, round(y,6) as y from m where pick=1""")


@query("resample_lines", resample_sql("ceil(max(total)/25.3)"))
def _(fx):
    out = W.resample_lines(lines(fx), spacing=25.3)
    return out.withColumns({c: F.round(c, 6) for c in ("distance", "x", "y")})


@query("resample_lines_by_count", resample_sql("37"))
def _(fx):
    out = W.resample_lines(lines(fx), count=38)
    return out.withColumns({c: F.round(c, 6) for c in ("distance", "x", "y")})


PROFILE_SQL = """ps as (select unnest(generate_series(0,40)) as k), pp as (select cast(k as int) as k, 2.5+k*1.25e0 as x, 1.5+k*1.0e0 as y from ps),
pq as (select *, floor(x-0.5) as a, floor(y-0.5) as b from pp),
pv as (select f.run, f.frame, q.k, case when count(f.h)=4 then sum(f.h*(case when f.i=a then 1-(x2-0.5-a) else x2-0.5-a end)*(case when f.j=b then 1-(y2-0.5-b) else y2-0.5-b end)) end as h from (select k, x as x2, y as y2, a, b from pq) q join (select run, frame, i, j, h from frames) f on f.i in (a,a+1) and f.j in (b,b+1) group by all)"""


@query("historical_max_profile", "with " + PROFILE_SQL + " select run, k, max(h) as h from pv where frame<=6 group by all")
def _(fx):
    line = fx.spark.range(1, 2).withColumnRenamed("id", "line_id").withColumn(
        "pts", F.array(F.struct(F.lit(2.5).alias("x"), F.lit(1.5).alias("y")), F.struct(F.lit(52.5).alias("x"), F.lit(41.5).alias("y")))
    )
    pts = W.resample_lines(line, count=41).select("k", (2.5 + F.col("k") * F.lit(1.25)).alias("x"), (1.5 + F.col("k") * F.lit(1.0)).alias("y"))
    return A.historical_max_profile(S.sample_bilinear(fx.frames, pts, FRAME_GRID, "h"), 6, ["run", "k"], "h")


@query("frame_intervals", """with f as (select distinct run, frame, t from frames), g as (select run, frame, t, cast(round(t*1000) as bigint) as start_ms from f)
select run, frame, t, start_ms, coalesce(lead(start_ms) over (partition by run order by t), start_ms+greatest(start_ms-lag(start_ms) over (partition by run order by t),1)) as end_ms from g""")
def _(fx):
    return W.frame_intervals(fx.frames)


@query("running_envelope", """with f as (select run, frame, min(t) as t, max(x) filter (h>0.375) as front from frames group by run, frame) select *, max(front) over (partition by run order by t) as envelope from f""")
def _(fx):
    f = fx.frames.groupBy("run", "frame").agg(F.min("t").alias("t"), F.max(F.when(F.col("h") > 0.375, F.col("x"))).alias("front"))
    return W.running_envelope(f)


@query("sustained_rest", """with s as (select gauge as run, t, q1/64 as moving_fraction from series),
l as (select run, max(t) filter (moving_fraction>1.5) as last from s group by run), q as (select s.run, t, row_number() over (partition by s.run order by t) as n from s join l on l.run=s.run where last is null or t>last),
f as (select run, max(t) filter (n=3) as confirmed, min(t) as rest from q group by run)
select l.run, confirmed, case when confirmed is not null then rest end as rest from l left join f on f.run=l.run""")
def _(fx):
    s = fx.series.select(F.col("gauge").alias("run"), "t", (F.col("q1") / 64).alias("moving_fraction"))
    return W.sustained_rest(s, 1.5, 3)


ISLAND_SQL = """s as (select gauge, t, q1>8 as act from series), n as (select *, row_number() over (partition by gauge order by t)-row_number() over (partition by gauge, act order by t) as g from s),
i as (select gauge, g, min(t) as first, max(t) as last, max(t)-min(t) as extent, count(*) as rows from n where act group by gauge, g)"""


@query("longest_island", "with " + ISLAND_SQL + " select gauge, first, last, extent, rows from (select *, row_number() over (partition by gauge order by extent desc, last desc) as r from i) where r=1")
def _(fx):
    return W.longest_island(fx.series, ["gauge"], "t", F.col("q1") > 8)


@query("last_island", "with " + ISLAND_SQL + " select gauge, first, last, extent, rows from (select *, row_number() over (partition by gauge order by last desc) as r from i) where r=1")
def _(fx):
    return W.longest_island(fx.series, ["gauge"], "t", F.col("q1") > 8, pick="last")


@query("increasing_report", """with p as (select gauge, t2 as t, lag(t2) over (partition by gauge order by sample_no) as prev from (select *, case when sample_no%11=0 then t-500 else t end as t2 from series)) select gauge, count(*) filter (t<=prev) as violations from p group by gauge""")
def _(fx):
    s = fx.series.withColumn("t", F.when(F.col("sample_no") % 11 == 0, F.col("t") - 500).otherwise(F.col("t")))
    return W.increasing_report(s, ["gauge"], ["sample_no"])


@query("backfill", """select storm, row_no, first_value(nullif(vmax,0) ignore nulls) over w as vmax, first_value(case when row_no%5=0 then mslp end ignore nulls) over w as mslp from tracks window w as (partition by storm order by row_no rows between current row and unbounded following)""")
def _(fx):
    t = fx.tracks.select("storm", "row_no", F.expr("nullif(vmax, 0)").alias("vmax"), F.when(F.col("row_no") % 5 == 0, F.col("mslp")).alias("mslp"))
    return W.backfill(t, ["vmax", "mslp"], ["storm"], ["row_no"])


@query("landfall_offset", "select storm, coalesce(max(row_no) filter (event='L'), max(row_no)) as \"offset\" from tracks group by storm")
def _(fx):
    return W.landfall_offset(fx.tracks, "row_no")


@query("rank_candidates", "with " + SCORE_SQL + """ select "case", model as candidate, area as normalized_median_rmse, peak as normalized_median_support, mass as normalized_median_pattern, cast(row_number() over (partition by "case" order by area, peak, mass, model) as int) as rank from sc""")
def _(fx):
    s = scores(fx).select("case", F.col("model").alias("candidate"), F.col("area").alias("normalized_median_rmse"), F.col("peak").alias("normalized_median_support"), F.col("mass").alias("normalized_median_pattern"))
    return W.rank_candidates(s)


@query("dense_rates", "with " + RATES_SQL + """, c as (select distinct run, target_x, target_y from r), tt as (select distinct run, t from r)
select c.run, tt.t, c.target_x, c.target_y, round(coalesce(q,0),6) as q, round(coalesce(qu,0),6) as qu, round(coalesce(qv,0),6) as qv from c join tt on tt.run=c.run left join r on r.run=c.run and r.t=tt.t and r.target_x=c.target_x and r.target_y=c.target_y""")
def _(fx):
    out = B.dense_rates(A.source_rates(face_samples(fx), 0.5))
    return out.withColumns({c: F.round(c, 6) for c in ("q", "qu", "qv")})


CONFIG_SQL = """k as (select p_partkey as run, p_brand as a, p_type as b, p_size as s from part),
cf as (select run, 'rheology.model' as key, a as value from k union all select run, 'rheology.mu', cast(s as varchar) from k where s%3<>0 union all select run, 'output.format', b from k where s%4<>0 union all select run, 'extra.note', a from k where s%5=0)"""


def config_json(fx):
    """Nested run settings as JSON text, derived from the parts table."""
    s = F.col("p_size")
    conf = F.to_json(F.struct(
        F.struct(F.col("p_brand").alias("model"), F.when(s % 3 != 0, s.cast("string")).alias("mu")).alias("rheology"),
        F.when(s % 4 != 0, F.struct(F.col("p_type").alias("format"))).alias("output"),
        F.when(s % 5 == 0, F.struct(F.col("p_brand").alias("note"))).alias("extra"),
    ))
    return fx.table("part").select(F.col("p_partkey").alias("run"), conf.alias("conf"))


@query("flatten_config", "with " + CONFIG_SQL + " select * from cf")
def _(fx):
    return B.flatten_config(config_json(fx))


@query("config_keys_diff", "with " + CONFIG_SQL + """ select k.run, r.key, 'missing' as issue from k cross join (values ('rheology.model'),('rheology.mu'),('output.format')) r(key) where not exists (select 1 from cf where cf.run=k.run and cf.key=r.key)
union all select run, key, 'extra' from cf where key='extra.note'""")
def _(fx):
    return B.config_keys_diff(B.flatten_config(config_json(fx)), ["rheology.model", "rheology.mu", "output.format"])


@query("config_diff", """with c as (select p_partkey%97 as key, max(p_brand) filter (p_partkey%2=0) as base, max(p_brand) filter (p_partkey%2=1 and p_size%4<>0) as other from part group by 1) select cast(key as varchar) as key, base, other from c where base is distinct from other""")
def _(fx):
    k = F.col("p_partkey")
    c = fx.table("part").where((k % 2 == 0) | (F.col("p_size") % 4 != 0)).groupBy((k % 2).alias("run"), (k % 97).cast("string").alias("key")).agg(F.max("p_brand").alias("value"))
    return B.config_diff(c, F.col("run") == 0, F.col("run") == 1)


@query("merge_config", """select p_partkey as run, p_brand as model, case when p_size%3=0 then '0.2' else cast(p_size as varchar) end as mu, '0.05' as depth, p_type as note from part""")
def _(fx):
    s = F.col("p_size")
    template = F.create_map(F.lit("model"), F.lit("none"), F.lit("mu"), F.lit("0.2"), F.lit("note"), F.col("p_type"))
    over = F.create_map(F.lit("model"), F.col("p_brand"), F.lit("mu"), F.when(s % 3 != 0, s.cast("string")), F.lit("note"), F.lit("ignored"))
    m = B.merge_config(template, over, ["model", "mu"], {"depth": "0.05", "mu": "9"})
    return fx.table("part").select(F.col("p_partkey").alias("run"), *[m[c].alias(c) for c in ("model", "mu", "depth", "note")])


@query("validate_table", "with " + SCORE_SQL + """, t as (select "case", case when model='m9' then null else model end as model, case when model='m2' then -mass else mass end as mass, peak from sc union all select "case", model, mass, peak from sc where model='m1'),
e as (select distinct "case", concat('m', g) as model from sc cross join (select unnest(generate_series(0,10)) as g) where concat('m', g)<>'m0')
select 'key is NULL' as issue, "case" as key, count(*) as n from t where model is null group by "case"
union all select 'key is repeated', concat_ws('/', "case", model), count(*) from t group by "case", model having count(*)>1
union all select 'mass is missing, not finite or negative', concat_ws('/', "case", model), count(*) from t where mass<0 group by "case", model
union all select 'row count of case', "case", count(*) from t group by "case" having count(*)<>10
union all select 'key is absent', concat_ws('/', "case", model), 1 from (select "case", model from e except select "case", model from t)
union all select 'key is not expected', concat_ws('/', "case", model), 1 from (select "case", model from t except select "case", model from e)""")
def _(fx):
    s = scores(fx)
    t = s.withColumns({"model": F.when(F.col("model") != "m9", F.col("model")), "mass": F.when(F.col("model") == "m2", -F.col("mass")).otherwise(F.col("mass"))})
    t = t.unionByName(s.where("model = 'm1'"))
    e = s.select("case").distinct().withColumn("model", F.explode(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.concat(F.lit("m"), k.cast("string")))))
    return B.validate_table(t, ["case", "model"], ["mass", "peak"], per_case=10, expected=e)


@query("single_cohort", "select p_size as label, count(distinct (p_brand, p_type)) as identities, count(distinct (p_brand, p_type))=1 as single from part group by p_size")
def _(fx):
    return B.single_cohort(fx.table("part").withColumnRenamed("p_size", "label"), "label", ["p_brand", "p_type"])


@query("first_violation", "with h as (select cast(o_custkey as int) as run, o_orderkey as line_no, floor(o_totalprice) as volume from orders where o_totalprice>300000) select run, min(line_no) as line_no, arg_min(volume, line_no) as volume from h group by run")
def _(fx):
    h = fx.table("orders").select(F.col("o_custkey").cast("int").alias("run"), F.col("o_orderkey").alias("line_no"), F.floor("o_totalprice").cast("double").alias("volume"), "o_totalprice")
    return B.first_violation(h, F.col("o_totalprice") > 300000, "line_no", ["volume"])


@query("latest_runs", "select o_orderkey as run, o_orderdate as created, 'completed' as status from orders where o_orderstatus='F' order by o_orderdate desc, o_orderkey limit 25")
def _(fx):
    r = fx.table("orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").cast("timestamp_ntz").alias("created"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"))
    return B.latest_runs(r, 25)


@query("top_cells", "select run, frame, i, j, h, cast(rank as int) as rank from (select run, frame, i, j, h, row_number() over (partition by run, frame order by h desc, j, i) as rank from frames) where rank<=5")
def _(fx):
    return B.top_cells(fx.frames.select("run", "frame", "i", "j", "h"), 5, "h")


@query("parse_mass_lines", "select run, line_no, 0 as pos, line_no*1e0 as t, regexp_extract(text, 'mass = ([0-9]+)', 1)::double as volume, 0e0 as diff from log")
def _(fx):
    return G.parse_mass_lines(fx.log)


@query("log_volume_summary", """with h as (select run, line_no*1e0 as t, regexp_extract(text, 'mass = ([0-9]+)', 1)::double as volume from log),
f as (select run, min_by(volume, t) as initial, max_by(volume, t) as final, max(t) as final_t, min(volume) as lowest, max(volume) as highest, count(*) as samples from h group by run)
select *, greatest(initial-final,0) as escaped, case when initial>0 then 100*(greatest(initial-final,0)/initial) else 0 end as escaped_percent, case when initial>0 then greatest(initial-final,0)/initial>1e-3 else false end as warning from f""")
def _(fx):
    return A.volume_summary(G.parse_mass_lines(fx.log))


def log_texts(fx):
    """Stability texts of every order: warnings, some wrapped over two lines, rejected trials and maxima."""
    k = F.col("o_orderkey")
    m = k % 7
    number = (0.5 + k % 40 * F.lit(0.025)).cast("decimal(6,3)").cast("string")
    warn = F.concat(
        F.lit("WARNING Courant number  = "), number, F.when(m == 1, " is larger than\n input cfl_max = ").otherwise(" is larger than input cfl_max = "),
        F.lit("1.0 on grid "), (k % 5).cast("string"), F.lit(" level 2"),
    )
    trial = F.concat(F.lit("SOLVER: rejected CFL trial level 3 CFL = "), (k % 9).cast("string"), F.lit(".5D-01 cfl_max = 1.0"))
    seen = F.concat(F.lit("maximum Courant number seen = "), number)
    text = F.when(m < 3, warn).when(m < 5, F.concat_ws("\n", trial, trial)).otherwise(seen)
    return fx.table("orders").select(F.col("o_custkey").alias("run"), F.when(k % 2 == 0, "log").otherwise("amr").alias("source"), k.alias("part"), text.alias("text"))


@query("log_diagnostics", """with o as (select o_custkey as run, o_orderkey%2 as src, o_orderkey as part, o_orderkey%7 as m, cast(0.5e0+(o_orderkey%40)*0.025e0 as decimal(6,3)) as c, o_orderkey%9 as q, o_orderkey%5 as g from orders),
w as (select run, c, src, count(*) n from o where m<3 group by all), w2 as (select run, sum(n) as n from (select run, c, max(n) n from w group by all) group by run),
vi as (select run, max(n) as n from (select run, src, count(*) n from o where m<3 group by all) group by run),
rj as (select run, max(n) as n from (select run, src, count(*)*2 n from o where m in (3,4) group by all) group by run),
d as (select run, max(c) filter (m in (0,2)) as mv, max(q+0.5) filter (m in (3,4)) as mr, max(c) filter (m>=5 and src=1) as mc,
 min(src*1000000000+part) filter (m in (0,2)) as fk from (select * replace (src as src) from o) group by run)
select d.run, {VIOL} as violations, cast(coalesce(rj.n,0) as bigint) as rejections, cast(mv as double) as max_violating, cast(f.c as double) as first_courant, cast(f.g as int) as first_grid, case when f.g is not null then 2 end as first_level, round(cast(mr as double)/10,9) as max_rejected, cast(mc as double) as max_courant
from d left join vi on vi.run=d.run left join rj on rj.run=d.run left join o f on f.run=d.run and f.m in (0,2) and f.src*1000000000+f.part=d.fk""".replace("{VIOL}", "cast(coalesce((select n from w2 where w2.run=d.run),0) as bigint)"))
def _(fx):
    out = G.log_diagnostics(log_texts(fx))
    return out.withColumn("max_rejected", F.round("max_rejected", 9))


@query("fatal_reason", """select c_custkey as run, case when c_custkey%3=0 then 'SOLUTION ERROR' when c_custkey%5=0 then 'Too many dt reductions' end as reason from customer""")
def _(fx):
    k = F.col("c_custkey")
    text = F.concat(F.when(k % 5 == 0, "x Too many dt reductions\n").otherwise("ok\n"), F.when(k % 3 == 0, "** SOLUTION ERROR **").otherwise("done"))
    return fx.table("customer").select(k.alias("run"), G.fatal_reason(text).alias("reason"))


@query("names_from_files", """select p_partkey, case when p_size%2=0 then concat('mod', p_partkey) else cast(p_partkey as varchar) end as model, case when p_size%3=0 then cast(p_partkey as int) end as frame from part""")
def _(fx):
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.lit("sim_"), F.when(s % 2 == 0, F.concat(F.lit("null_mod"), k.cast("string"))).otherwise(k.cast("string")), F.lit(".asc"))
    file = F.when(s % 3 == 0, F.concat(F.lit("fgout0001.q"), F.format_string("%06d", k))).otherwise(F.concat(F.lit("fort.amr"), k.cast("string")))
    return fx.table("part").select(k, B.model_from_filename(name).alias("model"), B.frame_from_filename(file).alias("frame"))


@query("civil_time", """select event_id, coalesce(case when event_id%3=0 then timestamp '2024-03-01 10:00:00' end, case when event_id%2=0 then timestamp '2024-02-29 23:30:00' end, timestamp '2020-01-01 00:00:00')+to_milliseconds(cast(round(event_id*0.25*1000) as bigint)) as at from events""")
def _(fx):
    e = F.col("event_id")
    explicit = F.when(e % 3 == 0, "2024-03-01T12:00:00+02:00").otherwise("not set")
    created = F.when(e % 2 == 0, "2024-02-29T23:30:00Z")
    at = B.civil_time(e * 0.25, explicit, created, F.lit("2020-01-01T00:00:00Z"))
    return fx.table("events").select(e, at.cast("timestamp_ntz").alias("at"))


@query("fingerprint", """with f as (select l_suppkey as run, sha256(concat_ws(':', concat('f', l_orderkey, '_', l_linenumber), cast(cast(l_quantity as bigint) as varchar), cast(l_partkey as varchar))) as s from lineitem),
p as (select run, count(*) as files, cast(sum(('0x'||s[1:12])::bigint) as varchar) as a, cast(sum(('0x'||s[13:24])::bigint) as varchar) as b, cast(sum(('0x'||s[25:36])::bigint) as varchar) as c, cast(sum(('0x'||s[37:48])::bigint) as varchar) as d from f group by run)
select run, files, sha256(concat_ws('-', cast(files as varchar), a, b, c, d)) as fingerprint from p""")
def _(fx):
    li = fx.table("lineitem").select(
        F.col("l_suppkey").alias("run"), F.concat(F.lit("f"), "l_orderkey", F.lit("_"), "l_linenumber").alias("name"),
        F.col("l_quantity").cast("long").alias("size"), F.col("l_partkey").alias("mtime"),
    )
    return B.fingerprint(li)


@query("great_circle_samples", """with p as (select s_suppkey as pair, -170+(s_suppkey%30)*10e0 as lon0, -40+(s_suppkey%9)*10e0 as lat0, -165+(s_suppkey%17)*20e0+3 as lon1, -30+(s_suppkey%7)*10e0 as lat1 from supplier),
d as (select *, 2*asin(sqrt(pow(sin(radians(lat1-lat0)/2),2)+cos(radians(lat0))*cos(radians(lat1))*pow(sin(radians(lon1-lon0)/2),2))) as d from p),
k as (select *, unnest(generate_series(0,8)) as k from d), w as (select *, case when d>0 then sin((1-k/8e0)*d)/sin(d) else 1-k/8e0 end as wa, case when d>0 then sin(k/8e0*d)/sin(d) else k/8e0 end as wb from k),
c as (select *, wa*cos(radians(lat0))*cos(radians(lon0))+wb*cos(radians(lat1))*cos(radians(lon1)) as x, wa*cos(radians(lat0))*sin(radians(lon0))+wb*cos(radians(lat1))*sin(radians(lon1)) as y, wa*sin(radians(lat0))+wb*sin(radians(lat1)) as z from w),
l as (select *, degrees(atan2(y,x)) as lon from c)
select pair, cast(k as int) as k, round(lon-360*floor((lon-lon0+180)/360),6) as lon, round(degrees(atan2(z,sqrt(x*x+y*y))),6) as lat from l""")
def _(fx):
    k = F.col("s_suppkey")
    p = fx.table("supplier").select(
        k.alias("pair"), (-170 + k % 30 * F.lit(10.0)).alias("lon0"), (-40 + k % 9 * F.lit(10.0)).alias("lat0"),
        (-165 + k % 17 * F.lit(20.0) + 3).alias("lon1"), (-30 + k % 7 * F.lit(10.0)).alias("lat1"),
    )
    out = B.great_circle_samples(p, 9)
    return out.withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6)})
