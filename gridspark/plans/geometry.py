"""Queries for polygons, neighbourhoods, scattered points, mosaics and regions."""

from pyspark.sql import functions as F

from gridspark.functions import Geometry
from gridspark.operators import geometry as P
from gridspark.operators import regions as R
from gridspark.plans.filters import polygons
from gridspark.plans.fixtures import FRAME_GRID
from gridspark.plans.registry import query

EDGE_SQL = """ring as (select * from (values (1,0,[8.3e0,30.6e0,30.6e0,19.4e0,8.3e0],[6.2e0,6.2e0,20.7e0,13.3e0,20.7e0]),
 (2,0,[35.2e0,55.8e0,55.8e0,35.2e0],[10.4e0,10.4e0,40.6e0,40.6e0]), (2,1,[40.3e0,50.7e0,50.7e0,40.3e0],[15.2e0,15.2e0,30.9e0,30.9e0])) r(pid,ring,xs,ys)),
vx as (select pid, ring, len(xs) as n, unnest(xs) as x, unnest(ys) as y, generate_subscripts(xs,1) as k from ring),
edge as (select a.pid, a.ring, a.x as x0, a.y as y0, b.x as x1, b.y as y1 from vx a join vx b on b.pid=a.pid and b.ring=a.ring and b.k=case when a.k=a.n then 1 else a.k+1 end)"""
GRID_SQL = "gc as (select distinct i, j, x, y from cells)"


def inside_sql(pts: str) -> str:
    """Parts giving `ins(px, py, inside)`: points in an exterior and none of its holes."""
    return f"""cr as (select p.px, p.py, e.pid, e.ring, count(*)%2=1 as odd from {pts} p join edge e on ((e.y0<=p.py and p.py<e.y1) or (e.y1<=p.py and p.py<e.y0)) and e.x0+(p.py-e.y0)*(e.x1-e.x0)/(e.y1-e.y0)>p.px group by all),
pp as (select px, py, pid, bool_or(odd) filter (ring=0) as ext, coalesce(bool_or(odd) filter (ring>0), false) as hole from cr group by all),
ins as (select px, py, bool_or(coalesce(ext,false) and not hole) as inside from pp group by all)"""


@query("points_in_polygons", "with " + EDGE_SQL + ", " + GRID_SQL + ", pt as (select x as px, y as py from gc), " + inside_sql("pt") +
       " select c.run, c.i, c.j, coalesce(ins.inside, false) as inside from cells c left join ins on ins.px=c.x and ins.py=c.y")
def _(fx):
    return P.points_in_polygons(fx.cells, polygons(fx.spark), FRAME_GRID).select("run", "i", "j", "inside")


TOUCH_SQL = """cl as (select gc.i, gc.j, e.x0, e.y0, e.x1-e.x0 as dx, e.y1-e.y0 as dy, gc.x-0.5 as bx0, gc.x+0.5 as bx1, gc.y-0.5 as by0, gc.y+0.5 as by1 from gc cross join edge e),
cx as (select *, case when dx=0 then case when x0 between bx0 and bx1 then 0 else 2 end else least((bx0-x0)/dx,(bx1-x0)/dx) end as tx0, case when dx=0 then 1 else greatest((bx0-x0)/dx,(bx1-x0)/dx) end as tx1,
 case when dy=0 then case when y0 between by0 and by1 then 0 else 2 end else least((by0-y0)/dy,(by1-y0)/dy) end as ty0, case when dy=0 then 1 else greatest((by0-y0)/dy,(by1-y0)/dy) end as ty1 from cl),
touched as (select distinct i, j from cx where greatest(0,tx0,ty0)<=least(1,tx1,ty1))"""


@query("boundary_cells", "with " + EDGE_SQL + ", " + GRID_SQL + ", " + TOUCH_SQL + " select c.run, c.i, c.j, c.z from cells c join touched t on t.i=c.i and t.j=c.j")
def _(fx):
    return fx.cells.select("run", "i", "j", "z").join(P.boundary_cells(polygons(fx.spark), FRAME_GRID), ["i", "j"])


@query("polygon_coverage", "with " + EDGE_SQL + ", " + GRID_SQL + ", ss as (select unnest(generate_series(0,63)) as s), pt as (select i, j, x-0.5+(a.s+0.5e0)/64 as px, y-0.5+(b.s+0.5e0)/64 as py from gc cross join ss a cross join ss b), " + inside_sql("pt") +
       ", cov as (select pt.i, pt.j, count(*) filter (ins.inside)/4096e0 as coverage from pt join ins on ins.px=pt.px and ins.py=pt.py group by pt.i, pt.j) select c.run, c.i, c.j, coalesce(cov.coverage,0) as coverage from cells c left join cov on cov.i=c.i and cov.j=c.j")
def _(fx):
    cov = P.polygon_coverage(polygons(fx.spark), FRAME_GRID)
    return fx.cells.select("run", "i", "j").join(cov, ["i", "j"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


@query("touched_union", "with " + EDGE_SQL + ", " + GRID_SQL + ", " + TOUCH_SQL + " select run, count(*) as cells, sum(z) as total from cells c join touched t on t.i=c.i and t.j=c.j group by run")
def _(fx):
    from gridspark.plans.filters import RINGS

    layers = [polygons(fx.spark, [r]) for r in RINGS]
    return fx.cells.join(P.touched_union(layers, FRAME_GRID), ["i", "j"]).groupBy("run").agg(F.count("*").alias("cells"), F.sum("z").alias("total"))


@query("shoreline_faces", """with m as (select run, frame, i, j from frames where h>0.125)
select m.run, m.frame, m.i+0.5e0 as target_x, m.j+0.5e0 as target_y, m.i+0.5e0+di*0.5 as face_x, m.j+0.5e0+dj*0.5 as face_y, nx, ny, 1e0 as length from m cross join (values (-1,0,1e0,0e0),(1,0,-1e0,0e0),(0,-1,0e0,1e0),(0,1,0e0,-1e0)) d(di,dj,nx,ny)
where not exists (select 1 from m o where o.run=m.run and o.frame=m.frame and o.i=m.i+di and o.j=m.j+dj)""")
def _(fx):
    return P.shoreline_faces(fx.frames.where("h > 0.125").select("run", "frame", "i", "j"), FRAME_GRID)


SCATTER_SQL = """sc as (select event_id as pid, (event_id*37%1600)*0.04e0 as x, (event_id*91%1250)*0.04e0 as y, value as z, event_type as kind from events),
dat as (select * from sc where kind in ('purchase','error')), fil as (select * from sc where kind in ('view','click'))"""


def scattered(fx):
    e = F.col("event_id")
    return fx.table("events").select(
        e.alias("pid"), (e * 37 % 1600 * F.lit(0.04)).alias("x"), (e * 91 % 1250 * F.lit(0.04)).alias("y"), F.col("value").alias("z"), F.col("event_type").alias("kind")
    )


DATA, FILL = "kind in ('purchase', 'error')", "kind in ('view', 'click')"


@query("within_radius", "with " + SCATTER_SQL + " select pid, x, y, z from fil f where exists (select 1 from dat d where sqrt((f.x-d.x)*(f.x-d.x)+(f.y-d.y)*(f.y-d.y))<0.5)")
def _(fx):
    s = scattered(fx)
    return P.within_radius(s.where(FILL).select("pid", "x", "y", "z"), s.where(DATA), 0.5)


@query("blend_fill", "with " + SCATTER_SQL + """ select x, y, z, 'data' as origin from dat union all select x, y, z, 'fill' from fil f where x between 10 and 50 and y between 5 and 45 and not exists (select 1 from dat d where sqrt((f.x-d.x)*(f.x-d.x)+(f.y-d.y)*(f.y-d.y))<0.5)""")
def _(fx):
    s = scattered(fx)
    return P.blend_fill(s.where(DATA), s.where(FILL), (10.0, 50.0, 5.0, 45.0), 0.5)


@query("nearest_point", "with " + SCATTER_SQL + """, n as (select distinct x+0.015625 as x, y+0.03125 as y from cells),
b as (select n.x, n.y, d.z, d.pid, row_number() over (partition by n.x, n.y order by (n.x-d.x)*(n.x-d.x)+(n.y-d.y)*(n.y-d.y), d.pid) as r from n join dat d on abs(n.x-d.x)<=8 and abs(n.y-d.y)<=8)
select x, y, z, pid from b where r=1""")
def _(fx):
    nodes = fx.cells.select((F.col("x") + 0.015625).alias("x"), (F.col("y") + 0.03125).alias("y")).distinct()
    return P.nearest_point(nodes, scattered(fx).where(DATA), 0.5)


LINE = [(2.0, 48.0), (20.0, 30.0), (20.0, 30.0), (44.0, 12.0), (62.0, 3.0)]
LINE_SQL = """sg as (select * from (values (0,2e0,48e0,18e0,-18e0,0e0),(1,20e0,30e0,24e0,-18e0,sqrt(648e0)),(2,44e0,12e0,18e0,-9e0,sqrt(648e0)+30)) s(k,x0,y0,vx,vy,c)),
sl as (select *, sqrt(vx*vx+vy*vy) as len from sg), q as (select distinct x, y from cells),
pr as (select q.x, q.y, k, c, len, greatest(0,least(1,((q.x-x0)*vx+(q.y-y0)*vy)/(len*len))) as f, x0, y0, vx, vy from q cross join sl),
al as (select x, y, arg_min(c+f*len, row_key) as along from (select *, (x-x0-f*vx)*(x-x0-f*vx)+(y-y0-f*vy)*(y-y0-f*vy)+k*1e-9 as row_key from pr) group by x, y)"""


@query("project_to_line", "with " + LINE_SQL + " select run, i, j, round(along,6) as along from cells c join al on al.x=c.x and al.y=c.y")
def _(fx):
    return P.project_to_line(fx.cells, LINE).select("run", "i", "j", F.round("along", 6).alias("along"))


@query("runout", "with " + LINE_SQL + """, e as (select "case", model, i+0.5e0 as x, j+0.5e0 as y, v from ensemble), t as (select unnest([0.0625e0,0.125e0,0.25e0,99e0]) as threshold), m as (select distinct "case", model from ensemble)
select m."case", m.model, threshold, round(coalesce((select max(along) from e join al on al.x=e.x and al.y=e.y where e."case"=m."case" and e.model=m.model and e.v>threshold),0),6) as runout from m cross join t""")
def _(fx):
    e = fx.ensemble.withColumns({"x": F.col("i") + F.lit(0.5), "y": F.col("j") + F.lit(0.5)})
    return P.runout(e, LINE, [0.0625, 0.125, 0.25, 99.0]).withColumn("runout", F.round("runout", 6))


@query("smooth", """select c.run, c.i, c.j, case when (c.i+c.j)%3=0 then (select avg(o.z) from cells o where o.run=c.run and abs(o.i-c.i)<=2 and abs(o.j-c.j)<=2) else c.z end as z from cells c""")
def _(fx):
    hit = (F.col("i") + F.col("j")) % 3 == 0
    return P.smooth(fx.cells, hit, 2, tile=16).select("run", "i", "j", "z")


HOLES_SQL = "hc as (select run, i, j, case when i between 20 and 34 and j between 10 and 22 then null else z end as z from cells)"


@query("fill_missing", "with " + HOLES_SQL + """, m as (select * from hc where z is null), v as (select * from hc where z is not null),
d as (select m.run, m.i, m.j, min(greatest(abs(v.i-m.i),abs(v.j-m.j))) as r from m join v on v.run=m.run and abs(v.i-m.i)<=10 and abs(v.j-m.j)<=10 group by all),
f as (select d.run, d.i, d.j, avg(v.z) as z from d join v on v.run=d.run and abs(v.i-d.i)<=d.r and abs(v.j-d.j)<=d.r group by all)
select hc.run, hc.i, hc.j, coalesce(hc.z, f.z) as z from hc left join f on f.run=hc.run and f.i=hc.i and f.j=hc.j""")
def _(fx):
    gap = F.col("i").between(20, 34) & F.col("j").between(10, 22)
    c = fx.cells.select("run", "i", "j", F.when(~gap, F.col("z")).alias("z"))
    return P.fill_missing(c)


@query("ruled_cover", """with s as (select run, frame, x-0.5 as s, min(y)-0.5 as lower, max(y)+0.5 as upper from frames where h>0.25 group by run, frame, x) select * from s union all select run, frame, max(s)+1, arg_max(lower, s), arg_max(upper, s) from s group by run, frame""")
def _(fx):
    return P.ruled_cover(fx.frames, F.col("h") > 0.25, "x")


def patch_sources(fx):
    geo = fx.patches.drop("t", "level", "mx", "my")
    return fx.patch_cells.join(geo, ["run", "frame", "patch"]).select(
        "run", "frame", F.col("patch").alias("source"), (F.col("xlow") + (F.col("i") + 0.5) * F.col("dx")).alias("x"),
        (F.col("ylow") + (F.col("j") + 0.5) * F.col("dy")).alias("y"), "dx", "dy", F.when(F.col("h") > 0, F.col("h")).alias("z"),
    )


@query("mosaic", """with t as (select gi.g as i, gj.g as j, 0.25+gi.g*0.5+0.25 as x, 0.25+gj.g*0.5+0.25 as y from (select unnest(generate_series(0,126)) as g) gi cross join (select unnest(generate_series(0,98)) as g) gj),
c as (select p.run, p.frame, t.i, t.j, p.h as z, p.patch, row_number() over (partition by p.run, p.frame, t.i, t.j order by case when p.h>0 then 0 else 1 end, p.dx*p.dy) as rk from t join pcx p on t.x>=p.x-p.dx/2 and t.x<p.x+p.dx/2 and t.y>=p.y-p.dy/2 and t.y<p.y+p.dy/2)
select run, frame, cast(i as int) as i, cast(j as int) as j, case when z>0 then z end as z, case when z>0 then patch end as source from c where rk=1""")
def _(fx):
    return P.mosaic(patch_sources(fx), Geometry(0.25, 0.25, 0.5, 0.5, 127, 99))


SEED_SQL = "sd as (select run, min(j*100000+i) as k from cells where z<6 and i>20 and j>25 group by run)"


def seeds(fx):
    """One low cell per run away from the grid's corner."""
    low = fx.cells.where("z < 6 and i > 20 and j > 25")
    return low.groupBy("run").agg(F.min(F.struct("j", "i")).alias("s")).select("run", F.col("s.i").alias("i"), F.col("s.j").alias("j"))


FLOOD_SQL = """reach(run, i, j) as (select run, i, j from {START} union select e.run, e.i, e.j from reach r join el e on e.run=r.run and abs(e.i-r.i)+abs(e.j-r.j)=1)"""


@query("connected_region", "with el as (select run, i, j, z from cells where z<=8.0), " + SEED_SQL + ", st as (select el.run, el.i, el.j from el join sd on sd.run=el.run and sd.k=el.j*100000+el.i), "
       + FLOOD_SQL.replace("{START}", "st") + " select el.run, el.i, el.j, el.z from reach r join el on el.run=r.run and el.i=r.i and el.j=r.j")
def _(fx):
    return R.connected_region(fx.cells, seeds(fx), 8.0, errors="ignore").select("run", "i", "j", "z")


@query("connected_region_issues", "with el as (select run, i, j, z from cells where z<=5.5), " + SEED_SQL + ", st as (select el.run, el.i, el.j from el join sd on sd.run=el.run and sd.k=el.j*100000+el.i), "
       + FLOOD_SQL.replace("{START}", "st") + """ select distinct run, 'region reaches the edge' as issue from reach where i in (0,63) or j in (0,49)
 union all select run, 'seed above the level' from sd where not exists (select 1 from st where st.run=sd.run)""")
def _(fx):
    return R.connected_region(fx.cells, seeds(fx), 5.5, fx.grids, errors="report")


@query("flood_select", "with el as (select run, i, j from cells where z<9 and (i+j)%7<>0), st as (select run, i, j from cells where z<2.5 and (i+j)%7<>0), "
       + FLOOD_SQL.replace("{START}", "st") + " select c.run, c.i, c.j, r.i is not null as chosen from cells c left join reach r on r.run=c.run and r.i=c.i and r.j=c.j")
def _(fx):
    return R.flood_select(fx.cells, 2.5, 9.0, mask=(F.col("i") + F.col("j")) % 7 == 0).select("run", "i", "j", "chosen")


@query("flood_select_down", "with el as (select run, i, j from cells where z>10), st as (select run, i, j from cells where z>16), "
       + FLOOD_SQL.replace("{START}", "st") + " select c.run, c.i, c.j, r.i is not null as chosen from cells c left join reach r on r.run=c.run and r.i=c.i and r.j=c.j")
def _(fx):
    return R.flood_select(fx.cells, 16.0, 10.0).select("run", "i", "j", "chosen")


@query("flood_select_steps", """with el as (select run, i, j from cells where z<9), st as (select run, i, j from cells where (i*5+j*3)%61=0),
reach(run, i, j, n) as (select run, i, j, 0 from st union select e.run, e.i, e.j, r.n+1 from reach r join el e on e.run=r.run and abs(e.i-r.i)+abs(e.j-r.j)=1 where r.n<3)
select c.run, c.i, c.j, r.i is not null as chosen from cells c left join (select distinct run, i, j from reach) r on r.run=c.run and r.i=c.i and r.j=c.j""")
def _(fx):
    prev = (F.col("i") * 5 + F.col("j") * 3) % 61 == 0
    return R.flood_select(fx.cells, 0.0, 9.0, previous=prev, max_iters=3).select("run", "i", "j", "chosen")


def regions_sql(links: str) -> str:
    return f"""with el as (select run, i, j, cast(j as bigint)*4294967296+i as k from cells where z>9 and (i*11+j*7)%5<>0),
lb(run, i, j, k) as (select run, i, j, k from el union select e.run, e.i, e.j, r.k from lb r join el e on e.run=r.run and {links}),
m as (select run, i, j, min(k) as label from lb group by run, i, j),
s as (select m.run, m.i, m.j, count(*) as n from m cross join (values (-1,0),(1,0),(0,-1),(0,1)) d(di,dj) where not exists (select 1 from el o where o.run=m.run and o.i=m.i+di and o.j=m.j+dj) group by all)
select m.run, label, count(*) as cells, min(m.i) as i0, max(m.i) as i1, min(m.j) as j0, max(m.j) as j1, cast(coalesce(sum(n),0) as bigint) as sides from m left join s on s.run=m.run and s.i=m.i and s.j=m.j group by m.run, label"""


def speckled(fx):
    return fx.cells.where("z > 9 and (i * 11 + j * 7) % 5 <> 0").select("run", "i", "j")


@query("label_regions", regions_sql("abs(e.i-r.i)+abs(e.j-r.j)=1"))
def _(fx):
    return R.label_regions(speckled(fx), FRAME_GRID)


@query("label_regions_diagonal", regions_sql("abs(e.i-r.i)<=1 and abs(e.j-r.j)<=1"))
def _(fx):
    return R.label_regions(speckled(fx), FRAME_GRID, conn=8)


@query("region_edges", regions_sql("abs(e.i-r.i)+abs(e.j-r.j)=1").split("\ns as")[0].rstrip(",").replace("%5<>0", "%5<3") + """
select m.run, label, m.i+0.5e0 as target_x, m.j+0.5e0 as target_y, m.i+0.5e0+di*0.5 as face_x, m.j+0.5e0+dj*0.5 as face_y, nx, ny, 1e0 as length from m cross join (values (-1,0,1e0,0e0),(1,0,-1e0,0e0),(0,-1,0e0,1e0),(0,1,0e0,-1e0)) d(di,dj,nx,ny)
where not exists (select 1 from el o where o.run=m.run and o.i=m.i+di and o.j=m.j+dj)""")
def _(fx):
    # Narrow regions: the SQL's closure grows with the square of a region.
    return R.region_edges(fx.cells.where("z > 9 and (i * 11 + j * 7) % 5 < 3").select("run", "i", "j"), FRAME_GRID)


AVERAGE_SQL = """tg as (select unnest(generate_series(0,16)) as ti), tgy as (select unnest(generate_series(0,17)) as tj), sx as (select unnest(generate_series(0,13)) as a), sy as (select unnest(generate_series(0,9)) as b),
sub as (select ti, tj, 1.0e0+ti*3.5e0+(a+0.5e0)*0.25 as px, 1.0e0+tj*2.5e0+(b+0.5e0)*0.25 as py from tg cross join tgy cross join sx cross join sy),
pick as (select sub.*, g.patch, (px-g.x0)/g.d as fx, (py-g.y0)/g.d as fy from sub join (values (1,0.5e0,0.5e0,1e0),(2,16.25e0,10.25e0,0.5e0)) g(patch,x0,y0,d)
 on (g.patch=2 and px between 16.25 and 47.75 and py between 10.25 and 34.75) or (g.patch=1 and px between 0.5 and 63.5 and py between 0.5 and 49.5 and not (px between 16.25 and 47.75 and py between 10.25 and 34.75))),
w as (select c.run, c.frame, ti, tj, h, (case when c.i=floor(fx) then 1-(fx-floor(fx)) else fx-floor(fx) end)*(case when c.j=floor(fy) then 1-(fy-floor(fy)) else fy-floor(fy) end) as w
 from pick join patch_cells c on c.patch=pick.patch and c.i in (floor(fx),floor(fx)+1) and c.j in (floor(fy),floor(fy)+1))"""


@query("cell_average", "with " + AVERAGE_SQL + " select run, frame, cast(ti as int) as i, cast(tj as int) as j, round(sum(w*h)/sum(w),9) as mean, abs(sum(w)/140-1)<=1e-9 as covered from w group by run, frame, ti, tj")
def _(fx):
    nodes = fx.patch_cells.select("run", "frame", F.col("patch").alias("source"), "i", "j", F.col("h").alias("z"))
    geo = fx.patches.select(
        "run", "frame", F.col("patch").alias("source"), (F.col("xlow") + F.col("dx") / 2).alias("x0"), (F.col("ylow") + F.col("dy") / 2).alias("y0"),
        "dx", "dy", F.col("mx").alias("nx"), F.col("my").alias("ny"),
    )
    return P.cell_average(nodes, geo, Geometry(1.0, 1.0, 3.5, 2.5, 17, 18)).withColumn("mean", F.round("mean", 9))
