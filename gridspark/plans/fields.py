"""Queries for derived fields."""

from pyspark.sql import functions as F

from gridspark.functions import Geometry
from gridspark.operators import fields as O
from gridspark.operators import filters as P
from gridspark.plans.registry import query


def grad_sql(src: str, z: str, by: str, order: int = 1) -> str:
    """Oracle text of `gradient` on unit spacing: a missing neighbour row is an edge, wherever it lies."""

    def one(axis: str, across: str) -> str:
        w = f"over (partition by {by}, {across} order by {axis})"
        lead, lag = f"lead({z}) {w}", f"lag({z}) {w}"
        there = lambda way, k: f"{way}({axis},{k}) {w}={axis}{'+' if way == 'lead' else '-'}{k}"
        first, end = f"{lead}-{z}", f"{z}-{lag}"
        if order == 2:
            first = f"case when {there('lead', 2)} then (-3*{z}+4*{lead}-lead({z},2) {w})/2 else {first} end"
            end = f"case when {there('lag', 2)} then (3*{z}-4*{lag}+lag({z},2) {w})/2 else {end} end"
        return f"case when {there('lag', 1)} and {there('lead', 1)} then ({lead}-{lag})/2 when {there('lead', 1)} then {first} when {there('lag', 1)} then {end} end"

    return f"select *, {one('i', 'j')} as {z}_x, {one('j', 'i')} as {z}_y from {src}"


@query("gradient", "select run, i, j, z_x, z_y from (" + grad_sql("cells", "z", "run") + ")")
def _(fx):
    return O.gradient(fx.cells, "z", tile=16).select("run", "i", "j", "z_x", "z_y")


@query("gradient_second_order", "select run, frame, i, j, b_x, b_y from (" + grad_sql("frames", "b", "run, frame", 2) + ")")
def _(fx):
    return O.gradient(fx.frames, "b", edge_order=2).select("run", "frame", "i", "j", "b_x", "b_y")


@query("slope_terms", "select run, i, j, round(sqrt(z_x*z_x+z_y*z_y),6) as slope, round(degrees(atan(sqrt(z_x*z_x+z_y*z_y))),6) as angle, "
       "round(1/sqrt(1+z_x*z_x+z_y*z_y),6) as cosine from (" + grad_sql("cells", "z", "run") + ")")
def _(fx):
    return O.slope_terms(fx.cells).select("run", "i", "j", *[F.round(c, 6).alias(c) for c in ("slope", "angle", "cosine")])


SPEED_SQL = "g as (" + grad_sql("frames", "b", "run, frame", 2) + """),
sp as (select *, case when h>=0.001 then h else 0 end as depth, case when h>=0.05 then hu/h else 0 end as u, case when h>=0.05 then hv/h else 0 end as v from g),
speeds as (select *, case when h>=0.05 then sqrt(u*u+v*v+(u*b_x+v*b_y)*(u*b_x+v*b_y)) else 0 end as speed from sp)"""


@query("tangent_speed", "with " + SPEED_SQL + " select run, frame, i, j, speed from speeds")
def _(fx):
    return O.tangent_speed(P.wet_mask(fx.frames)).select("run", "frame", "i", "j", "speed")


@query("desingularised_velocity", """select run, frame, i, j,
 round(case when h>0.05 then sqrt(2e0)*h*hu/sqrt(h*h*h*h+greatest(h*h*h*h, 0.0016e0)) else 0 end,6) as u,
 round(case when h>0.05 then sqrt(2e0)*h*hv/sqrt(h*h*h*h+greatest(h*h*h*h, 0.0016e0)) else 0 end,6) as v from frames""")
def _(fx):
    return O.desingularised_velocity(fx.frames, 0.05).select(
        "run", "frame", "i", "j", F.round("u", 6).alias("u"), F.round("v", 6).alias("v")
    )


@query("kinetic_pressure", """select run, frame, i, j, round(0.5*(case when run='r0' then 450 else 300 end)*hu*hu/1000,6) as pressure from frames""")
def _(fx):
    runs = fx.frames.select("run").distinct().withColumn("rho", F.when(F.col("run") == "r0", 450.0))
    return O.kinetic_pressure(fx.frames, runs, "hu").select("run", "frame", "i", "j", F.round("pressure", 6).alias("pressure"))


@query("surface_fields", """with q as (select *, case when h>0 then hu/h else 0 end as u, case when h>0 then hv/h else 0 end as v from frames)
select run, frame, i, j, h+b as eta, sqrt(u*u+v*v) as s, h*sqrt(u*u+v*v) as hs, h*sqrt(u*u+v*v)*sqrt(u*u+v*v) as hss from q""")
def _(fx):
    return O.surface_fields(fx.frames).select("run", "frame", "i", "j", "eta", "s", "hs", "hss")


@query("lake_displacement", """select f.run, f.frame, f.i, f.j, (f.b+f.h)-(g.b+g.h) as value from frames f join frames g on g.run=f.run and g.i=f.i and g.j=f.j and g.frame=0""")
def _(fx):
    return O.lake_variable(fx.frames, "displacement").select("run", "frame", "i", "j", "value")


@query("lake_elevation", "select run, frame, i, j, case when h>=1e-4 then b+h end as value from frames")
def _(fx):
    return O.lake_variable(fx.frames, "elevation").select("run", "frame", "i", "j", "value")


@query("release_depth", """with m as (select run, avg(z) as mean from cells group by run),
f as (select c.*, coalesce(z, mean) as f, case when i between 10 and 40 and z is not null then ((i+j)%5)*0.25e0 else 0 end as coverage from cells c join m on m.run=c.run),
g as (""" + grad_sql("f", "f", "run") + """),
a as (select *, atan(sqrt(f_x*f_x+f_y*f_y)) as q from g),
k as (select *, case when q>radians(25e0) and abs(sin(q)-0.2*cos(q))>1e-12 then (sin(radians(28e0))-0.2*cos(radians(28e0)))/(sin(q)-0.2*cos(q)) else 0 end as fac from a),
r as (select *, (1.5+(z-5)*3/100)*fac as cand from k)
select run, i, j, round(case when coverage<=0 then 0 when cand>=0 then cand*coverage end,6) as depth, coverage>0 and (cand is null or cand<0) as invalid from r""")
def _(fx):
    cov = F.when(F.col("i").between(10, 40) & F.col("z").isNotNull(), (F.col("i") + F.col("j")) % 5 * F.lit(0.25)).otherwise(F.lit(0.0))
    params = {"d0": 1.5, "z_ref": 5.0, "gradient_hypso": 3.0, "theta_cr": 28.0, "correction_elevation": True, "correction_slope": True}
    return O.release_depth(fx.cells.withColumn("coverage", cov), params).select(
        "run", "i", "j", F.round("depth", 6).alias("depth"), "invalid"
    )


@query("initial_surface", "select run, i, j, z+0.25e0*(i%3) as surface from cells")
def _(fx):
    c = fx.cells.withColumn("depth", F.col("i") % 3 * F.lit(0.25))
    return O.initial_surface(c).select("run", "i", "j", "surface")


@query("normal_vertical", "select run, i, j, round(greatest(abs(z), 1.25e0)*(1/sqrt(1+z_x*z_x+z_y*z_y)),6) as normal, "
       "round(abs(z)/(1/sqrt(1+z_x*z_x+z_y*z_y)),6) as vertical from (" + grad_sql("cells", "z", "run") + ")")
def _(fx):
    c = O.slope_terms(fx.cells).withColumns({"depth": F.abs("z"), "start": F.lit(1.25)})
    return O.normal_vertical(O.normal_vertical(c, "normal", initial="start"), "vertical").select(
        "run", "i", "j", F.round("normal", 6).alias("normal"), F.round("vertical", 6).alias("vertical")
    )


LAKE_SQL = "i between 8 and 50 and j between 5 and 44 and not (i between 20 and 24 and j between 10 and 14)"

def lake():
    """The lake footprint used by shore queries: a rectangle with an island."""
    i, j = F.col("i"), F.col("j")
    return i.between(8, 50) & j.between(5, 44) & ~(i.between(20, 24) & j.between(10, 14))


@query("initial_water_depth", f"select run, i, j, case when {LAKE_SQL} and z<9 then 9-z end as water from cells")
def _(fx):
    return O.initial_water_depth(fx.cells.withColumn("inside", lake()), 9.0).select("run", "i", "j", "water")


@query("stabilise_shore", f"""with m as (select *, {LAKE_SQL} as inside from cells),
n as (select m.run, m.i, m.j, count(*) as nine from m join m o on o.run=m.run and o.inside and abs(o.i-m.i)<=1 and abs(o.j-m.j)<=1 group by all),
s as (select m.*, coalesce(not inside and z<9.125, false) as outer_low, coalesce(inside and coalesce(nine,0)<9 and z<9.125, false) as rim from m left join n on n.run=m.run and n.i=m.i and n.j=m.j),
k as (select run, bool_or(coalesce(inside and not rim and z<9 and i between 1 and 62 and j between 1 and 48, false)) as keep from s group by run)
select s.run, i, j, case when outer_low or (rim and keep) then 9.125e0 else z end as z, outer_low or (rim and keep) as guarded from s join k on k.run=s.run""")
def _(fx):
    c = fx.cells.withColumn("inside", lake())
    return O.stabilise_shore(c, 9.0, 0.125, tile=16).select("run", "i", "j", "z", "guarded")


@query("edge_halo", """with h as (select run, unnest(case when i=0 then [0,-1] when i=63 then [0,1] else [0] end) as oi, * exclude (run) from cells),
h2 as (select *, unnest(case when j=0 then [0,-1] when j=49 then [0,1] else [0] end) as oj from h)
select run, i+oi as i, j+oj as j, x+oi as x, y+oj as y, z from h2""")
def _(fx):
    return O.edge_halo(fx.cells, fx.grids)


@query("nodal_midpoints", """with a as (select run, j, k.k as k, avg(z) as z, least(63, floor(k.k/2.0))-greatest(0, floor((k.k-1)/2.0))+1 as c, count(z) n from cells c, (select unnest(generate_series(0,128)) as k) k
 where c.i between greatest(0, floor((k.k-1)/2.0)) and least(63, floor(k.k/2.0)) group by run, j, k.k),
b as (select run, k as i, l.l as j, avg(z) as z, min(n=c) as full1, count(z) n2, least(49, floor(l.l/2.0))-greatest(0, floor((l.l-1)/2.0))+1 as c2 from a, (select unnest(generate_series(0,100)) as l) l
 where a.j between greatest(0, floor((l.l-1)/2.0)) and least(49, floor(l.l/2.0)) group by run, k, l.l)
select run, cast(i as int) as i, cast(j as int) as j, i*0.5e0 as x, j*0.5e0 as y, case when full1 and n2=c2 then z end as z from b""")
def _(fx):
    return O.nodal_midpoints(fx.cells, fx.grids)


@query("snap_to_centres", """select event_id, cast(floor(((event_id%700)*0.09375e0)/2+0.5-0.5) as int) as i, cast(floor(((event_id%500)*0.0625e0)/2+0.5-0.5) as int) as j,
 (floor(((event_id%700)*0.09375e0)/2)+0.5)*2 as x, (floor(((event_id%500)*0.0625e0)/2)+0.5)*2 as y from events""")
def _(fx):
    e = F.col("event_id")
    pts = fx.table("events").select(e, (e % 700 * F.lit(0.09375)).alias("x"), (e % 500 * F.lit(0.0625)).alias("y"))
    return O.snap_to_centres(pts, Geometry(0.0, 0.0, 2.0, 2.0, 32, 25)).select("event_id", "i", "j", "x", "y")
