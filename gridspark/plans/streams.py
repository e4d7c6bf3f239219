"""Streams replayed over derived tables in slices of time, each slice one arrival of data."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridspark.plans.registry import query
from gridspark.plans.sources import scratch
from gridspark.streaming import monitors as T
from gridspark.streaming.run import closing_rows, counting_late_rows, late_rows, latest, read_cells, run_available, with_event_time


# Instant 10^9 s after 1970, so that windows of 1000 s start at whole thousands of t (fixed value).
ORIGIN = "2001-09-09T01:46:40Z"


def replay(fx, name, df, cuts, build, mode="append", ends=None):
    """Write `df` in slices between `cuts` of column t; after each, let the stream process what is there.

    Closing rows `ends` come last of all."""
    base = scratch(fx, name)
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:]):
        part = df
        if lo is not None:
            part = part.where(F.col("t") >= lo)
        if hi is not None:
            part = part.where(F.col("t") < hi)
        if ends is not None and hi is None:
            part = part.union(ends)
        part.write.mode("append").parquet(f"{base}/in")
        stream = build(read_cells(fx.spark, f"{base}/in", df.schema))
        run_available(stream, f"{base}/out", f"{base}/state", mode)
    return f"{base}/out"


@query("stream_cell_maxima", """with m as (select run, i, j, max(h) as peak, min(t) filter (h>0.0625) as arrival from frames group by all)
select m.*, min(f.t) as time from m join frames f on f.run=m.run and f.i=m.i and f.j=m.j and f.h=m.peak group by all""")
def _(fx):
    df = fx.frames.select("run", "t", "i", "j", "h")
    out = replay(fx, "maxima", df, (30.0, 60.0), lambda s: T.stream_cell_maxima(s, dry=0.0625), "update")
    return latest(fx.spark, out, ["run", "i", "j"])


@query("stream_level_maxima", """with l as (select *, 1+(cast(frame as int)+i)%3 as level from frames), r as (select l.*, max(level) over (partition by run, i, j order by t) as best from l),
f as (select run, i, j, max(best) as level from r group by all), u as (select r.* from r join f on f.run=r.run and f.i=r.i and f.j=r.j and r.level=f.level),
m as (select run, i, j, level, max(h) as peak from u group by all), a as (select run, i, j, min(t) filter (h>0.0625) as arrival from frames group by all)
select m.run, m.i, m.j, m.level, m.peak, min(u.t) as time, a.arrival from m join u on u.run=m.run and u.i=m.i and u.j=m.j and u.h=m.peak join a on a.run=m.run and a.i=m.i and a.j=m.j group by all""")
def _(fx):
    df = fx.frames.select("run", "t", "i", "j", "h", (1 + (F.col("frame") + F.col("i")) % 3).alias("level"))
    out = replay(fx, "levels", df, (30.0, 60.0), lambda s: T.stream_level_maxima(s, dry=0.0625), "update")
    return latest(fx.spark, out, ["run", "i", "j"])


@query("stream_mass_monitor", """with c as (select *, sqrt(hu*hu+hv*hv) as speed from frames), a as (select run, frame, min(t) as t, sum(h*4) as volume, sum(case when h>=0.05 and speed>0.0625 then h*4 else 0 end) as moving from c group by run, frame)
select *, moving/(select b.volume from a b where b.run=a.run and b.frame=0) as fraction, frame>0 and moving/(select b.volume from a b where b.run=a.run and b.frame=0)<0.5 as stop from a""")
def _(fx):
    df = fx.frames.select("run", "frame", "t", "i", "j", "h", F.sqrt(F.col("hu") * F.col("hu") + F.col("hv") * F.col("hv")).alias("speed"), F.lit(False).alias("done"))

    def build(s):
        return T.stream_mass_monitor(with_event_time(s, "1 second", dedupe=["run", "frame", "i", "j"]), 0.0625, 0.5, 4.0)

    # Every second run tells its end, which finishes its last frame; a closing row of the others moves the watermark past theirs.
    ended = F.substring("run", 2, 9).cast("int") % 2 == 0
    last = df.groupBy("run").agg(F.max("t").alias("t"))
    ends = closing_rows(last.where(ended), df, 0.0).union(closing_rows(last.where(~ended), df, 10.0))
    return fx.spark.read.parquet(replay(fx, "mass", df, (30.0, 60.0), build, ends=ends)).drop("batch")


@query("stream_gauge_decimate", """with s as (select gauge, t, q1 from series), kept(gauge, t, q1) as (select gauge, min(t), arg_min(q1, t) from s group by gauge
 union all select k.gauge, n.t, n.q1 from kept k, lateral (select t, q1 from s where s.gauge=k.gauge and s.t>=k.t+500 order by t limit 1) n) select gauge, t, q1 from kept""")
def _(fx):
    df = fx.series.select("gauge", "t", "q1")
    out = replay(fx, "decimate", df, (3000.0, 6000.0), lambda s: T.stream_gauge_decimate(s, 500.0))
    return fx.spark.read.parquet(out).drop("batch")


@query("gauge_windows", """select gauge, to_timestamp(1e9+floor(t/1000)*1000)::timestamp as "start", to_timestamp(1e9+floor(t/1000)*1000+1000)::timestamp as "end", count(*) as n, min(q1) as low, max(q1) as high, round(avg(q1),9) as mean from series group by all""")
def _(fx):
    df = fx.series.select("gauge", "t", "q1", F.lit(False).alias("done"))
    ends = closing_rows(df.groupBy("gauge").agg(F.max("t").alias("t")), df, 1060.0)
    build = lambda s: T.gauge_windows(with_event_time(s, "60 seconds", ORIGIN), "1000 seconds")
    out = fx.spark.read.parquet(replay(fx, "windows", df, (3000.0, 6000.0), build, ends=ends)).drop("batch")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")} | {"mean": F.round("mean", 9)})


@query("gauge_sessions", """with g as (select gauge, t, q1, case when t-lag(t) over (partition by gauge order by t)<=200 then 0 else 1 end as new from series), n as (select *, sum(new) over (partition by gauge order by t) as k from g)
select gauge, to_timestamp(1e9+min(t))::timestamp as "start", to_timestamp(1e9+max(t)+200)::timestamp as "end", count(*) as n, max(q1) as high from n group by gauge, k""")
def _(fx):
    df = fx.series.select("gauge", "t", "q1", F.lit(False).alias("done"))
    # Past the last session of all by the gap and the delay.
    ends = closing_rows(df.groupBy("gauge").agg(F.max("t").alias("t")), df, 261.0)
    build = lambda s: T.gauge_sessions(with_event_time(s, "60 seconds", ORIGIN), "200 seconds")
    out = fx.spark.read.parquet(replay(fx, "sessions", df, (3000.0, 6000.0), build, ends=ends)).drop("batch")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_log_alerts", """with o as (select concat('r', o_custkey) as run, o_orderkey as seq, case when o_orderkey%9=4 then 1 else 0 end as a, case when o_orderkey%11=5 then 1 else 0 end as b from orders),
x as (select run, min(seq) filter (a=1) as sa, min(seq) filter (b=1) as sb from o group by run)
select run, 2*sa+1 as seq, 'SOLUTION ERROR' as reason from x where sa is not null union all select run, 2*sb+1, 'Too many dt reductions' from x where sb is not null""")
def _(fx):
    k = F.col("o_orderkey")
    # Each text comes in two parts, cut inside the failure text; slices of the replay part such pairs as well.
    marks = F.when(k % 9 == 4, "** SOLUTION ERROR **\n").otherwise("")
    more = F.when(k % 11 == 5, "Too many dt reductions\n").otherwise("")
    parts = F.array(
        F.struct((2 * k).alias("seq"), F.concat(F.lit("step done\n"), F.substring(marks, 1, 7), F.when(marks == "", F.substring(more, 1, 9)).otherwise("")).alias("text")),
        F.struct((2 * k + 1).alias("seq"), F.concat(F.substring(marks, 8, 99), F.when(marks == "", F.substring(more, 10, 99)).otherwise(more)).alias("text")),
    )
    df = fx.table("orders").select(F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("run"), F.inline(parts)).withColumn("t", F.col("seq").cast("double"))
    out = replay(fx, "alerts", df, (9999.0, 20001.0), T.stream_log_alerts)
    return fx.spark.read.parquet(out).drop("batch")


@query("stream_progress", """with e as (select *, 10+cast(substr(run,2) as int)%2 as expected from (select distinct run, frame, t from frames)),
r as (select run, expected, count(distinct frame) filter (not (run='r0' and frame>=4)) as written from e group by all)
select run, cast(expected as bigint) as expected, written, case when written>=expected then 'complete' when cast(substr(run,2) as int)%2=0 then 'incomplete' else 'running' end as status from r""")
def _(fx):
    odd = F.substring("run", 2, 9).cast("int") % 2
    # Run r0 stops early; runs of even number tell their end, the others wait for an eleventh frame.
    df = fx.frames.where("not (run = 'r0' and frame >= 4)").select("run", "frame", "t", F.lit(False).alias("done")).distinct()
    ends = closing_rows(df.where(odd == 0).groupBy("run").agg(F.max("t").alias("t")), df, 0.0)
    runs = fx.frames.select("run").distinct().withColumn("expected", 10 + odd)
    out = replay(fx, "progress", df, (30.0, 60.0), lambda s: T.stream_progress(s, runs), "update", ends)
    return latest(fx.spark, out, ["run"])


ARRIVALS = 104


@query("late_rows", f"""with e as (select event_id, ntile({ARRIVALS}) over (order by event_id) as batch, (select count(*) from events)/{ARRIVALS}.0e0 as width from events),
d as (select batch, width, case when event_id%13=5 then event_id-floor(6*width) else event_id end as t from e), m as (select batch, max(t) as top from d group by batch),
w as (select batch, max(top) over (order by batch rows between unbounded preceding and 2 preceding) as top from m)
select d.batch-1 as batch, count(*) as late from d join w using (batch) where d.t<=w.top-2*floor(d.width) group by d.batch""")
def _(fx):
    """Rows that come six arrivals late, over more arrivals than a query remembers reports of."""
    events = fx.table("events").select("event_id")
    total = events.count()
    width, base = total / ARRIVALS, scratch(fx, "late")
    e = events.withColumn("batch", F.ntile(ARRIVALS).over(Window.orderBy("event_id")))
    t = F.when(F.col("event_id") % 13 == 5, F.col("event_id") - int(6 * width)).otherwise(F.col("event_id")).cast("double")
    # One arrival after the other: a stream takes files by their age.
    e.select("event_id", t.alias("t"), "batch").coalesce(1).sortWithinPartitions("batch").write.partitionBy("batch").parquet(f"{base}/in")
    with counting_late_rows(fx.spark, f"{base}/late") as late:
        stream = with_event_time(read_cells(fx.spark, f"{base}/in", "event_id bigint, t double, batch int", 1), f"{2 * int(width)} seconds", ORIGIN)
        # State holds a few arrivals: as many partitions as one of them fills.
        run_available(stream.dropDuplicatesWithinWatermark(["event_id"]), f"{base}/out", f"{base}/state", late=late, partitions=max(4, int(width) // 20_000))
    return late_rows(fx.spark, f"{base}/late").drop("query")


@query("stream_rest", """with s as (select gauge as run, t, q1<=12 as low from series), g as (select *, count(*) filter (not low) over (partition by run order by t) as k from s),
n as (select *, count(*) filter (low) over (partition by run, k order by t) as below, min(t) filter (low) over (partition by run, k order by t) as since from g)
select run, t, cast(case when low then below else 0 end as int) as below, case when low and below>=3 then since end as rest from n""")
def _(fx):
    df = fx.series.select(F.col("gauge").alias("run"), "t", F.col("q1").alias("moving_fraction"))
    out = replay(fx, "rest", df, (3000.0, 6000.0), lambda s: T.stream_rest(s, 12.0, 3))
    return fx.spark.read.parquet(out).drop("batch")
