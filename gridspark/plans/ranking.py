"""Queries for the model ranking pipeline and storm tracks."""

from pyspark.sql import functions as F

from gridspark.operators import ranking as M
from gridspark.operators import tracks as T
from gridspark.plans.registry import query

CANDS = ["m0", "m1", "m2"]

# Rounding of pair metrics before medians keeps both engines on equal inputs.
PAIRS_SQL = """pr as (select a."case", a.model as a, b.model as b, a.v as l, b.v as r, a.v>0.01 as ol, b.v>0.01 as orr from ensemble a join ensemble b on a."case"=b."case" and a.i=b.i and a.j=b.j and a.model<b.model),
pm as (select "case", a, b, sqrt(avg((l-r)*(l-r))) as rmse, avg(abs(l-r)) as mae, case when count(*) filter (ol or orr)=0 then 1e0 else count(*) filter (ol and orr)*1e0/count(*) filter (ol or orr) end as support_iou, corr(l,r) filter (ol or orr) as correlation from pr group by all),
dr as (select "case", a as model, b as other, rmse, mae, 1-support_iou as support, 1-correlation as pattern from pm union all select "case", b, a, rmse, mae, 1-support_iou, 1-correlation from pm)"""
DIFF_SQL = """df as (select "case", model as peer, median(rmse) as d_rmse, median(mae) as d_mae, median(support) as d_support, median(pattern) as d_pattern from dr where model not in ('m0','m1','m2') and other not in ('m0','m1','m2') group by all),
dt as (select "case", model as candidate, other as peer, rmse, mae, support, pattern from dr where model in ('m0','m1','m2') and other not in ('m0','m1','m2')),
sm as (select dt."case", candidate, median(rmse/d_rmse) as n_rmse, median(mae/d_mae) as n_mae, median(support/d_support) as n_support, median(pattern/d_pattern) as n_pattern, median(rmse) as median_rmse, avg(rmse) as mean_rmse, max(rmse) as max_rmse, median(mae) as median_mae from dt join df on df."case"=dt."case" and df.peer=dt.peer group by all),
rk as (select *, row_number() over (partition by "case" order by n_rmse, n_support, n_pattern, candidate) as rank from sm)"""


def pairs(fx):
    return M.model_pairs(fx.ensemble)


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query("model_pairs", "with " + PAIRS_SQL + ' select "case", a, b, round(rmse,9) as rmse, round(mae,9) as mae, round(support_iou,9) as support_iou, round(correlation,9) as correlation from pm')
def _(fx):
    # All models of a case lie on one grid, which is checked.
    grids = fx.ensemble.select("case", "model").distinct().select("*", *[F.lit(v).alias(n) for n, v in (("ncols", 64), ("nrows", 50), ("cellsize", 1.0), ("xmin", 0.0), ("ymin", 0.0))])
    return rounded(M.model_pairs(fx.ensemble, grids=grids), "rmse", "mae", "support_iou", "correlation")


@query("peer_difficulty", "with " + PAIRS_SQL + ", " + DIFF_SQL + ' select "case", peer, round(d_rmse,9) as difficulty_rmse, round(d_mae,9) as difficulty_mae, round(d_support,9) as difficulty_support, round(d_pattern,9) as difficulty_pattern, true as valid from df')
def _(fx):
    return rounded(M.peer_difficulty(pairs(fx), CANDS), *[f"difficulty_{c}" for c in ("rmse", "mae", "support", "pattern")])


@query("candidate_scores", "with " + PAIRS_SQL + ", " + DIFF_SQL + """, md as (select "case", i, j, median(v) filter (model not in ('m0','m1','m2')) as m from ensemble group by all),
fr as (select e."case", e.model as candidate, sqrt(avg((v-m)*(v-m))) as rmse_to_median, max(v) as peak, sum(v) as integral from ensemble e join md on md."case"=e."case" and md.i=e.i and md.j=e.j where e.model in ('m0','m1','m2') group by all)
select sm."case", sm.candidate, round(n_rmse,9) as normalized_median_rmse, round(n_mae,9) as normalized_median_mae, round(n_support,9) as normalized_median_support, round(n_pattern,9) as normalized_median_pattern, round(median_rmse,9) as median_rmse, round(mean_rmse,9) as mean_rmse, round(max_rmse,9) as max_rmse, round(median_mae,9) as median_mae, round(rmse_to_median,9) as rmse_to_median, peak, integral from sm join fr on fr."case"=sm."case" and fr.candidate=sm.candidate""")
def _(fx):
    out = M.candidate_scores(pairs(fx), fx.ensemble, CANDS)
    return rounded(out, *[f"normalized_median_{c}" for c in ("rmse", "mae", "support", "pattern")], "median_rmse", "mean_rmse", "max_rmse", "median_mae", "rmse_to_median")


LOO_SQL = """fo as (select distinct "case", peer as held_out from dt), df2 as (select dr."case", held_out, model as peer, median(rmse) as d_rmse, median(support) as d_support, median(pattern) as d_pattern from dr join fo on fo."case"=dr."case" where model not in ('m0','m1','m2',held_out) and other not in ('m0','m1','m2',held_out) group by all),
s2 as (select dt."case", held_out, candidate, median(rmse/d_rmse) as score, median(support/d_support) as n_support, median(pattern/d_pattern) as n_pattern from dt join df2 on df2."case"=dt."case" and df2.peer=dt.peer group by all),
fl as (select "case", held_out, candidate, score, cast(row_number() over (partition by "case", held_out order by score, n_support, n_pattern, candidate) as int) as rank from s2)"""


@query("leave_one_out", "with " + PAIRS_SQL + ", " + DIFF_SQL + ", " + LOO_SQL + ' select "case", held_out, candidate, round(score,9) as score, rank from fl')
def _(fx):
    return rounded(M.leave_one_out(pairs(fx), CANDS), "score")


@query("paired_wins", "with " + PAIRS_SQL + ", " + DIFF_SQL + """ select a."case", a.candidate as "left", b.candidate as "right", count(*) filter (a.rmse-b.rmse<-1e-14) as left_wins, count(*) filter (a.rmse-b.rmse>1e-14) as right_wins, count(*) filter (abs(a.rmse-b.rmse)<=1e-14) as ties from dt a join dt b on a."case"=b."case" and a.peer=b.peer and a.candidate<b.candidate group by all""")
def _(fx):
    return M.paired_wins(M.candidate_details(pairs(fx), CANDS))


@query("selection", "with " + PAIRS_SQL + ", " + DIFF_SQL + ", " + LOO_SQL + """, tp as (select "case", max(candidate) filter (rank=1) as leader, max(candidate) filter (rank=2) as runner_up from rk group by "case"),
w as (select a."case", count(*) filter (a.rmse-b.rmse<-1e-14) as wins, count(*) filter (a.rmse-b.rmse>1e-14) as losses, count(*) filter (abs(a.rmse-b.rmse)<=1e-14) as ties, count(*) as n from tp join dt a on a."case"=tp."case" and a.candidate=leader join dt b on b."case"=tp."case" and b.candidate=runner_up and b.peer=a.peer group by all),
ff as (select fl."case", count(*) filter (candidate=leader) as firsts, count(*) as folds from fl join tp on tp."case"=fl."case" where fl.rank=1 group by all)
select tp."case", case when wins>=n-1 and firsts=folds then 'selected' else 'no_decision' end as status, case when wins>=n-1 and firsts=folds then leader end as candidate, leader, runner_up, wins, losses, ties, firsts as fold_firsts from tp join w on w."case"=tp."case" join ff on ff."case"=tp."case" """)
def _(fx):
    p = pairs(fx)
    details = M.candidate_details(p, CANDS)
    ranked = M.rank_candidates(M._summaries(details, M.peer_difficulty(p, CANDS), ["case"]))
    return M.selection(ranked, details, M.leave_one_out(p, CANDS))


@query("compare_runs", """with d as (select a."case", a.v as x, b.v as y from ensemble a join ensemble b on a."case"=b."case" and a.i=b.i and a.j=b.j where a.model='m0' and b.model='m1') select "case", count(*) as cells, count(*) filter (x<>y) as changed, max(abs(x-y)) as max_abs, round(avg(abs(x-y)),9) as mean_abs, bool_and(x=y) as identical from d group by "case" """)
def _(fx):
    e = fx.ensemble
    return rounded(M.compare_runs(e.where("model = 'm0'"), e.where("model = 'm1'")), "mean_abs")


@query("peers_improved", "with " + PAIRS_SQL + ", " + DIFF_SQL + """ select a."case", count(*) filter (b.rmse<a.rmse) as improved, count(*) as peers from dt a join dt b on a."case"=b."case" and a.peer=b.peer where a.candidate='m0' and b.candidate='m1' group by all""")
def _(fx):
    return M.peers_improved(M.candidate_details(pairs(fx), CANDS), "m0", "m1")


def scale_sql(table, k: str) -> str:
    parts = [f"when s<{hi} then {n if k == 'n' else chr(39) + t + chr(39)}" for (_, n, t), (hi, _, _) in zip(table, table[1:])]
    last = table[-1]
    return "case " + " ".join(parts) + f" else {last[1] if k == 'n' else chr(39) + last[2] + chr(39)} end"


@query("storm_category", f"with k as (select storm, row_no, (vmax*8)*(1/0.51444444) as s from tracks) select storm, row_no, {scale_sql(T.NHC, 'n')} as category, {scale_sql(T.NHC, 't')} as category_name from k")
def _(fx):
    t = fx.tracks.withColumn("vmax", F.col("vmax") * 8)
    return T.storm_category(t, "NHC").select("storm", "row_no", "category", "category_name")


@query("storm_category_beaufort", f"with k as (select storm, row_no, vmax*1e0 as s from tracks) select storm, row_no, {scale_sql(T.BEAUFORT, 'n')} as category, {scale_sql(T.BEAUFORT, 't')} as category_name from k")
def _(fx):
    return T.storm_category(fx.tracks, "beaufort", unit="knots").select("storm", "row_no", "category", "category_name")


@query("best_track", """with d as (select storm, row_no, issue_h+tau_h as h, tau_h, lon, lat, nullif(vmax,0) as vmax, nullif(row_no%4*1.0e0,0) as r1, nullif(row_no%3*2.0e0,0) as r2 from tracks),
g as (select storm, h, arg_min(lon, tau_h*1e9+row_no) filter (lon<>0) as lon, arg_min(lat, tau_h*1e9+row_no) as lat, arg_min(vmax, tau_h*1e9+row_no) filter (vmax is not null) as vmax, arg_min(r1, tau_h*1e9+row_no) filter (r1 is not null) as r1, arg_min(r2, tau_h*1e9+row_no) filter (r2 is not null) as r2 from d group by storm, h)
select storm, timestamp '2024-01-01'+to_hours(h) as ts, lon, lat, vmax, case when r1 is not null or r2 is not null then (coalesce(r1,0)+coalesce(r2,0))/((r1 is not null)::int+(r2 is not null)::int) end as radius_mean from g where lon is not null""")
def _(fx):
    base = F.to_timestamp(F.lit("2024-01-01"))
    d = fx.tracks.withColumns({
        "issued": base + F.make_dt_interval(F.lit(0), F.col("issue_h").cast("int")),
        "r1": F.col("row_no") % 4 * F.lit(1.0), "r2": F.col("row_no") % 3 * F.lit(2.0),
    })
    out = T.best_track(d, ["lon", "lat", "vmax"], ["r1", "r2"])
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("agency_coalesce", """with o as (select storm, row_no, case row_no%3 when 0 then 'usa' when 1 then 'tokyo' else 'bom' end as provider, nullif(vmax,0) as ow, case when row_no%2=0 then mslp end as op, case when row_no%5<>0 then vmax+1 end as uw, case when row_no%4<>0 then vmax+2 end as tw, case when row_no%6=0 then mslp+1 end as up, case when row_no%9<>0 then mslp+2 end as tp, case when row_no%8=0 then 5e0 end as ur, case when row_no%5=0 then 7e0 end as tr from tracks),
r as (select storm, row_no, coalesce(ow, case provider when 'usa' then uw when 'tokyo' then tw end, uw, tw) as wind, coalesce(op, case provider when 'usa' then up when 'tokyo' then tp end, up, tp) as pres, coalesce(ur, tr) as rmw from o)
select * from r where wind is not null and pres is not null""")
def _(fx):
    k, v, p = F.col("row_no"), F.col("vmax"), F.col("mslp")
    o = fx.tracks.select(
        "storm", "row_no", F.when(k % 3 == 0, "usa").when(k % 3 == 1, "tokyo").otherwise("bom").alias("provider"),
        F.nullif(v, F.lit(0.0)).alias("official_wind"), F.when(k % 2 == 0, p).alias("official_pres"),
        F.when(k % 5 != 0, v + 1).alias("usa_wind"), F.when(k % 4 != 0, v + 2).alias("tokyo_wind"),
        F.when(k % 6 == 0, p + 1).alias("usa_pres"), F.when(k % 9 != 0, p + 2).alias("tokyo_pres"),
        F.when(k % 8 == 0, F.lit(5.0)).alias("usa_rmw"), F.when(k % 5 == 0, F.lit(7.0)).alias("tokyo_rmw"),
    )
    return T.agency_coalesce(o, ["wind", "pres", "rmw"], ["wind", "pres"], ["usa", "tokyo", "bom"])
