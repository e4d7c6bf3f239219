"""Ranking of candidate models against their peers.

Field pairs are compared once; difficulties, rankings, held-out folds and the
decision all work on the small table of pair metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark import schema
from gridspark.functions.keys import clean
from gridspark.operators.aggs import array_quantile, pair_metrics
from gridspark.operators.joins import grid_difference
from gridspark.operators.windows import rank_candidates

TIE = 1e-14


def model_pairs(
    ensemble: DataFrame, threshold: float = schema.SUPPORT_DEPTH, area: float = 1.0, value: str = "v", grids: DataFrame | None = None,
) -> DataFrame:
    """Metrics (case, a, b) of every unordered pair of models, a < b by name.

    With `grids(case, model, ncols, nrows, cellsize, xmin, ymin)`, a pair of models on different grids is an error, as
    their cells of equal place are no cells of equal ground.

    A cell holds one value per model, so its values fit one array. Pairs unfold
    from it inside the task and go straight into partial sums: what is shuffled is
    the fields once, then one row per task and pair.
    """
    cell = ensemble.groupBy("case", "i", "j").agg(F.sort_array(F.collect_list(F.struct("model", clean(value).alias("v")))).alias("_m"))
    pairs = F.flatten(
        F.transform(
            "_m",
            lambda x, k: F.transform(
                F.slice("_m", k + 2, F.size("_m")),
                lambda y: F.struct(x["model"].alias("a"), y["model"].alias("b"), x["v"].alias("left"), y["v"].alias("right")),
            ),
        )
    )
    out = pair_metrics(cell.select("case", F.inline(pairs)), ["case", "a", "b"], threshold, area).select(
        "case", "a", "b", "rmse", "mae", "support_iou", "correlation"
    )
    return out if grids is None else same_grid(out, grids)


def same_grid(pairs: DataFrame, grids: DataFrame) -> DataFrame:
    """The pairs (case, a, b, ...), or an error that names one whose models lie on different grids or have none."""
    place = F.struct("ncols", "nrows", "cellsize", "xmin", "ymin")
    of = lambda side: grids.select("case", F.col("model").alias(side), place.alias(f"_{side}"))
    both = pairs.join(of("a"), ["case", "a"], "left").join(of("b"), ["case", "b"], "left")
    reason = F.coalesce(grid_difference(F.col("_a"), F.col("_b")), F.when(F.col("_a").isNull() | F.col("_b").isNull(), "no grid"))
    said = F.concat(F.lit("case "), "case", F.lit(", models "), "a", F.lit(" and "), "b", F.lit(": "), reason)
    return both.where(F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))).select(*pairs.columns)


def _directed(pairs: DataFrame) -> DataFrame:
    """Pairs in both directions as (case, model, other, disagreements)."""
    d = pairs.withColumns({"support": 1 - F.col("support_iou"), "pattern": 1 - F.col("correlation")})
    cols = ["rmse", "mae", "support", "pattern"]
    one = d.select("case", F.col("a").alias("model"), F.col("b").alias("other"), *cols)
    return one.unionByName(d.select("case", F.col("b").alias("model"), F.col("a").alias("other"), *cols))


def peer_difficulty(pairs: DataFrame, candidates: list[str], by: list[str] = ["case"]) -> DataFrame:
    """Each peer's median disagreement with every other peer; `valid` where all are positive."""
    d = pairs if "other" in pairs.columns else _directed(pairs)
    d = d.where(~F.col("model").isin(*candidates) & ~F.col("other").isin(*candidates))
    out = d.groupBy(*by, F.col("model").alias("peer")).agg(*[F.median(c).alias(f"difficulty_{c}") for c in ("rmse", "mae", "support", "pattern")])
    ok = None
    for c in ("rmse", "mae", "support", "pattern"):
        pos = F.coalesce(F.col(f"difficulty_{c}") > 0, F.lit(False))
        ok = pos if ok is None else ok & pos
    return out.withColumn("valid", ok)


def candidate_details(pairs: DataFrame, candidates: list[str]) -> DataFrame:
    """Candidate-to-peer disagreements (case, candidate, peer, ...)."""
    d = _directed(pairs).where(F.col("model").isin(*candidates) & ~F.col("other").isin(*candidates))
    return d.withColumnsRenamed({"model": "candidate", "other": "peer"})


def _summaries(details: DataFrame, difficulty: DataFrame, by: list[str]) -> DataFrame:
    d = details.join(difficulty, [*by, "peer"])
    n = {c: F.try_divide(c, f"difficulty_{c}") for c in ("rmse", "mae", "support", "pattern")}
    return d.withColumns({f"n_{c}": v for c, v in n.items()}).groupBy(*by, "candidate").agg(
        *[F.median(f"n_{c}").alias(f"normalized_median_{c}") for c in n],
        F.median("rmse").alias("median_rmse"), F.avg("rmse").alias("mean_rmse"), F.max("rmse").alias("max_rmse"),
        F.median("mae").alias("median_mae"),
    )


def median_field_rmse(ensemble: DataFrame, candidates: list[str], value: str = "v") -> DataFrame:
    """RMSE of each candidate against the cell-wise median of the peers, and its peak and integral."""
    v = clean(value)
    is_c = F.col("model").isin(*candidates)
    cell = ensemble.groupBy("case", "i", "j").agg(
        F.sort_array(F.collect_list(F.when(~is_c, v))).alias("_p"),
        F.collect_list(F.when(is_c, F.struct(F.col("model").alias("candidate"), v.alias("v")))).alias("_c"),
    )
    d = cell.select("case", array_quantile(F.col("_p"), 0.5).alias("_m"), F.inline("_c"))
    gap = F.col("v") - F.col("_m")
    return d.groupBy("case", "candidate").agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse_to_median"), F.max("v").alias("peak"), F.sum("v").alias("integral")
    )


def candidate_scores(pairs: DataFrame, ensemble: DataFrame, candidates: list[str]) -> DataFrame:
    """Scores of each candidate: disagreements over peer difficulty, and distance to the peers' median field."""
    s = _summaries(candidate_details(pairs, candidates), peer_difficulty(pairs, candidates), ["case"])
    return s.join(median_field_rmse(ensemble, candidates), ["case", "candidate"])


def leave_one_out(pairs: DataFrame, candidates: list[str]) -> DataFrame:
    """Ranking of the candidates with each peer held out in turn (case, held_out, candidate, score, rank).

    Only the pair table is joined with its folds; no field is read again.
    """
    peers = candidate_details(pairs, candidates).select("case", F.col("peer").alias("held_out")).distinct()
    d = _directed(pairs).join(peers, "case").where((F.col("model") != F.col("held_out")) & (F.col("other") != F.col("held_out")))
    difficulty = peer_difficulty(d, candidates, ["case", "held_out"])
    details = d.where(F.col("model").isin(*candidates) & ~F.col("other").isin(*candidates)).withColumnsRenamed(
        {"model": "candidate", "other": "peer"}
    )
    s = _summaries(details, difficulty, ["case", "held_out"])
    return rank_candidates(s, ["case", "held_out"]).select(
        "case", "held_out", "candidate", F.col("normalized_median_rmse").alias("score"), "rank"
    )


def paired_wins(details: DataFrame) -> DataFrame:
    """Per candidate pair (left < right): peers on which either is closer, and ties within 1e-14."""
    a = details.select("case", "peer", F.col("candidate").alias("left"), F.col("rmse").alias("_l"))
    b = details.select("case", "peer", F.col("candidate").alias("right"), F.col("rmse").alias("_r"))
    d = a.join(b, ["case", "peer"]).where(F.col("left") < F.col("right")).withColumn("_d", F.col("_l") - F.col("_r"))
    tie = F.abs("_d") <= TIE
    return d.groupBy("case", "left", "right").agg(
        F.count_if(~tie & (F.col("_d") < 0)).alias("left_wins"), F.count_if(~tie & (F.col("_d") > 0)).alias("right_wins"),
        F.count_if(tie).alias("ties"),
    )


def selection(ranking: DataFrame, details: DataFrame, folds: DataFrame, wins_required: int | None = None) -> DataFrame:
    """The leader of each case, selected only if it beats the runner-up on enough peers and leads every fold.

    By default it may lose or tie on one peer.
    """
    top = ranking.where("rank <= 2").groupBy("case").agg(
        F.max(F.when(F.col("rank") == 1, F.col("candidate"))).alias("leader"), F.max(F.when(F.col("rank") == 2, F.col("candidate"))).alias("runner_up")
    )
    d = details.join(top, "case").groupBy("case", "peer").agg(
        F.max(F.when(F.col("candidate") == F.col("leader"), F.col("rmse"))).alias("_l"),
        F.max(F.when(F.col("candidate") == F.col("runner_up"), F.col("rmse"))).alias("_r"),
    ).withColumn("_d", F.col("_l") - F.col("_r"))
    tie = F.abs("_d") <= TIE
    wins = d.groupBy("case").agg(
        F.count_if(~tie & (F.col("_d") < 0)).alias("wins"), F.count_if(~tie & (F.col("_d") > 0)).alias("losses"),
        F.count_if(tie).alias("ties"), F.count("*").alias("_n"),
    )
    firsts = folds.where("rank = 1").join(top, "case").groupBy("case").agg(
        F.count_if(F.col("candidate") == F.col("leader")).alias("fold_firsts"), F.count("*").alias("_folds")
    )
    out = top.join(wins, "case").join(firsts, "case")
    need = F.lit(wins_required) if wins_required is not None else F.col("_n") - 1
    passed = (F.col("wins") >= need) & (F.col("fold_firsts") == F.col("_folds"))
    return out.select(
        "case", F.when(passed, "selected").otherwise("no_decision").alias("status"), F.when(passed, F.col("leader")).alias("candidate"),
        "leader", "runner_up", "wins", "losses", "ties", "fold_firsts",
    )


def compare_runs(base: DataFrame, cand: DataFrame, value: str = "v") -> DataFrame:
    """Direct differences of two runs' fields per case: cells, largest and mean change, and whether identical."""
    a = base.select("case", "i", "j", F.col(value).alias("_a"), F.lit(True).alias("_ina"))
    b = cand.select("case", "i", "j", F.col(value).alias("_b"), F.lit(True).alias("_inb"))
    both = a.join(b, ["case", "i", "j"], "full_outer")
    same = F.col("_a").eqNullSafe(F.col("_b")) & F.col("_ina").isNotNull() & F.col("_inb").isNotNull()
    d = F.abs(F.col("_a") - F.col("_b"))
    return both.groupBy("case").agg(
        F.count("*").alias("cells"), F.count_if(~same).alias("changed"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"),
        F.bool_and(same).alias("identical"),
    )


def peers_improved(details: DataFrame, base: str, cand: str) -> DataFrame:
    """Peers whose distance to `cand` is below that to `base`, per case."""
    p = details.groupBy("case", "peer").agg(
        F.max(F.when(F.col("candidate") == base, F.col("rmse"))).alias("_b"), F.max(F.when(F.col("candidate") == cand, F.col("rmse"))).alias("_c")
    )
    return p.groupBy("case").agg(F.count_if(F.col("_c") < F.col("_b")).alias("improved"), F.count("*").alias("peers"))
