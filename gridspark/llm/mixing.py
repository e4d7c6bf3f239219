"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

Weights are propagated through a tree of domain, language and source. At every node the budget is divided among the
children by weight; what a child cannot use goes to its siblings, and only what all of them cannot use is missing
above. That is the same as raising one level for all siblings until the budget is used, each child bounded by its
capacity, so each level of the tree is one window expression. A leaf then takes documents of seeded epochs, in an
order of hashes, until its budget of tokens is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import Kept

LEVELS = ("domain", "lang", "source")
#: Of an order key, a hash in hexadecimal, the first characters are its bucket: 4,096 buckets for a leaf and epoch.
BUCKET = 3
#: A document's tokens: its runs of other than white space.
TOKEN = r"[^\x20\x09-\x0D]+"


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: str = "doc_id") -> Column:
    """Where a document stands in an epoch; rows that share an id share the place."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def divide(nodes: DataFrame, parent: list[str], node: str, budget: str) -> DataFrame:
    """Share each parent's `budget` among its nodes by `weight`, none above its `capacity`: column `share`.

    Nodes are taken by capacity per weight: those that fill up before the level that the rest reaches get their
    capacity, the others their part of what is left. Shares are whole tokens, rounded down; a node without weight or
    capacity gets nothing. Exact on integers."""
    order = Window.partitionBy(*parent).orderBy("_fill", node)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    n = (
        nodes.withColumn("_fill", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
        .withColumn("_left", F.col(budget) - F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("capacity"))).over(before), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    # A node is full if its own capacity is not beyond its part of what those before it have left.
    full = (F.col("weight") > 0) & (F.col("capacity").cast("decimal(38,0)") * F.col("_weights") <= F.col("_left").cast("decimal(38,0)") * F.col("weight"))
    n = n.withColumn("_full", full)
    spare = F.col(budget) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(whole), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole)
    part = F.expr("cast(_spare as decimal(28,0)) * weight div _open")
    n = n.withColumn("_spare", spare).withColumn("_open", open_weight)
    share = F.when(F.col("_full"), F.col("capacity")).when(F.col("weight") > 0, part).otherwise(F.lit(0))
    return n.withColumn("share", F.greatest(share.cast("long"), F.lit(0).cast("long"))).drop("_fill", "_left", "_weights", "_full", "_spare", "_open")


def budgets(leaves: DataFrame, weights: DataFrame, total: Column | int | None, share: float, epochs: int) -> DataFrame:
    """(domain, lang, source, weight, tokens, budget) of each leaf that `weights` names.

    `leaves` has the tokens of each leaf, `weights` a whole-number weight per leaf; a node's weight is the sum of its
    leaves' weights. The corpus gets `total` tokens, or `share` of all tokens of named leaves. A leaf can give its
    tokens `epochs` times."""
    d, l, s = LEVELS
    leaf = weights.join(leaves, list(LEVELS), "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    # A leaf without weight gives nothing, so it is no capacity of the nodes above it either.
    leaf = leaf.withColumn("capacity", F.when(F.col("weight") > 0, F.col("tokens") * epochs).otherwise(F.lit(0).cast("long")))
    sums = lambda df, *keys: df.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    by_lang = sums(leaf, d, l)
    by_domain = sums(by_lang, d).withColumn("_root", F.lit(1))
    aim = F.lit(total).cast("long") if total is not None else F.floor(F.sum("tokens").over(Window.partitionBy("_root")) * share)
    top = divide(by_domain.withColumn("_budget", aim), ["_root"], d, "_budget")
    middle = divide(by_lang.join(top.select(d, F.col("share").alias("_budget")), d), [d], l, "_budget")
    low = divide(leaf.join(middle.select(d, l, F.col("share").alias("_budget")), [d, l]), [d, l], s, "_budget")
    return low.select(*LEVELS, "weight", "tokens", F.col("share").alias("budget"))


def selection_bounds(measured: DataFrame, plan: DataFrame, epochs: int, seed: int) -> DataFrame:
    """(domain, lang, source, epoch, bound): documents of the leaf whose order key is at most `bound` are selected.

    `measured` has a row per document with its leaf, doc_id and tokens. Tokens are summed by bucket of the order key;
    one bucket of a leaf and epoch holds the end of the budget, and only its documents are ordered one by one. The
    epoch's last document may pass the budget: a prefix of documents is taken whole until the budget is reached."""
    leaf = list(LEVELS)
    keyed = (
        measured.join(F.broadcast(plan.where("budget > 0")), leaf)
        # Full epochs before the last one take all; only the epoch that the budget ends in has a bound.
        .withColumn("epoch", F.expr("least(budget div tokens_of_leaf, " + str(epochs - 1) + ")"))
        .withColumn("_rest", F.col("budget") - F.col("epoch") * F.col("tokens_of_leaf"))
        .withColumn("_key", order_key(seed, F.col("epoch")))
    )
    bucket = F.substring("_key", 1, BUCKET).alias("_bucket")
    sums = keyed.groupBy(*leaf, "epoch", "_rest", bucket).agg(F.sum("tokens").alias("_sum"))
    over = Window.partitionBy(*leaf).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(over), F.lit(0))).where("_before < _rest and _before + _sum >= _rest")
    inside = keyed.withColumn("_bucket", bucket).join(F.broadcast(cut.select(*leaf, "_bucket", "_before")), [*leaf, "_bucket"])
    run = Window.partitionBy(*leaf).orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ended = inside.withColumn("_at", F.col("_before") + F.coalesce(F.sum("tokens").over(run), F.lit(0))).where("_at < _rest")
    return ended.groupBy(*leaf, "epoch").agg(F.max("_key").alias("bound"))


def chosen_leaves(measured: DataFrame, weights: DataFrame, total: int | None, share: float, epochs: int, seed: int) -> DataFrame:
    """A row per leaf with a budget: how many full epochs it gives, and the epoch and bound that its budget ends in.

    `measured` is read several times."""
    leaf = list(LEVELS)
    leaves = measured.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"))
    named = weights.groupBy(*leaf).agg(F.sum("weight").cast("long").alias("weight"))
    plan = budgets(leaves, named, total, share, epochs).select(*leaf, "budget", F.col("tokens").alias("tokens_of_leaf")).where("budget > 0")
    bounds = selection_bounds(measured, plan, epochs, seed).select(*leaf, F.col("epoch").alias("_last"), "bound")
    return plan.join(bounds, leaf, "left").withColumn("_full", F.expr(f"least(budget div tokens_of_leaf, {epochs})"))


def repeated(rows: DataFrame, chosen: DataFrame, seed: int) -> DataFrame:
    """The rows (with domain, lang, source and doc_id) that the leaves choose, once per epoch, with `epoch`, `budget`."""
    # As many rows as the tree has leaves.
    met = rows.join(F.broadcast(chosen), list(LEVELS))
    last = F.coalesce((F.col("_last") >= F.col("_full")) & (order_key(seed, F.col("_last")) <= F.col("bound")), F.lit(False))
    times = met.withColumn("_times", F.col("_full") + last.cast("long")).where("_times > 0")
    return times.withColumn("epoch", F.explode(F.expr("sequence(0, cast(_times - 1 as int))")))


def measure(docs: DataFrame, domain: Column) -> DataFrame:
    return docs.select(domain.alias("domain"), "lang", "source", "doc_id", token_count().alias("tokens")).where("tokens > 0")


def mixture(docs: DataFrame, domain: Column, weights: DataFrame, total: int | None = None, share: float = 0.5, epochs: int = 2, seed: int = 7) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, tokens, budget) of the documents selected.

    A document of a leaf is selected once for every full epoch of the leaf's budget, and once more if its order key
    is within the bound of the last one. Leaves without weight, rows whose leaf `weights` does not name (a NULL
    domain, language or source among them) and documents without tokens are not selected. Repeated rows share
    a place in the order and are selected together. `weights` is a setting of the run (domain, lang, source, weight)
    with a row per leaf; it and the tables made of it are as small as that. Other columns of `docs` are left out."""
    measured = Kept(docs.sparkSession).write(measure(docs, domain))
    chosen = chosen_leaves(measured, weights, total, share, epochs, seed)
    return repeated(measured, chosen, seed).select("doc_id", *LEVELS, "epoch", "tokens", "budget")


def mix(docs: DataFrame, domain: Column, weights: DataFrame, total: int | None = None, share: float = 0.5, epochs: int = 1, seed: int = 7) -> DataFrame:
    """The rows of `docs`, all columns as they are, that `mixture` selects."""
    measured = Kept(docs.sparkSession).write(measure(docs, domain))
    chosen = chosen_leaves(measured, weights, total, share, epochs, seed)
    some = docs.where(F.col("text").rlike(TOKEN))
    rows = some.select(F.struct("*").alias("_row"), domain.alias("domain"), "lang", "source", "doc_id")
    return repeated(rows, chosen, seed).select("_row.*")


def weights_by_rule(leaves: DataFrame, domain_weight: dict[str, int], lang_weight: dict[str, int], default: int = 1) -> DataFrame:
    """Weights for a tree whose leaves are not listed by hand: the product of a domain's and a language's weight."""
    look = lambda name, table: F.coalesce(*[F.when(F.col(name) == k, v) for k, v in table.items()], F.lit(default))
    return leaves.select(*LEVELS).distinct().dropna().withColumn("weight", look("domain", domain_weight) * look("lang", lang_weight))
