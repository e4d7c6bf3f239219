"""Toxic passages by maximum-scoring segments.

Words get log-odds with Dirichlet priors from labelled documents; a linear scan finds all maximal segments of a text;
an extreme-value law for the best segment of a clean text of that length tells which of them are significant; a
logistic curve on a part of the labelled documents that gave no counts turns the statistics into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import alphanumeric, logistic, remainder, tidy, training_rows

#: Model size: words fall into this many buckets by a hash; the counts and the model are of this size at any scale.
BUCKETS = 1 << 18
#: Labelled documents that the model is fitted on, at most.
BOUND = 20_000
#: Strength of the prior, in documents' worth of words, and the cost of a word that tells nothing.
PRIOR, COST = 20.0, 0.4
#: A segment counts as toxic if a clean text holds one as good with at most this probability.
SIGNIFICANT = 0.05
STATISTICS = 4


@dataclass
class Model:
    """Bucket scores, Gumbel place and width of a clean text's best segment, and the curve's weights."""

    scores: np.ndarray
    place: float
    width: float
    curve: np.ndarray
    rate: float


def buckets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The bucket of every word, text by text."""
    for h, offsets in alphanumeric()(texts):
        at = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            yield at[a:b]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) in linear time (Ruzzo and Tompa)."""
    rise = np.flatnonzero(scores > 0)
    if not len(rise):
        return []
    total = np.cumsum(scores)
    right = total[rise].tolist()
    left = (total[rise] - scores[rise]).tolist()
    # Candidates: start, end, sum before, sum at the end, and the last earlier one with a smaller sum before.
    found: list[tuple[int, int, float, float, int]] = []
    for at, lo, hi in zip(rise.tolist(), left, right):
        start = at
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= lo:
                j = found[j][4]
            if j < 0 or found[j][3] >= hi:
                found.append((start, at + 1, lo, hi, j))
                break
            start, lo = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


def surprise(best: float, n: int, place: float, width: float) -> float:
    """The best segment's score in widths beyond what a clean text of n words has: a standard Gumbel value."""
    return (best - place) / width - math.log(n) if n else -10.0


def chance(z: float) -> float:
    """How likely a clean text has a Gumbel value of z or more."""
    return -math.expm1(-math.exp(min(-z, 50.0)))


def statistics(found: list[tuple[int, int, float]], n: int, place: float, width: float) -> list[float]:
    """What the curve uses: best segment's surprise, number, summed surprise and share of significant segments."""
    z = [surprise(s, n, place, width) for _, _, s in found]
    good = [(v, b - a) for v, (a, b, _) in zip(z, found) if chance(v) <= SIGNIFICANT]
    best = max(z, default=-10.0)
    return [
        math.asinh(max(best, -10.0)), math.log1p(len(good)), math.log1p(sum(v for v, _ in good)),
        math.sqrt(sum(k for _, k in good) / n) if n else 0.0,
    ]


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, bound: int = BOUND) -> Model:
    """Learn from labelled documents outside the held-out fold, `bound` of them at most.

    Three quarters give the word counts, one quarter the extreme-value law and the curve. Without both labels the
    scores are the rate of label 1 (a half without any label)."""
    rows = training_rows(docs, labels, "toxic", folds, held, bound)

    @tidy
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many texts of each label a bucket occurs, one block per task."""
        held_counts = np.zeros((2, BUCKETS), np.int64)
        for batch in parts:
            for found, label in zip(buckets(batch["text"]), batch["label"].to_pylist()):
                held_counts[label, np.unique(found)] += 1
        at = np.flatnonzero(held_counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held_counts[0, at]), pa.array(held_counts[1, at])], ["bucket", "clean", "toxic"])

    counts = (
        rows.where("part > 0").select("text", "label").mapInArrow(count, "bucket long, clean long, toxic long")
        .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ).toPandas()  # BUCKETS rows at most
    seen = np.zeros((2, BUCKETS))
    seen[:, counts["bucket"].to_numpy(np.int64)] = counts[["clean", "toxic"]].to_numpy(float).T
    # Dirichlet priors in proportion to the pooled counts, as strong as PRIOR documents of either label.
    pooled, size = seen.sum(0), seen.sum(1)
    prior = PRIOR * (pooled + 0.01) / max(pooled.sum(), 1) * 100
    share = lambda k: np.log(seen[k] + prior) - np.log(size[k] + prior.sum() - seen[k] - prior)
    known = min(size) > 0
    log_odds = share(1) - share(0) if known else np.zeros(BUCKETS)
    noise = np.sqrt(1 / (seen[1] + prior) + 1 / (seen[0] + prior))
    # Log-odds within two standard errors of nothing are taken as nothing.
    scores = np.sign(log_odds) * np.maximum(np.abs(log_odds) - 2 * noise, 0) - COST

    kind = "struct<n:bigint,best:double,segments:array<struct<a:bigint,b:bigint,s:double>>>"

    @F.arrow_udf(kind)
    @tidy
    def scan(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            out = []
            for at in buckets(texts):
                values = scores[at]
                found = segments(values)
                out.append({"n": len(values), "best": max((s for *_, s in found), default=0.0), "segments": [dict(zip("abs", x)) for x in found]})
            yield pa.array(out, pa.struct([("n", pa.int64()), ("best", pa.float64()), ("segments", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("s", pa.float64())])))]))

    sample = rows.where("part = 0").select("label", scan("text").alias("s")).select("label", "s.*").collect()  # BOUND rows at most
    y = np.array([r["label"] for r in sample], float)
    rate = float(y.mean()) if len(y) else float(size[1] / size.sum()) if size.sum() else 0.5
    if not known or not 0 < rate < 1:
        return Model(scores, 0.0, 1.0, np.zeros(STATISTICS + 1), rate)
    # Gumbel law by moments on clean texts: best = width * (ln n + z) + place.
    clean = [(r["best"], math.log(r["n"])) for r in sample if not r["label"] and r["n"]]
    best, size_log = np.array(clean).T if clean else (np.zeros(1), np.zeros(1))
    width = max(float(np.std(best)) * math.sqrt(6) / math.pi, 0.2)
    place = float(np.mean(best - width * size_log)) - 0.5772 * width
    x = np.array([statistics([(s["a"], s["b"], s["s"]) for s in r["segments"]], r["n"], place, width) for r in sample])
    return Model(scores, place, width, logistic(x, y), rate)


def scored(text: str | Column, model: Model) -> Column:
    """struct<score, p_value, passages> of a text: probability of label 1, how likely a clean text has such a best
    segment, and the significant passages as word offsets (end exclusive) with their scores.

    NULL and empty texts have no passage, a p-value of 1 and the score that the curve gives to no evidence."""

    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    @F.arrow_udf("struct<score:double,p_value:double,passages:array<struct<start:bigint,end:bigint,score:double>>>")
    @tidy
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        flat = not model.curve.any()
        for texts in parts:
            out = []
            for at in buckets(texts):
                values = model.scores[at]
                n, found = len(values), segments(values)
                z = max((surprise(s, n, model.place, model.width) for *_, s in found), default=-50.0)
                line = float(model.curve[0] + np.dot(model.curve[1:], statistics(found, n, model.place, model.width)))
                good = [dict(zip(("start", "end", "score"), x)) for x in found if chance(surprise(x[2], n, model.place, model.width)) <= SIGNIFICANT]
                out.append({"score": model.rate if flat else 1 / (1 + math.exp(-max(-30.0, min(30.0, line)))), "p_value": chance(z), "passages": good})
            yield pa.array(out, pa.struct([("score", pa.float64()), ("p_value", pa.float64()), ("passages", pa.list_(passage))]))

    return score(F.col(text) if isinstance(text, str) else text)


def score_documents(docs: DataFrame, model: Model, folds: int = 4, held: int = 2) -> DataFrame:
    """A row for every row of `docs`: doc_id, held_out, score, predicted, n_passages, p_value.

    Repeated rows are scored each; held_out is false for a NULL doc_id; other columns are left out."""
    return docs.select("doc_id", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"), scored("text", model).alias("s")).select(
        "doc_id", "held_out", F.col("s.score").alias("score"), (F.col("s.score") >= 0.3).cast("int").alias("predicted"),
        F.size("s.passages").cast("bigint").alias("n_passages"), F.col("s.p_value").alias("p_value"),
    )


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below the threshold."""
    return docs.where(scored("text", model)["score"] < threshold)
