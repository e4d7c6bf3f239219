"""Document quality by regularised quadratic discriminant analysis.

Statistics of the whole text are transformed towards normal shape; each class has a mean and a covariance shrunk
towards the pooled one and its diagonal; the score is the difference of the two log densities from Cholesky factors
that are computed once, put on a probability scale by a logistic curve.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import logistic, remainder, training_rows

#: Labelled documents that the model is fitted on, at most.
BOUND = 20_000
#: Weights of the pooled covariance and of its diagonal in a class covariance; more for small classes.
POOLED, DIAGONAL = 0.10, 0.05

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = bytes(range(48, 58))
BLANKS = b" \t\n\r\x0b\f"
COMMON = b".,;:?'\"-()"
MARKS = bytes(b for b in range(33, 127) if b not in LETTERS and b not in DIGITS and b not in COMMON)

FEATURES = (
    "log_words", "word_length", "variety", "marks", "worst_line_marks", "upper", "worst_line_upper", "digits",
    "sentence_length", "repeated_lines", "repeated_words", "line_length",
)


def count(text: bytes, some: bytes) -> int:
    return len(text) - len(text.translate(None, some))


def rate(part: float, whole: float, floor: float = 0.002) -> float:
    """A share on the logit scale, with the ends drawn in."""
    p = (part + floor) / (whole + 2 * floor) if whole else 0.5
    p = min(max(p, floor), 1 - floor)
    return math.log(p / (1 - p))


def statistics(text: bytes | None) -> list[float]:
    """FEATURES of a whole text; NULL and empty texts have those of no words."""
    text = text or b""
    tokens = text.lower().split()
    n, kinds = len(tokens), len(set(tokens))
    letters, marks, upper = count(text, LETTERS), count(text, MARKS), count(text, UPPER)
    lines = [x for x in text.split(b"\n") if x]
    printed = max(len(text) - count(text, BLANKS), 1)
    worst_marks = max((count(x, MARKS) / len(x) for x in lines), default=0.0)
    worst_upper = max((count(x, UPPER) / len(x) for x in lines), default=0.0)
    ends = count(text, b".!?") + 1
    doubled = sum(map(bytes.__eq__, tokens, tokens[1:]))
    return [
        math.log1p(n), math.log1p(letters / n) if n else 0.0, math.log((kinds + 1) / (n + 1)) / math.log(n + 2),
        rate(marks, printed), rate(worst_marks, 1.0), rate(upper, max(letters, 1)), rate(worst_upper, 1.0),
        rate(count(text, DIGITS), printed), math.log1p(n / ends), rate(len(lines) - len(set(lines)), max(len(lines), 1)),
        rate(doubled, max(n, 1)), math.log1p(len(text) / max(len(lines), 1)),
    ]


@dataclass
class Model:
    """Means, inverse Cholesky factors and log determinants of the classes 0 and 1, spread and curve."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    curve: np.ndarray
    rate: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        density = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets)]
        return density[1] - density[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.rate)
        # The curve sees the difference on a scale that tames far-off documents.
        line = self.curve[0] + self.curve[1] * np.arcsinh(self.difference(x) / 2)
        return 1 / (1 + np.exp(-np.clip(line, -30, 30)))


def features(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def take(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([statistics(t) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.float64()))

    return take(text)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, bound: int = BOUND) -> Model:
    """Learn from labelled documents outside the held-out fold, `bound` of them at most; three quarters give the
    densities and one quarter the curve. With fewer than two documents of a class the score is the rate of label 1."""
    rows = training_rows(docs, labels, "quality", folds, held, bound).select("label", "part", features(F.col("text")).alias("x"))
    sample = rows.collect()  # BOUND rows of len(FEATURES) numbers at most
    x = np.array([r["x"] for r in sample], float).reshape(len(sample), len(FEATURES))
    y = np.array([r["label"] for r in sample], int)
    part = np.array([r["part"] for r in sample], int)
    share = float(y.mean()) if len(y) else 0.5
    nothing = Model(np.zeros(1), np.ones(1), [], [], [], np.zeros(2), share)
    main, rest = part > 0, part == 0
    if min(np.sum(main & (y == 0)), np.sum(main & (y == 1))) < 2 or len(set(y[rest])) < 2:
        return nothing
    centre, scale = x[main].mean(0), np.maximum(x[main].std(0), 1e-6)
    z = (x - centre) / scale
    groups = [z[main & (y == c)] for c in (0, 1)]
    means = [g.mean(0) for g in groups]
    spread = [(g - m).T @ (g - m) / len(g) for g, m in zip(groups, means)]
    pooled = sum(len(g) * s for g, s in zip(groups, spread)) / main.sum()
    factors, log_dets = [], []
    for g, s in zip(groups, spread):
        thin = len(FEATURES) / (len(FEATURES) + len(g))  # weight of the pooled estimate grows as the class shrinks
        a, b = POOLED + (1 - POOLED) * thin, DIAGONAL
        full = (1 - a - b * (1 - a)) * s + a * pooled + b * (1 - a) * np.diag(np.diag(pooled)) + 0.01 * np.eye(len(s))
        lower = np.linalg.cholesky(full)
        factors.append(np.linalg.inv(lower))
        log_dets.append(2 * float(np.log(np.diag(lower)).sum()))
    model = Model(centre, scale, means, factors, log_dets, np.array([0.0, 1.0]), share)
    model.curve = logistic(np.arcsinh(model.difference(x[rest]) / 2)[:, None], y[rest].astype(float), ridge=0.1)
    return model


def scored(text: str | Column, model: Model) -> Column:
    """Probability of label 1 of a text; NULL and empty texts get that of a text without words."""

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            x = np.array([statistics(t) for t in texts.cast(pa.binary()).to_pylist()], float).reshape(len(texts), len(FEATURES))
            yield pa.array(model.probability(x))

    return score(F.col(text) if isinstance(text, str) else text)


def score_documents(docs: DataFrame, model: Model, folds: int = 5, held: int = 0) -> DataFrame:
    """A row for every row of `docs`: doc_id, held_out, score, predicted.

    Repeated rows are scored each; held_out is false for a NULL doc_id; other columns are left out."""
    out = docs.select("doc_id", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"), scored("text", model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, whose score reaches the threshold."""
    return docs.where(scored("text", model) >= threshold)
