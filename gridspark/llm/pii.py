"""Personal data by candidate gradient boosting.

High-recall generators propose spans that may overlap. Format features (length, digits, separators, checksums) and
context features (cue words before, what stands on either side) go to boosted trees, fitted on all candidates whose
format can be checked: those that the strict patterns confirm against those that fail their checks, each also in a
loose writing of its kind. A threshold calibrated on texts that fitted nothing selects the redactions; strict matches
always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import Kept, tidy

#: Strict kinds in the order of the contract; a match that fails its check is dropped.
KINDS = ("email", "ip", "card", "phone")
STRICT = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Loose generators of the method; what they find beyond the strict matches has to pass the trees.
LOOSE = {
    "email": re.compile(r"[\w.%+-]{1,64}\s?(?:@|\(at\)|\[at\])\s?[\w-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]{1,63}){1,8}"),
    "ip": re.compile(r"(?<![\d.])\d{1,4}(?:[.,]\s?\d{1,4}){3}(?![\d.])"),
    "card": re.compile(r"(?<!\d)\d{3,4}(?:[ ._/-]?\d{2,7}){2,5}(?!\d)"),
    "phone": re.compile(r"(?<![\w+])(?:00|\+\s?)?\(?\d{1,4}\)?(?:[ ./-]{0,2}\(?\d{2,5}\)?){2,5}(?!\w)"),
}
CUES = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "pay", "iban", "account"), "phone": ("phone", "tel", "call", "mobile", "fax"),
}
#: Precision that the threshold is set for, and the steps of scores that are looked at for it.
PRECISION, STEPS = 0.98, 4096
#: Features; a value that counts for all above it; what sums are counted in; tasks that send sums, at most.
FEATURES, TOP, UNIT, PARTS = 15, 63, 1 << 26, 64


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    total = 0
    for place, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if place % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def holds(kind: str, span: str) -> bool:
    """The check of a strict match of a kind."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))
    if kind == "card":
        digits = digits_of(span)
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits_of(span)) <= 15


def strict_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(spans that hold, matches that fail their check), leftmost and non-overlapping within a kind."""
    good, bad = [], []
    has_digit = any(d in text for d in "0123456789")
    for kind in KINDS:
        if ("@" if kind == "email" else "+" if kind == "phone" else ".") not in text and kind != "card" or kind != "email" and not has_digit:
            continue
        for m in (email_matches(text) if kind == "email" else STRICT[kind].finditer(text)):
            (good if holds(kind, m.group()) else bad).append((kind, m.start(), m.end()))
    return good, bad


LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")


def email_matches(text: str) -> Iterator[re.Match]:
    """STRICT email matches found from the @ signs: a match starts where its run of local characters does, or where
    the match before it ended. Same result, without trying every letter of a text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.fullmatch(text, start - 1, start):
            start -= 1
        m = STRICT["email"].match(text, start) if start < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


def candidates(text: str, strict: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Loose spans of every kind that are no strict match of the kind; kinds may overlap each other."""
    taken = set(strict)
    found = []
    for kind, pattern in LOOSE.items():
        if kind == "email" and "@" not in text and "at" not in text:
            continue
        for anchor in anchors(text, kind):
            found += [(kind, anchor[0] + m.start(), anchor[0] + m.end()) for m in pattern.finditer(text[anchor[0]:anchor[1]])]
    return sorted(set(found) - taken, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


AT, DOT = re.compile(r"\s?(?:@|\(at\)|\[at\])\s?"), re.compile(r"\s?(?:\.|\(dot\)|\[dot\])\s?")


def plain(kind: str, span: str) -> str:
    """A loose span in the strict writing of its kind."""
    if kind == "email":
        return DOT.sub(".", AT.sub("@", span))
    return re.sub(r"[.,]\s?", ".", span) if kind == "ip" else span


def loosely(kind: str, span: str) -> str | None:
    """A strict match in a writing that only the loose generator of its kind finds; None if that does not find it."""
    if kind == "email":
        local, host = span.split("@", 1)
        out = f"{local} (at) {host.replace('.', ' (dot) ')}"
    elif kind == "ip":
        out = span.replace(".", ",")
    elif kind == "card":
        digits = digits_of(span)
        out = ".".join(digits[k:k + 4] for k in range(0, len(digits), 4))
    else:
        out = span.lstrip("+")
    return out if LOOSE[kind].fullmatch(out) else None


ANCHORS = {"email": re.compile(r"@|\(at\)|\[at\]"), "digits": re.compile(r"[0-9](?:[0-9 ()./,_+-]*[0-9])+")}


def anchors(text: str, kind: str) -> Iterator[tuple[int, int]]:
    """Stretches of a text that can hold a loose span of a kind, apart from each other."""
    if kind == "email":
        end = 0
        for m in ANCHORS["email"].finditer(text):
            a, b = max(end, m.start() - 66), m.end() + 600
            yield a, b
            end = max(end, m.end())
    else:
        for m in ANCHORS["digits"].finditer(text):
            if m.end() - m.start() >= 7:
                yield max(0, m.start() - 3), m.end() + 1


#: A number that goes on before and after a span.
GOES_ON = re.compile(r"[0-9][.,:/-]"), re.compile(r"[.,:/-][0-9]")


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format and context of a candidate; nothing of the document's other columns."""
    kind, a, b = span
    part, digits = text[a:b], digits_of(text[a:b])
    before = text[max(0, a - 40):a].lower()
    groups = re.findall(r"[0-9]+", part)
    return [
        float(KINDS.index(kind)), float(len(part)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)), float(max((int(g[:6]) for g in groups), default=0) > 255), float(bool(digits) and luhn(digits)),
        float(part.count("@")), float(part.count(".")), float(part.count("-") + part.count(" ")), float(part[:1] == "+" or part[:2] == "00"),
        float(any(c in before for c in CUES[kind])), float(holds(kind, plain(kind, part))),
        float((text[a - 1:a].isalnum() if a else False) or text[b:b + 1].isalnum() or bool(GOES_ON[0].fullmatch(text[max(0, a - 2):a]) or GOES_ON[1].fullmatch(text[b:b + 2]))),
    ]


@dataclass
class Trees:
    """Boosted trees of depth 2 as arrays: two levels of splits and four leaves each, a start value and a threshold."""

    start: float
    splits: list[tuple[tuple[int, float], tuple[int, float], tuple[int, float], tuple[float, float, float, float]]]
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for (f, t), (fl, tl), (fr, tr), leaves in self.splits:
            right = x[:, f] > t
            low = np.where(right, x[:, fr] > tr, x[:, fl] > tl)
            total += np.array(leaves)[2 * right.astype(int) + low.astype(int)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def sums(x: np.ndarray, y: np.ndarray, n: np.ndarray, model: Trees, root: tuple[int, float] | None, edges: list[np.ndarray]) -> np.ndarray:
    """Gradient and curvature of the loss by side of the root split, feature and bin, in whole UNITs; `n` times each row.

    Bin k of a feature holds what is above k of its edges. Whole numbers add up to the same in any order."""
    width = max(map(len, edges)) + 1
    out = np.zeros((2 * len(edges) * width, 2), np.int64)
    p = model.probability(x)
    loss = np.column_stack([np.rint((y - p) * UNIT), np.rint(p * (1 - p) * UNIT)]).astype(np.int64) * n[:, None]
    side = np.zeros(len(x), np.int64) if root is None else (x[:, root[0]] > root[1]).astype(np.int64)
    for f, e in enumerate(edges):
        np.add.at(out, (side * len(edges) + f) * width + np.searchsorted(e, x[:, f], side="left"), loss)
    return out.reshape(2, len(edges), width, 2)


def best_split(by_bin: np.ndarray, edges: list[np.ndarray]) -> tuple[tuple[int, float], list[np.ndarray]]:
    """The feature and threshold with the largest gain of the second-order objective, and the sums on both sides."""
    total = by_bin[0].sum(axis=0) / UNIT
    best, where, sides = 1e-9, (0, float("inf")), [total, np.zeros(2)]
    for f, e in enumerate(edges):
        right = (by_bin[f].sum(axis=0) - np.cumsum(by_bin[f], axis=0))[:len(e)] / UNIT
        left = total - right
        gain = right[:, 0] ** 2 / (right[:, 1] + 1) + left[:, 0] ** 2 / (left[:, 1] + 1) - total[0] ** 2 / (total[1] + 1)
        k = int(np.argmax(gain)) if len(e) else 0
        if len(e) and gain[k] > best + 1e-9:
            best, where, sides = gain[k], (f, float(e[k])), [left[k], right[k]]
    return where, sides


def grow(p0: float, added: Callable[[Trees, tuple[int, float] | None], np.ndarray], edges: list[np.ndarray], rounds: int, rate: float) -> Trees:
    """Gradient boosting with logistic loss; `added` gives the `sums` over all rows for the trees so far and a root split."""
    p0 = float(np.clip(p0, 0.01, 0.99))
    model = Trees(float(np.log(p0 / (1 - p0))), [], 0.5)
    for _ in range(rounds):
        root, _ = best_split(added(model, None)[0], edges)
        below = [best_split(side, edges) for side in added(model, root)]
        leaves = [float(rate * g / (h + 1)) for _, sides in below for g, h in sides]
        model.splits.append((root, below[0][0], below[1][0], tuple(leaves)))
    return model


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, rate: float = 0.3) -> Trees:
    """`grow` on rows at hand, with thresholds at quantiles."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25), method="lower")) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    once = np.ones(len(x), np.int64)
    return grow(y.mean() if len(y) else 0.0, lambda model, root: sums(x, y, once, model, root, edges), edges, rounds if len(set(y)) == 2 else 0, rate)


def examples(text: str) -> Iterator[tuple[int, bytes]]:
    """(label, features as bytes, TOP at most) of a text's candidates that the trees are fitted on."""
    good, bad = strict_spans(text)
    loose = [s for s in candidates(text, good) if not any(s[1] < b and a < s[2] for _, a, b in good)]
    wrong = [s for s in loose if features(text, s)[-1] or not holds(s[0], plain(s[0], text[s[1]:s[2]]))]
    row = lambda t, s: bytes(min(int(v), TOP) for v in features(t, s))
    for label, spans in ((1, good), (0, {*bad, *wrong})):
        yield from ((label, row(text, s)) for s in spans)
    for label, spans in ((1, good), (0, bad)):
        for k, a, b in spans:
            near, other = text[max(0, a - 40):a], loosely(k, text[a:b])
            if other:
                yield label, row(near + other + text[b:b + 2], (k, len(near), len(near) + len(other)))


def fit(docs: DataFrame, text: str = "text", rounds: int = 30, rate: float = 0.3) -> Trees:
    """Fit the trees on the candidates of all texts.

    Label 1: strict matches that hold. Label 0: strict matches that fail, and loose spans that overlap no match that
    holds and lie inside a longer word or number or fail the check of their kind. Strict matches of either label count
    a second time in a loose writing in the same place, so that the writing alone decides nothing. Equal candidates are
    one row with their number; such a table is written once, and its tasks send sums by feature and value for each step of
    a tree, whose size depends on neither texts nor candidates. A fifth of the texts sets the threshold: in the lowest of
    STEPS equal ranges of scores that holds a right candidate and from which on candidates are right with PRECISION, the
    lowest score of a right one; without such a range nothing is added."""

    @tidy
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter((at, label, x) for at, t in zip(batch[0].to_pylist(), batch[1]) for label, x in examples(t.as_py() or ""))
            at, label, x = zip(*seen) if seen else ((), (), ())
            columns = [pa.array(at, pa.bool_()), pa.array(label, pa.int32()), pa.array(x, pa.binary()), pa.array(seen.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["test", "label", "x", "n"])

    kept = Kept(docs.sparkSession)
    some = docs.select((F.pmod(F.xxhash64(text), F.lit(5)) == 0).alias("test"), F.col(text)).mapInArrow(counted, "test boolean, label int, x binary, n bigint")
    rows = kept.write(some.groupBy("test", "label", "x").agg(F.sum("n").alias("n")))
    sizes = {(r["test"], r["label"]): r["n"] for r in rows.groupBy("test", "label").agg(F.sum("n").alias("n")).collect()}
    right, wrong = (sizes.get((False, label), 0) for label in (1, 0))
    # A task's sums are one row of fixed size, and there are PARTS of them at most.
    train = rows.where("not test").select("label", "x", "n").coalesce(PARTS)
    edges = [np.arange(TOP)] * FEATURES

    def numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(batch["x"].to_pylist()), np.uint8).reshape(-1, FEATURES).astype(float)
        return x, batch["label"].to_numpy().astype(float), batch["n"].to_numpy()

    def added(model: Trees, root: tuple[int, float] | None) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum((sums(*numbers(b), model, root, edges) for b in batches), np.zeros((2, FEATURES, TOP + 1, 2), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

        return sum(np.frombuffer(r["s"], np.int64).reshape(2, FEATURES, TOP + 1, 2) for r in train.mapInArrow(part, "s binary").collect())

    model = grow(right / max(1, right + wrong), added, edges, rounds if right and wrong else 0, rate)

    @tidy
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, n = numbers(b)
            yield pa.RecordBatch.from_arrays([pa.array(model.probability(x)), pa.array(y == 1), pa.array(n)], ["p", "right", "n"])

    steps = rows.where("test").select("label", "x", "n").mapInArrow(scored, "p double, right boolean, n bigint").groupBy(F.floor(F.col("p") * STEPS).alias("step")).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("right"), F.col("n"))), F.lit(0)).alias("good"), F.min(F.when(F.col("right"), F.col("p"))).alias("low")
    )
    model.threshold, n, good = 2.0, 0, 0
    for s in sorted(steps.collect(), key=lambda r: -r["step"]) if model.splits else []:
        n, good = n + s["n"], good + s["good"]
        if s["low"] is not None and good >= PRECISION * n:
            model.threshold = s["low"]
    kept.drop(rows)
    return model


def all_spans(text: str, model: Trees) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(strict spans, added spans) of a text. An added span overlaps no strict one and is no failed match of its own
    kind; of overlapping added ones the likelier stays (then the earlier, then the kind listed first)."""
    good, bad = strict_spans(text)
    failed = set(bad)
    loose = [s for s in candidates(text, good) if s not in failed and not any(s[1] < b and a < s[2] for _, a, b in good)]
    if not loose or model.threshold > 1:
        return good, []
    p = model.probability(np.array([features(text, s) for s in loose], float))
    added: list[tuple[str, int, int]] = []
    for score, s in sorted(zip(p.tolist(), loose), key=lambda v: (-v[0], v[1][1], KINDS.index(v[1][0]))):
        if score >= model.threshold and not any(s[1] < b and a < s[2] for _, a, b in added):
            added.append(s)
    return good, added


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def found(text: str | Column, model: Trees) -> Column:
    """struct<base, spans> of a text, each an array of (kind, start, end) in code points, end exclusive, by start
    and kind; a NULL text is empty."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    ddl = "array<struct<kind:string,start:bigint,end:bigint>>"

    @F.arrow_udf(f"struct<base:{ddl},spans:{ddl}>")
    @tidy
    def find(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        row = lambda spans: [dict(zip(("kind", "start", "end"), s)) for s in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))]
        for texts in parts:
            both = [all_spans(t.as_py() or "", model) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([row(g) for g, _ in both], span), pa.array([row(g + a) for g, a in both], span)], ["base", "spans"])

    return find(F.col(text) if isinstance(text, str) else text)


def redacted(text: str | Column, model: Trees) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named after the
    first. NULL stays NULL."""

    @F.arrow_udf("string")
    @tidy
    def mask(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            out = []
            for text in texts:
                t = text.as_py()
                if t is None:
                    out.append(None)
                    continue
                good, added = all_spans(t, model)
                pieces, at = [], 0
                for kind, a, b in sorted(good + added, key=lambda s: (s[1], KINDS.index(s[0]))):
                    if a >= at:
                        pieces += [t[at:a], f"<{kind}>"]
                    at = max(at, b)
                out.append("".join([*pieces, t[at:]]))
            yield pa.array(out, pa.string())

    return mask(F.col(text) if isinstance(text, str) else text)


def find_documents(docs: DataFrame, model: Trees) -> DataFrame:
    """A row for every row of `docs`: doc_id, counts of the strict kinds, base_sha256 and spans.

    Repeated rows and rows with a NULL id are answered each; other columns are left out."""
    s = docs.select("doc_id", found("text", model).alias("f"))
    text = lambda c: F.array_join(F.transform(c, lambda v: F.concat_ws(":", v["kind"], v["start"].cast("string"), v["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("f.base", lambda v: v["kind"] == kind)).cast("bigint")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    return s.select("doc_id", *counts, F.sha2(text(F.col("f.base")), 256).alias("base_sha256"), text(F.col("f.spans")).alias("spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
