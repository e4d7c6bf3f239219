"""URL filters by host word segmentation and naive Bayes.

Rules on host and path decide first. For the rest, names in the host are split into words by a Viterbi search over
unigram probabilities counted in all URLs and held as a table, and a multinomial naive Bayes model over host and path words decides. The
model is trained on all URLs: those with a word of a block list against the others.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import Kept

#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words that make a URL an example of the class block.
SEEDS = frozenset("ads adult bet bets betting casino cheap escort farm gambling jackpot loans pills poker porn sex slots spam track viagra xxx".split())
#: Buckets of the naive Bayes model; longest word; pieces of runs that leave a Python worker at once.
BUCKETS, LONGEST, PIECES = 1 << 16, 24, 20_000
#: The class block must be this much likelier than its share in the training data says.
ODDS = 0.0

WORD = re.compile(r"[a-z]+")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for NULL and without ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)://(.*)", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, NULL without one. A rule's length is that of host and path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def names(host: str, path: str) -> tuple[list[str], list[str]]:
    """Runs of letters in the host (its last label left out, unless it is the only one) and in the path."""
    labels = host.rstrip(".").split(".")
    return WORD.findall(".".join(labels[:-1] or labels)), WORD.findall(path.lower())


class Segmenter:
    """Splits runs of letters into words: Viterbi over unigram log probabilities.

    A run is no witness for itself: it stays whole only if two or more known words of three letters and more do not
    make it up."""

    def __init__(self, logs: dict[str, float], total: float):
        self.logs, self.unknown, self.seen = logs, -math.log(max(total, 1) * 10), {}

    def path(self, run: str, shortest: int, spell: bool) -> list[str]:
        """The likeliest words other than the run itself; none if known words do not reach and it may not spell."""
        best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            for start in range(max(0, end - LONGEST), end):
                log = self.logs.get(run[start:end]) if end - start >= shortest and end - start < len(run) else None
                if log is None:
                    if not spell:
                        continue
                    log = self.unknown - 2.3 * (end - start)
                if best[start] + log > best[end]:
                    best[end], back[end] = best[start] + log, start
        out, end = [], len(run)
        while end and best[end] > -math.inf:
            out.append(run[back[end]:end])
            end = back[end]
        return out[::-1]

    def __call__(self, run: str) -> list[str]:
        if run not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[run] = self.path(run, 3, False) or ([run] if run in self.logs else self.path(run, 2, True))
        return self.seen[run]


@dataclass
class Model:
    """Counts of all words (word, n) as a table, their total, and the log odds of each bucket and of the classes."""

    words: DataFrame
    total: int
    odds: np.ndarray
    prior: float


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) & (BUCKETS - 1)


def tokenized(kept: Kept, rows: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """`rows` (host, path and others) with `tokens`: the words of the host's names and of the path, marked h: and p:.

    Every distinct run of letters is split once: its pieces meet the table of words, and Viterbi runs over those known."""
    rows = kept.write(rows.withColumn("_row", F.monotonically_increasing_id()))

    @F.arrow_udf("array<struct<side:string,run:string>>")
    def sides(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("side", pa.string()), ("run", pa.string())]))
        both = (names(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist()))
        return pa.array([[{"side": m, "run": r} for m, runs in zip(("h:", "p:"), two) for r in runs] for two in both], kind)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found = [], []
        for batch in batches:
            for i, run in zip(batch["_run"].to_pylist(), batch["run"].to_pylist()):
                for start in range(len(run)):
                    some = {run[start:end] for end in range(start + 2, min(len(run), start + LONGEST) + 1)}
                    ids += [i] * len(some)
                    found += some
                    if len(ids) > PIECES:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["_run", "word"])
                        ids, found = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["_run", "word"])

    @F.arrow_udf("array<string>")
    def split(runs: pa.Array, known: pa.Array) -> pa.Array:
        out = []
        for run, pairs in zip(runs.to_pylist(), known.to_pylist()):
            # Pieces of one or two letters are words only where they stand alone often.
            logs = {p["word"]: math.log(p["n"] / total) - (3.0 if len(p["word"]) < 3 else 0.0) for p in pairs or ()}
            out.append(Segmenter(logs, total)(run))
        return pa.array(out, pa.list_(pa.string()))

    placed = rows.select("_row", F.posexplode(sides("host", "path")).alias("_at", "_p")).select("_row", "_at", "_p.*")
    runs = kept.write(placed.select("run").distinct().withColumn("_run", F.monotonically_increasing_id()))
    known = runs.mapInArrow(pieces, "_run long, word string").join(words, "word").groupBy("_run").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    done = kept.write(runs.join(known, "_run", "left").select("run", split("run", "known").alias("words")))
    marked = placed.join(done, "run").select("_row", "_at", F.transform("words", lambda w: F.concat("side", w)).alias("words"))
    tokens = marked.groupBy("_row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_at", "words"))), lambda v: v["words"])).alias("tokens"))
    return rows.join(tokens, "_row", "left").drop("_row")


def fit(pages: DataFrame, url: str = "url") -> Model:
    """Count words and train naive Bayes on all URLs. Whole runs of letters between other characters are the words of
    the segmenter; a run is counted in every URL that has it. Without a URL of either class the odds are even."""
    host, path = parts(F.col(url))
    rows, kept = pages.select(host.alias("host"), path.alias("path")), Kept(pages.sparkSession)

    @F.arrow_udf("array<string>")
    def runs(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([sorted({w for side in names(h, p) for w in side if len(w) <= LONGEST}) for h, p in zip(hosts.to_pylist(), paths.to_pylist())], pa.list_(pa.string()))

    seeds = pages.sparkSession.createDataFrame([(w,) for w in sorted(SEEDS)], "word string")
    words = kept.write(rows.select(F.explode(runs("host", "path")).alias("word")).union(seeds).groupBy("word").agg(F.count("*").alias("n")))
    model = Model(words, words.agg(F.sum("n")).first()[0], np.zeros(BUCKETS), 0.0)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for tokens in batch["tokens"].to_pylist():
                tokens = tokens or []
                label = int(any(t[2:] in SEEDS for t in tokens))
                docs[label] += 1
                np.add.at(held[label], [bucket(t) for t in tokens], 1)
        at = np.flatnonzero(held.sum(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([*at, -1]), pa.array([*held[0, at], docs[0]]), pa.array([*held[1, at], docs[1]])], ["bucket", "allow", "block"])

    told = tokenized(kept, rows, words, model.total).select("tokens")
    sums = told.mapInArrow(tally, "bucket long, allow long, block long").groupBy("bucket").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).collect()
    table = np.full((2, BUCKETS), 0.1)
    docs = (0, 0)
    for r in sums:  # BUCKETS rows and one at most
        if r["bucket"] < 0:
            docs = (r["allow"], r["block"])
        else:
            table[:, r["bucket"]] += (r["allow"], r["block"])
    if min(docs) > 0:
        share = np.log(table) - np.log(table.sum(1, keepdims=True))
        model.odds, model.prior = share[1] - share[0], math.log(docs[1] / docs[0])
    return model


def judge_pages(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """A row for every row of `pages`: page_id, host, path, rule, verdict, score (log odds of block).

    NULL URLs and those without :// have an empty host and path and are allowed, as the model has no word against
    them. Repeated rows and NULL ids are answered each; other columns are left out."""
    host, path = parts(F.col("url"))

    share, prior = model.odds, model.prior

    @F.arrow_udf("double")
    def odds(told: pa.Array) -> pa.Array:
        return pa.array([prior + float(sum(share[bucket(t)] for t in tokens)) if tokens else -1.0 for tokens in told.to_pylist()], pa.float64())

    rows = tokenized(Kept(pages.sparkSession), pages.select("page_id", host.alias("host"), path.alias("path")), model.words, model.total)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.withColumn("rule", rule).withColumn("_verdict", verdict).withColumn("score", odds("tokens"))
    decided = F.coalesce("_verdict", F.when(F.col("score") > ODDS, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", decided.alias("verdict"), "score")
