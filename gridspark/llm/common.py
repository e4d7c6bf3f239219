"""What the corpus operators share: tables, written intermediate results, words, components, calibration."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.session import checkpoint_dir

# Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a blank; bytes from 128 up are letters.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


#: Rows that go to a Python worker or come from a Parquet file at once: texts can be long, and a batch is held in memory
#: several times over.
BATCH = 256


def small_batches(spark: SparkSession) -> None:
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if int(spark.conf.get(key)) > BATCH:
            spark.conf.set(key, BATCH)


def tidy(work: Callable) -> Callable:
    """A function over a task's batches that hands what it has freed back to the system at its end: Python workers outlive
    their tasks, and would keep the most that any of these took beside the next one."""

    @functools.wraps(work)
    def run(parts):
        yield from work(parts)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Spark's setting for removing an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Kept:
    """Intermediate results as Parquet in the shared folder, which outlive lost executors and cut the lineage."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.root = spark, checkpoint_dir(spark)
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root.rstrip('/')}/kept-{uuid.uuid4().hex}"
        # What the write shuffled is of no use once the table is there.
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove results that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(frame)))
            path.getFileSystem(conf).delete(path, True)


def remainder(key: str, n: int) -> Column:
    """crc32 of the key's text, modulo n; NULL for a NULL key."""
    return F.crc32(F.col(key).cast("string")) % n


#: Bits of the bitmap that `with_ids` puts in front of its join, in words of 64: the bitmap never grows with the data.
SIEVE = 1 << 16


def tested(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """`rows` with a flag `_maybe`, false only for rows whose key is not among `ids`.

    A bitmap over hashes of the ids, SIEVE rows at most and therefore broadcast, holds a bit for every id. With very
    many ids more of the other rows are flagged too."""
    bit = F.pmod(F.xxhash64(key), F.lit(SIEVE * 64))
    masks = ids.select((F.floor(bit / 64)).cast("int").alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), 64) as int))").alias("_bit"))
    masks = masks.groupBy("_word").agg(F.bit_or("_bit").alias("_mask"))
    met = rows.withColumn("_word", F.floor(bit / 64).cast("int")).join(F.broadcast(masks), "_word", "left")
    return met.withColumn("_maybe", F.expr(f"coalesce(getbit(_mask, cast(pmod(xxhash64(`{key}`), 64) as int)) = 1, false)")).drop("_word", "_mask")


def with_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among `ids`: a left semi join that moves few other rows."""
    return tested(rows, ids, key).where("_maybe").drop("_maybe").join(ids, key, "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among `ids`: a left anti join that moves few other rows."""
    flagged = tested(rows, ids, key)
    asked = flagged.where("_maybe").drop("_maybe").join(ids, key, "left_anti")
    return flagged.where("not _maybe").drop("_maybe").unionByName(asked).select(rows.columns)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class WordHashes:
    """64-bit hashes of all words of many texts at once: each byte has a number, a word's hash is their sum weighted
    by powers of an odd number, mixed. `letters` maps a byte to the one it counts as; blanks part words."""

    #: Bytes of text that are hashed in one go, unless one text is longer.
    AT_ONCE = 1 << 19

    def __init__(self, letters: bytes, blanks: bytes):
        rng = np.random.default_rng(17)
        number = rng.integers(1 << 63, dtype=np.uint64) | np.uint64(1)
        self.numbers = rng.integers(1 << 63, size=256, dtype=np.uint64)[np.frombuffer(letters, np.uint8)]
        self.blank = np.isin(np.arange(256), list(blanks))
        self.powers, self.base = np.ones(1, np.uint64), number

    def __call__(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hashes, offsets of each text's words in them) for runs of consecutive texts; NULL counts as empty."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + self.AT_ONCE, side="right")) - 1)
            yield self.some(data[ends[at]:ends[to]], ends[at:to + 1] - ends[at])
            at = to

    def some(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        letter = ~self.blank[data]
        opens = letter.copy()
        opens[1:] &= ~letter[:-1]
        starts = ends[:-1][ends[:-1] < len(data)]
        opens[starts] = letter[starts]
        first = np.flatnonzero(opens)
        offsets = np.searchsorted(first, ends)
        if not len(first):
            return np.empty(0, np.uint64), offsets
        inside = np.flatnonzero(letter)
        begin = np.searchsorted(inside, first)
        size = np.diff(np.append(begin, len(inside)))
        if size.max() > len(self.powers):
            self.powers = np.cumprod(np.full(int(size.max()) + 64, self.base, np.uint64))
        place = np.arange(len(inside)) - np.repeat(begin, size)
        h = np.add.reduceat(self.numbers[data[inside]] * self.powers[place], begin)
        return mixed(h + size.astype(np.uint64)), offsets


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words as runs of letters and digits, and words as runs of other than white space.
alphanumeric = lambda: WordHashes(WORD_BYTES, bytes(b for b in range(256) if WORD_BYTES[b] == 32))
printed = lambda: WordHashes(LOWER, b" \t\n\x0b\x0c\r")


def components(kept: Kept, links: DataFrame) -> DataFrame:
    """(id, component) of every id in `links` (a, b); component is the smallest id reachable.

    Alternates large-star and small-star steps until no link changes: links never grow in number, a hub's
    links are only joined by key (adaptive execution splits them), and the rounds grow with the logarithm of
    the number of ids. Links with a NULL end or between equal ids are ignored."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state, mark = kept.write(links), None
    while True:
        count = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if tuple(count) == mark or count["n"] == 0:
            break
        mark = tuple(count)
        both = state.union(state.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = large.join(small, "a")
        new = kept.write(pair.select("a", "m").union(pair.where("b <> m").select("b", "m")).toDF("a", "b").distinct())
        kept.drop(state)
        state = new
    roots = state.select("b").distinct()
    return state.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("b", "b"))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, text, label, part) of labelled documents outside the held-out fold.

    At most `bound` labelled ids, the first by a hash of the id; labels other than 0 and 1 and NULL ids are left
    out, an id with two labels takes the larger. `part` splits the rows in four."""
    picked = (
        labels.where(F.col(label).isin(0, 1) & (remainder("doc_id", folds) != held)).groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")
        .select("doc_id", "text", "label", (F.abs(F.xxhash64("doc_id")) % 4).cast("int").alias("part"))
    )


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps on a bounded sample; the first weight is the intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(a.shape[1]), np.diag([1e-6] + [ridge] * (a.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(w)), a.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w
