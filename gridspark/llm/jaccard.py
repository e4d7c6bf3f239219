"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

Shingles are counted first, over all texts, so that every set can be put in one common order, rare shingles before
frequent ones. Texts with equal sets are one class before anything is compared. Two sets that reach the similarity must
share one of their first shingles in that order (prefix of n - ceil(t n) + 1), so only classes that share such a key
meet; a passage that many texts share stays behind the prefixes of all texts that are more than this passage. Every
class of a key is first compared with the key's first one, which has the key earliest in its order; what is then connected
needs no further comparison. The rest meets in tiles (key, size band): classes that are not connected with the key's first
one meet those of the sizes that the key's places in both sets leave possible. Bitmaps bound the overlap from above, and
what passes is decided by the sorted shingle arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gridspark.llm.common import Kept, components, mixed, printed, tested, tidy, with_ids, without_ids

#: Words in a shingle, and the similarity in hundredths.
WORDS, REACH = 5, 80
#: Shingles that a task gathers before it hands their counts on, and those of one counting group on average.
BLOCK, GROUP = 1 << 20, 1 << 20
#: Texts that share a shingle which the order calls frequent, and how many frequent shingles the order knows at most: the
#: most frequent ones by their counts over all texts. What it does not know comes first, by hash.
SELDOM, FREQUENT = 16, 1 << 20
#: Power of two of the texts from which on a shingle is shared without asking.
SHARED = 12
#: Ratio of the sizes that meet in one tile.
BAND = 1.1
#: Widest bitmap in bits; narrower ones have about twice as many bits as the set has shingles.
WIDEST = 4096


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; one per Python worker."""

    def __init__(self, size: int):
        self.size, self.words = size, printed()
        self.weights = np.random.default_rng(23).integers(1 << 63, size=size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The set of every text in turn; a text with fewer words than a shingle is one shingle."""
        for h, offsets in self.words(texts):
            total = np.zeros(max(len(h) - self.size + 1, 0), np.uint64)
            for k, weight in enumerate(self.weights):
                total += h[k:k + len(total)] * weight
            total = mixed(total)
            for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
                if b - a >= self.size:
                    yield np.unique(total[a:b - self.size + 1])
                else:
                    yield mixed((h[a:b] * self.weights[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)) if b > a else h[:0]


def prefix_length(n: int, reach: int) -> int:
    """How many first shingles must hold a common one: sizes n and m share at least reach % of n."""
    return n - -(-n * reach // 100) + 1 if n else 0


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit per shingle, hashed; the width is a power of two, so that a wide map folds into a narrow one."""
    bits = min(WIDEST, max(64, 1 << (2 * len(shingles) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[shingles & np.uint64(bits - 1)] = True
    return np.packbits(out, bitorder="little").tobytes()


def fold(maps: np.ndarray, width: int) -> np.ndarray:
    """Rows of bitmaps (bytes) folded to a width in bytes."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


class Order:
    """How frequent a shingle is: a power of two of the number of texts that have it, zero for one that is not known.

    Known are the most frequent `FREQUENT` shingles at most, whatever the number of texts; they are told apart by their
    first `bits` bits. Any order that all sets share finds all pairs: what is not known costs candidates, never links."""

    def __init__(self, bits: int, known: np.ndarray, power: np.ndarray):
        self.shift, at = np.uint64(64 - bits), np.argsort(known)
        self.known, self.power = known[at], power[at]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(shingles), np.uint8)
        short = shingles >> self.shift
        at = np.minimum(np.searchsorted(self.known, short), len(self.known) - 1)
        return np.where(self.known[at] == short, self.power[at], 0).astype(np.uint8)


def frequent(kept: Kept, docs: DataFrame, size: int, text_col: str, least: int = SELDOM, most: int = FREQUENT) -> Order:
    """The order of the shingles of all texts: it knows those in `least` texts or more, the `most` most frequent at most.

    Tasks hand on sorted blocks with counts, cut by the first bits of the hashes. There are as many such ranges as the
    bytes of all texts ask for, so a range holds about GROUP shingles at every size, and the 32 bits behind its own tell
    its shingles apart but for about one in thousands, whose counts are then one."""
    texts = docs.select(F.col(text_col).alias("text"))
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(6, int(volume // (4 * GROUP)).bit_length())
    shift, low = np.uint64(32 - ranges), np.uint64((1 << 32) - 1)

    @tidy
    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, some, held = Shingler(size), [], 0

        def counted() -> pa.RecordBatch:
            keys, often = np.unique(np.concatenate(some) >> shift, return_counts=True)
            cuts = np.flatnonzero(np.diff(keys >> np.uint64(32), prepend=np.uint64(1 << 40)))
            ends = np.append(cuts[1:], len(keys))
            short, often = (keys & low).astype("<u4"), often.astype("<u4")
            blob = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array((keys[cuts] >> np.uint64(32)).astype(np.int64)), blob(short), blob(often)], ["range", "keys", "often"])

        for batch in parts:
            for s in shingle(batch["text"]):
                some.append(s)
                held += len(s)
                if held >= BLOCK:
                    yield counted()
                    some, held = [], 0
        if held:
            yield counted()

    def summed(rows: pa.Table) -> pa.Table:
        keys, often = (np.frombuffer(b"".join(rows[c].to_pylist()), "<u4") for c in ("keys", "often"))
        at = np.argsort(keys)
        keys, often = keys[at], often[at].astype(np.int64)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sums = np.add.reduceat(often, first)
        many = sums >= least
        whole = (rows["range"][0].as_py() << 32) + keys[first][many].astype(np.int64)
        return pa.table({"key": whole, "power": np.log2(sums[many]).astype(np.int32)})

    counts = texts.mapInArrow(blocks, "range bigint, keys binary, often binary").groupBy("range").applyInArrow(summed, "key bigint, power int")
    counts = kept.write(counts)
    lowest, total = 0, 0
    for row in sorted(counts.groupBy("power").agg(F.count("*").alias("k")).collect(), reverse=True):  # a row per power of two
        total += row["k"]
        if total > most:
            lowest = row["power"] + 1
            break
    known = counts.where(F.col("power") >= lowest).toArrow()  # `most` rows at most
    kept.drop(counts)
    return Order(32 + ranges, known["key"].to_numpy().astype(np.uint64), known["power"].to_numpy().astype(np.uint8))


def shingle_sets(docs: DataFrame, order: Order, size: int, reach: int, id_col: str, text_col: str, shared: int = SHARED) -> DataFrame:
    """(doc_id, n, digest, prefix, seldom, bitmap) of every row; the digest is NULL and n zero for a text without words.

    The first `seldom` shingles of a prefix may belong to one text alone, the others are known to be shared."""
    names = ["n", "digest", "prefix", "seldom", "bitmap"]

    @F.arrow_udf("struct<n:bigint,digest:binary,prefix:array<bigint>,seldom:int,bitmap:binary>")
    @tidy
    def take(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingle = Shingler(size)
        for texts in parts:
            n, digests, prefixes, seldom, maps = [], [], [], [], []
            for s in shingle(texts):
                power = order(s)
                first = np.argsort(power, kind="stable")[:prefix_length(len(s), reach)]
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                prefixes.append(s[first].view(np.int64))
                seldom.append(int((power[first] < shared).sum()))
                maps.append(bitmap(s) if len(s) else None)
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(np.concatenate([*prefixes, np.empty(0, np.int64)]), pa.int64())
            )
            arrays = [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists, pa.array(seldom, pa.int32()), pa.array(maps, pa.binary())]
            yield pa.StructArray.from_arrays(arrays, names)

    return docs.select(F.col(id_col).alias("doc_id"), take(F.col(text_col)).alias("s")).select("doc_id", "s.*")


def shingle_arrays(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, shingles): the sorted 64-bit hashes as bytes."""

    @F.arrow_udf("binary")
    @tidy
    def take(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingle = Shingler(size)
        for texts in parts:
            yield pa.array([s.tobytes() for s in shingle(texts)], pa.binary())

    # A filter on the result would else be taken below what picks the rows, where it needs the arrays of all texts and
    # a second Python worker for every task.
    take = take.asNondeterministic()
    return docs.select(F.col(id_col).alias("doc_id"), take(F.col(text_col)).alias("shingles"))


@F.arrow_udf(LongType())
@tidy
def common(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Size of the intersection of two sorted arrays without repeats."""
    for a, b in parts:
        out = []
        for x, y in zip(a, b):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            out.append(int((q[np.minimum(at, len(q) - 1)] == p).sum()))
        yield pa.array(out, pa.int64())


@F.arrow_udf(LongType())
@tidy
def differing(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Bits in which two bitmaps differ at the narrower one's width: at most the size of the symmetric difference."""
    for a, b in parts:
        out = []
        for x, y in zip(a, b):
            p, q = (np.frombuffer(v.as_buffer(), np.uint8)[None, :] for v in (x, y))
            width = min(p.shape[1], q.shape[1])
            out.append(int(np.bitwise_count(fold(p, width) ^ fold(q, width)).sum()))
        yield pa.array(out, pa.int64())


def possible(na, nb, bits, reach: int):
    """Whether the overlap that the differing bits leave, (na + nb - bits) / 2, can reach the similarity."""
    return (100 + reach) * (na + nb - bits) >= 2 * reach * (na + nb)


def tile_pairs(rows: DataFrame, reach: int) -> DataFrame:
    """Pairs (a, b, na, nb) of classes of different labels that can reach the similarity by the place of a key that they share.

    `rows` has key, id, n, at (the key's place in the set, from 0), label and main, the label of the key's first class. At
    the first key that two sets share, their overlap is at most what either has from there on; so a residual class (not
    labelled main) goes to the bands of the sizes that its place allows, and meets the classes of these sizes whose place
    allows its own; two of the main label never meet. Every pair that reaches the similarity passes at its first key."""
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")
    least, most = F.expr(f"cast(({reach}L * n + 99) div 100 as int)"), F.expr(f"cast(({100 + reach}L * (n - at) - {reach}L * n) div {reach} as int)")
    most = F.least(most, F.expr(f"cast(100L * n div {reach} as int)"))
    side = lambda x: [F.col(c).alias(c + x) for c in ("id", "n", "at", "label")]
    there = rows.select("key", band(F.col("n")).alias("band"), *side("2"), (F.col("label") == F.col("main")).alias("joined"))
    here = rows.where("label <> main").select("key", F.explode(F.sequence(band(least), band(F.greatest(least, most)))).alias("band"), *side("1"))
    met = here.join(there, ["key", "band"]).where((F.col("label1") != F.col("label2")) & (F.col("joined") | (F.col("id1") < F.col("id2"))))
    met = met.where(reachable(F.col("n1"), F.col("at1"), F.col("n2"), F.col("at2"), reach))
    first = F.col("id1") < F.col("id2")
    ordered = lambda c, x, y: F.when(first, F.col(c + x)).otherwise(F.col(c + y))
    return met.select(ordered("id", "1", "2").alias("a"), ordered("id", "2", "1").alias("b"), ordered("n", "1", "2").alias("na"), ordered("n", "2", "1").alias("nb")).distinct()


def reachable(n: Column, at: Column, m: Column, to: Column, reach: int) -> Column:
    """Whether sets of sizes n and m whose first common shingle has these places (from 0) can reach the similarity."""
    return (100 + reach) * F.least(n - at, m - to).cast("long") >= reach * (n + m).cast("long")


def confirmed(kept: Kept, pairs: DataFrame, texts: DataFrame, sizes: DataFrame, reach: int, size: int) -> DataFrame:
    """Of pairs (a, b, na, nb) those whose bitmaps allow it and whose exact intersection reaches the similarity, written."""
    side = lambda x: sizes.select(F.col("doc_id").alias(x), F.col("bitmap").alias(f"m{x}"))
    bounded = pairs.where(possible(F.col("na"), F.col("nb"), F.abs(F.col("na") - F.col("nb")), reach)).join(side("a"), "a").join(side("b"), "b")
    likely = kept.write(bounded.where(possible(F.col("na"), F.col("nb"), differing("ma", "mb"), reach)).select("a", "b", "na", "nb"))
    # The arrays of the classes in those pairs alone; an id that repeats is held to the set that stands for it.
    asked = likely.select(F.col("a").alias("doc_id"), F.col("na").alias("n")).union(likely.select("b", "nb")).distinct()
    arrays = shingle_arrays(with_ids(texts, asked.select("doc_id"), "doc_id"), size, "doc_id", "text").join(asked, "doc_id")
    arrays = kept.write(arrays.where("length(shingles) = 8 * n").dropDuplicates(["doc_id"]).select("doc_id", "shingles"))
    side = lambda x: arrays.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}"))
    full = likely.join(side("a"), "a").join(side("b"), "b").withColumn("both", common("sa", "sb"))
    out = kept.write(full.where((100 + reach) * F.col("both") >= reach * (F.col("na") + F.col("nb"))).select("a", "b"))
    kept.drop(likely, arrays)
    return out


def jaccard_join(
    docs: DataFrame, size: int = WORDS, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text",
    seldom: int = SELDOM, frequent_most: int = FREQUENT, shared_from: int = SHARED,
) -> tuple[DataFrame, DataFrame]:
    """(membership, links).

    membership has doc_id, n_shingles, class_id (smallest id with the same set), component_id (smallest id reachable
    by links) and n_rows (rows with that doc_id) for every row of `docs`; links are pairs (a, b) of class ids that
    reach the similarity, enough of them to connect all that is connected. Rows without words, or with a NULL id,
    link with nothing: their component is their own id. Rows that repeat an id share a component; if their texts
    differ, the larger set stands for the id in the links. Other columns are left out. `seldom`, `frequent_most` and
    `shared_from` (see SELDOM, FREQUENT and SHARED) change costs, never results."""
    spark = docs.sparkSession
    kept = Kept(spark)
    order = frequent(kept, docs, size, text_col, seldom, frequent_most)
    sets = kept.write(shingle_sets(docs, order, size, reach, id_col, text_col, shared_from))
    mine = sets.where("doc_id is not null and n > 0")
    # One set per id, one id per set.
    by_id = mine.groupBy("doc_id").agg(F.max(F.struct("n", "digest")).alias("s")).select("doc_id", "s.digest")
    classes = kept.write(by_id.groupBy("digest").agg(F.min("doc_id").alias("class_id")).join(by_id, "digest").select("doc_id", "class_id", "digest"))
    # Most rows stand for their class; only those that may not are moved to find out.
    heads = classes.where("doc_id = class_id")
    unsure = classes.where("doc_id <> class_id").select("doc_id").unionAll(mine.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"))
    flagged = tested(mine, unsure, "doc_id")
    moved = flagged.where("_maybe").drop("_maybe").join(heads, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"])
    meta = kept.write(flagged.where("not _maybe").drop("_maybe").unionByName(moved))
    base = kept.write(sets.select("doc_id", "n"))
    kept.drop(sets)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    # A key that one class has alone meets nothing. The order knows many keys as shared; those stay where they are.
    # A row of a key tells its place in the set.
    placed = meta.select(F.posexplode("prefix").alias("at", "key"), F.col("doc_id").alias("id"), F.col("n").cast("int").alias("n"), "seldom")
    asked = placed.where("at < seldom").drop("seldom").repartition("key")
    shared = asked.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    rows = kept.write(asked.join(shared, "key").unionByName(placed.where("at >= seldom").drop("seldom")))
    sizes = kept.write(meta.select("doc_id", "n", "bitmap"))
    kept.drop(meta)

    # First the class that has a key earliest, which is least altered where many are alike, against the others of the key.
    low = rows.groupBy("key").agg(F.min(F.struct("at", "id", "n")).alias("l")).select("key", F.col("l.id").alias("a"), F.col("l.n").alias("na"), F.col("l.at").alias("first"))
    star = rows.join(low, "key").where("a <> id").where(reachable(F.col("na"), F.col("first"), F.col("n"), F.col("at"), reach))
    star = star.select("a", F.col("id").alias("b"), "na", F.col("n").alias("nb")).distinct()
    stars = confirmed(kept, star, texts, sizes, reach, size)
    roots = kept.write(components(kept, stars))

    # Then all that is not connected yet, tile by tile.
    named = rows.join(roots, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    main = named.groupBy("key").agg(F.min(F.struct("at", "id", "label"))["label"].alias("main"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    apart = named.join(main.select("key", "main"), "key")
    links = stars.unionAll(confirmed(kept, tile_pairs(apart, reach), texts, sizes, reach, size))
    kept.drop(rows, sizes)
    linked = components(kept, links).select(F.col("id").alias("class_id"), F.col("component").alias("component_id"))

    counts = base.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    of = counts.join(classes.select("doc_id", "class_id"), "doc_id", "left").join(linked, "class_id", "left").select(
        "doc_id", "n_rows", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "class_id", "doc_id").alias("component_id"))
    out = base.select("doc_id", F.col("n").alias("n_shingles")).join(of, "doc_id", "left")
    return out.select("doc_id", "n_shingles", "component_id", "class_id", "n_rows"), links


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns, with the smallest id of every component; a NULL id or a text without words
    stays. Of rows that repeat an id one stays."""
    kept = Kept(docs.sparkSession)
    members = kept.write(jaccard_join(docs, **options)[0].where("doc_id is not null").select("doc_id", "component_id", "n_rows").distinct())
    rest = without_ids(docs, members.where("doc_id <> component_id").select("doc_id"), "doc_id")
    again = members.where("n_rows > 1").select("doc_id")
    if again.isEmpty():
        return rest
    return rest.join(again, "doc_id", "left_anti").unionByName(rest.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
