"""Best-fit packing of token pieces with dominance reduction.

The packing problem depends on lengths alone, so Spark reduces the corpus to a histogram of at most `capacity`
rows; the plan is made on that histogram (its size does not grow with the corpus) and dealt back to the pieces by
their rank within their length. Ranks come from counts per (length, salt), so a length that a third of all pieces
share is numbered by many tasks.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import Kept, tidy

CAPACITY, END = 4096, 1
# Chunks that a Python worker remembers at most, apart from those of the texts at hand, and characters encoded in one go.
CACHE, AT_ONCE = 300_000, 2_000_000
# ASCII marks that end a word for the tokenizer wherever they follow a letter; an apostrophe may not.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Letters that stand for themselves once A-Z are lowered: no mark can join them, no other word begin between them.
LETTERS = "[a-zß-öø-ÿ]"
# Pieces that one numbering group holds on average.
NUMBERED = 200_000


def gathered(ids: np.ndarray, starts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of ids that begin at `starts`, those at these places, one after the other, and where each ends."""
    first, size = starts[place], starts[place + 1] - starts[place]
    ends = np.cumsum(size)
    return ids[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


class Encoder:
    """From texts to their ids as little-endian unsigned 32-bit bytes.

    Tokens never span white space, white space has no token, and letters are lower-cased, so a chunk between blanks
    is encoded once and remembered; a chunk of a word and closing marks is put together from the two. Chunks become
    numbers of distinct ones in Arrow, and their ids are gathered by those numbers. The vocabulary must be of such a
    kind (word ends, lower case, white space dropped)."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        # For words that need no normalizing and are not split: the same model without the patterns for that.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        spelled = self.words.get_vocab()
        self.closing = np.zeros(max(spelled.values()) + 1, bool)
        self.closing[[k for w, k in spelled.items() if w.endswith("</w>")]] = True
        # A chunk's place; by place, where its ids start in `ids`, and whether a later batch had it too.
        self.known: dict[str, int] = {}
        self.starts, self.ids, self.again = np.zeros(1, np.int64), np.zeros(0, "<u4"), np.zeros(0, bool)

    def forget(self) -> None:
        """Keep the chunks that came again since the last time."""
        place = np.flatnonzero(self.again)
        names = list(self.known)
        self.known = {names[p]: k for k, p in enumerate(place.tolist())}
        self.ids, ends = gathered(self.ids, self.starts, place)
        self.starts, self.again = np.append(0, ends), np.zeros(len(place), bool)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def coded(self, chunks: list[str]) -> Iterator[bytes]:
        """Ids of each chunk: many are encoded as one text, whose tokens are shared out by where they start."""
        for at in range(0, len(chunks), 20_000):
            some = chunks[at:at + 20_000]
            out = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(out.ids, "<u4").tobytes()
            starts = np.array(out.offsets, np.int64).reshape(-1, 2)[:, 0]
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            cuts = (4 * np.searchsorted(starts, ends)).tolist()
            yield from map(ids.__getitem__, map(slice, [0, *cuts], cuts))

    def plain(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of LETTERS and closing marks, one after the other, and how many each has.

        The letters are one word for the tokenizer and the marks another; a word's last token ends a word."""
        stems = pc.ascii_rtrim(chunks, MARKS)
        marked = pc.not_equal(pc.binary_length(stems), pc.binary_length(chunks))
        marks = pc.replace_substring_regex(chunks.filter(marked), f"^{LETTERS}+", "")
        words = pa.concat_arrays([stems, marks]).dictionary_encode()
        ids = [np.array(self.words.encode_batch_fast([" ".join(words.dictionary[at:at + 20_000].to_numpy(zero_copy_only=False))], add_special_tokens=False)[0].ids, "<u4")
               for at in range(0, len(words.dictionary), 20_000)]
        ids = np.concatenate([*ids, np.zeros(0, "<u4")])
        # The last place is empty, for chunks without marks.
        starts = np.concatenate([[0], np.flatnonzero(self.closing[ids]) + 1, [len(ids)]])
        spot = np.asarray(words.indices).astype(np.int64)
        pair = np.full((len(chunks), 2), len(words.dictionary))
        pair[:, 0] = spot[:len(chunks)]
        pair[np.asarray(marked), 1] = spot[len(chunks):]
        out, ends = gathered(ids, starts, pair.ravel())
        return out, np.diff(ends[1::2], prepend=0)

    def places(self, chunks: pa.Array) -> np.ndarray:
        """The place of each of these distinct chunks; new ones are encoded and get the next places."""
        known, names = self.known, chunks.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(known.get, names, itertools.repeat(-1)), np.int64, len(names))
        fresh = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(fresh):
            simple = np.asarray(pc.match_substring_regex(chunks.take(pa.array(fresh)), f"^{LETTERS}+[{re.escape(MARKS)}]*$"))
            fresh = np.concatenate([fresh[simple], fresh[~simple]])
            ids, sizes = self.plain(chunks.take(pa.array(fresh[:simple.sum()])))
            odd = list(self.coded([names[k] for k in fresh[simple.sum():].tolist()]))
            sizes = np.concatenate([sizes, np.fromiter(map(len, odd), np.int64, len(odd)) // 4])
            at[fresh] = np.arange(len(known), len(known) + len(fresh))
            known.update(zip(map(names.__getitem__, fresh.tolist()), at[fresh].tolist()))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids, np.frombuffer(b"".join(odd), "<u4")])
            self.again = np.append(self.again, np.zeros(len(fresh), bool))
        return at

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text; a NULL text is empty."""
        if len(self.known) > CACHE:
            self.forget()
        texts = texts.fill_null("")
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = pc.list_flatten(split).dictionary_encode()
        # White space at an end of a text leaves an empty chunk there, which has no ids.
        place = self.places(coded.dictionary)[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64)
        ids, ends = gathered(self.ids, self.starts, place)
        cuts = np.append(0, ends)[np.append(0, np.cumsum(pc.list_value_length(split)))]
        # A special token's spelling is met only in the text as it stands.
        special = np.asarray(pc.match_substring(texts, "<|"))
        for k, odd in enumerate(special.tolist()):
            yield self.whole(texts[k].as_py()) if odd else ids[cuts[k]:cuts[k + 1]].tobytes()


def encoded(encode: Encoder, texts: pa.Array) -> Iterator[bytes]:
    """Ids of a batch's texts, about AT_ONCE bytes at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
        yield from encode(texts[at:to])
        at = to


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every text's ids and an end id, cut at `capacity`.

    NULL and empty texts are the end id alone. Every row counts for itself, also with a repeated or NULL doc_id.
    Other columns are left out."""
    kind = "struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint" + (",ids:array<int>>" if with_ids else ">")

    @F.arrow_udf(f"array<{kind}>")
    @tidy
    def cut(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = Encoder(vocabulary)
        tail = np.array([end], "<u4").tobytes()
        for texts in parts:
            rows, offsets, blobs = [], [0], []
            for raw in encoded(encode, texts):
                raw += tail
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    blob = raw[at:at + 4 * capacity]
                    rows.append((piece, at // 4, len(blob) // 4, zlib.crc32(blob)))
                    if with_ids:
                        blobs.append(blob)
                offsets.append(len(rows))
            columns = list(zip(*rows)) or [(), (), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["piece", "start", "length", "ids_crc32"]
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(blobs), "<i4"), pa.int32())
                ends = np.cumsum([0, *(len(b) // 4 for b in blobs)])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                names.append("ids")
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, names))

    return docs.select(F.col(id_col).alias("doc_id"), F.explode(cut(F.col(text_col))).alias("p")).select("doc_id", "p.*")


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Fix bins that are provably part of some best packing; takes their items out of `counts`.

    For an item w, from the longest down, a set with w that no other feasible set can beat is fixed: w alone if
    nothing fits beside it; w with the longest item k that fits, if they fill the bin or no two items fit beside w;
    if two but no three items fit, w, k and the longest b beside both, provided that no feasible pair has both parts
    longer than b (every part of another set then has its place in this one). A step settles as many equal bins as
    the counts allow; items for which nothing dominates are left to best fit."""
    lengths, fixed = sorted(counts), []

    def take(times: int, *items: int) -> None:
        fixed.append((times, items))
        for w in items:
            counts[w] -= times
            if not counts[w]:
                del counts[w]
                lengths.pop(bisect.bisect_left(lengths, w))

    def least(from_index: int, n: int) -> int:
        """Sum of the n shortest items from an index on; more than a bin if there are not as many."""
        total = 0
        for w in lengths[from_index:from_index + n]:
            some = min(n, counts[w])
            total, n = total + some * w, n - some
            if not n:
                return total
        return 3 * capacity + 1

    at = len(lengths) - 1
    while at >= 0 and lengths:
        at = min(at, len(lengths) - 1)
        w = lengths[at]
        n, room = counts[w], capacity - w
        fit = bisect.bisect_right(lengths, room) - 1
        if fit >= 0 and lengths[fit] == w and n == 1:
            fit -= 1
        if fit < 0:
            take(n, w)
            at -= 1
            continue
        k = lengths[fit]
        if k == room or least(0, 2) > room:
            take(n // 2, w, w) if k == w else take(min(n, counts[k]), w, k)
            continue
        if least(0, 3) > room:
            spot = bisect.bisect_right(lengths, room - k) - 1
            if spot >= 0 and least(spot + 1, 2) > room:
                items = (w, k, lengths[spot])
                times = min(counts[x] // items.count(x) for x in items)
                if times:
                    take(times, *items)
                    continue
        at -= 1
    return fixed


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(how many bins, lengths in one of them) for the counts of every length: reduction, then best fit decreasing.

    Equal bins are kept as one row with a number, so work and result depend on the different lengths, not on how
    many pieces there are."""
    counts = {w: n for w, n in histogram.items() if n > 0}
    done = [(counts.pop(capacity), (capacity,))] if capacity in counts else []
    done += reduce_by_dominance(counts, capacity)
    open_bins: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, times: int, items: tuple[int, ...]) -> None:
        if room == 0:
            done.append((times, items))
            return
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        open_bins[room].append([times, items])

    for w in sorted(counts, reverse=True):
        left = counts[w]
        while left:
            spot = bisect.bisect_left(rooms, w)
            if spot == len(rooms):
                # New bins take as many of this length as fit, the rest goes in one bin.
                each = capacity // w
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * w, full, (w,) * each)
                if rest:
                    put(capacity - rest * w, 1, (w,) * rest)
                left = 0
                continue
            room = rooms[spot]
            times, items = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(spot)
            each = min(room // w, left)
            used = min(times, left // each)
            put(room - each * w, used, items + (w,) * each)
            if times > used:
                put(room, times - used, items)
            left -= used * each
    return done + [(t, items) for group in open_bins.values() for t, items in group]


def slots(plan: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """The plan as runs: ranks of a length from `rank` on go to bins from `bin` on, at `offset`; one run per place."""
    first, seen, runs = 0, {}, []
    for times, items in plan:
        offset = 0
        for w in items:
            runs.append((w, seen.get(w, 0), first, offset))
            seen[w] = seen.get(w, 0) + times
            offset += w
        first += times
    runs.sort()
    columns = zip(*runs) if runs else [()] * 4
    return {n: np.array(c, np.int64) for n, c in zip(("length", "rank", "bin", "offset"), columns)}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with sequence_id and offset: as few sequences of at most `capacity` tokens as the method finds.

    Lengths must be between 1 and `capacity`. Pieces of one length may change places without changing the number
    of sequences, so ties take any order; an empty table gives an empty table. `pieces` is written once to the
    shared folder."""
    kept = Kept(pieces.sparkSession)
    # The salt is written with its row: a piece that is read again belongs to the same group.
    base = kept.write(pieces.withColumn("_salt", F.floor(F.rand(1) * (1 << 30))))
    # A row per length, `capacity` at most, however many pieces there are.
    histogram = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= w <= capacity for w in histogram):
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    runs = slots(plan_bins(histogram, capacity))
    salts = -(-sum(histogram.values()) // NUMBERED) or 1
    dealt = base.withColumn("_salt", F.col("_salt") % salts)
    sizes = dealt.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")
    ranked = dealt.withColumn("_at", F.row_number().over(order) - 1).join(starts, ["length", "_salt"])

    # Runs of a length are found by a search on length * 2^40 + rank.
    keys = runs["length"] * (1 << 40) + runs["rank"]

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        w, r = np.asarray(length), np.asarray(rank)
        run = np.searchsorted(keys, w * (1 << 40) + r, side="right") - 1
        ids = runs["bin"][run] + r - runs["rank"][run]
        return pa.StructArray.from_arrays([pa.array(ids), pa.array(runs["offset"][run])], ["sequence_id", "offset"])

    placed = ranked.withColumn("_to", place(F.col("length"), (F.col("_at") + F.col("_before")).cast("bigint")))
    return placed.select(*pieces.columns, F.col("_to.sequence_id").alias("sequence_id"), F.col("_to.offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that carry their ids: the token sequences to train on."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def best_fit_packing(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document with their sequence and place in it; see `token_pieces` and `pack`."""
    return pack(token_pieces(docs, vocabulary or default_vocabulary(), capacity, with_ids=with_ids), capacity)
