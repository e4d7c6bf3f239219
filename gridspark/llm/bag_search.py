"""Ranked lexical search that scores each different bag of query words once.

Documents are cut down to the words of the items. Two documents with the same counts of those words and the same length
factor `m` have the same score for every item, so they are one class: classes are found by a hash and told apart by the
counts themselves, scored once, and opened up again into their documents, smallest doc_id first.

One pass over the texts writes a row of counts per document; df, N and L come from those rows. Each task keeps its best
classes of every item, so what is shuffled does not grow with the classes. Items are taken in blocks of bounded size,
each block against all documents; so the words sent to the tasks are bounded too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import Kept, words

#: Items of a block and bytes of their texts, about: blocks are dealt by a hash of the item.
ITEMS, ITEM_BYTES = 1024, 8 << 20
#: Doubles add integers exactly below this.
EXACT = 1 << 53


def item_counts(texts: list[tuple[int, str | None]]) -> tuple[dict[bytes, int], list[int], list[Counter]]:
    """(number of each word, item ids, counts of word numbers per item) of a block's items."""
    number: dict[bytes, int] = {}
    ids, counts = [], []
    for item, text in texts:
        ids.append(item)
        counts.append(Counter(number.setdefault(w, len(number)) for w in words((text or "").encode())))
    return number, ids, counts


def bags(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs): all words of a text counted, and the counts of those that have a number, by number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch["text"].cast(pa.large_binary()):
                found = words(text.as_py())
                sizes.append(len(found))
                tf = sorted((number[w], c) for w, c in Counter(found).items() if w in number)
                terms.extend(t for t, _ in tf)
                tfs.extend(c for _, c in tf)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(a, kind)) for a, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def classes(rows: DataFrame) -> DataFrame:
    """(h, m, terms, tfs, first): documents of equal counts and m, with the smallest doc_id. Rows of equal hash `h` but
    other counts stay apart."""
    return rows.groupBy("h", "m", "terms", "tfs").agg(F.min("doc_id").alias("first"))


def scored(found: DataFrame, df: np.ndarray, total: int, counts: list[Counter], k: int) -> DataFrame:
    """(item, score, first, h, m, terms, tfs) of each task's `k` best classes for every item (number in the block); equal
    scores by the smallest doc_id."""
    weight = np.floor(1000 * np.log((2 * total + 2) / (2 * df + 1))).astype(np.int64)
    # Postings of the items: for each word, the items that have it and what one occurrence in a document is multiplied by.
    posts = sorted((t, i, c) for i, tf in enumerate(counts) for t, c in tf.items())
    term, item, times = (np.array([p[j] for p in posts], np.int64) for j in range(3))
    gain, start = times * weight[term], np.searchsorted(term, np.arange(len(df) + 1))
    # A document's share of a word is below 10^6.
    exact = max((np.bincount(item, gain * 1e6, len(counts)).max() if len(item) else 0), 0) < EXACT

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch["terms"].value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), size)
            t, tf = batch["terms"].flatten().to_numpy(), batch["tfs"].flatten().to_numpy()
            share = (1_000_000_000 * tf) // (1000 * tf + 8 * batch["m"].to_numpy()[row])
            many = start[t + 1] - start[t]
            at = np.repeat(start[t], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            cell, add = np.repeat(row, many) * len(counts) + item[at], np.repeat(share, many) * gain[at]
            if exact:
                grid = np.bincount(cell, add, batch.num_rows * len(counts)).astype(np.int64)
            else:
                grid = np.zeros(batch.num_rows * len(counts), np.int64)
                np.add.at(grid, cell, add)
            grid = grid.reshape(batch.num_rows, len(counts))
            if batch.num_rows > k:
                bar = np.partition(grid, batch.num_rows - k, 0)[batch.num_rows - k]
                r, i = np.nonzero((grid >= bar) & (grid > 0))
            else:
                r, i = np.nonzero(grid)
            new = pa.Table.from_batches([batch.take(pa.array(r))]).append_column("item", pa.array(i, pa.int32())).append_column("score", pa.array(grid[r, i]))
            best = top(new if best is None else pa.concat_tables([best, new]), k)
        if best is not None:
            yield from best.select(["item", "score", "first", "h", "m", "terms", "tfs"]).combine_chunks().to_batches()

    return found.mapInArrow(score, "item int, score bigint, first bigint, h bigint, m bigint, terms array<int>, tfs array<bigint>")


def top(rows: pa.Table, k: int) -> pa.Table:
    """The `k` rows of each item with the highest score, equal ones by `first`."""
    item, score, first = (rows[c].to_numpy() for c in ("item", "score", "first"))
    order = np.lexsort((first, -score, item))
    place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
    return rows.take(pa.array(order[place < k]))


def search_block(docs: DataFrame, texts: list[tuple[int, str | None]], k: int, kept: Kept, id_col: str, text_col: str) -> DataFrame:
    """(item_id, rank, doc_id, score) for the items of one block."""
    number, ids, counts = item_counts(texts)
    rows = kept.write(bags(docs, number, id_col, text_col))
    sizes = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    total, length = int(sizes[0]), int(sizes[1] or 0)
    df = np.zeros(len(number), np.int64)
    # A row per word of the block.
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        df[r["t"]] = r["df"]
    m = F.expr(f"100 - 75 + ((75 * n * {total}L) div {max(length, 1)}L)")
    held = rows.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0)).withColumn("m", m).withColumn("h", F.xxhash64("m", "terms", "tfs"))
    same = ["h", "m", "terms", "tfs"]
    order = Window.partitionBy("item").orderBy(F.desc("score"), "first")
    best = scored(classes(held), df, total, counts, k).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place", "first")
    best = kept.write(best)
    # At most k classes per item are opened, and of each its k smallest ids.
    hashes = best.select("h").distinct()
    member = Window.partitionBy(*same).orderBy("doc_id")
    members = held.join(F.broadcast(hashes), "h", "left_semi").withColumn("place", F.row_number().over(member)).where(F.col("place") <= k).select(*same, "doc_id")
    rank = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    listed = best.join(members, same).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    item_id = F.element_at(F.lit(ids), F.col("item") + 1)
    out = kept.write(listed.select(item_id.cast("bigint").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    kept.drop(rows, best)
    return out


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text",
    items_at_once: int = ITEMS, bytes_at_once: int = ITEM_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` documents with the highest score above 0 of every item, equal scores by
    ascending doc_id.

    Words are runs of letters and digits, all characters beyond ASCII included, A-Z lower-cased; a NULL text has none.
    With N documents that have words, L words in all, n in a document, df documents with a word and tf of them in the
    document, m is 100 - 75 + (75 n N div L), a word weighs floor(1000 ln((2 N + 2) / (2 df + 1))), and a document's
    score adds weight * (10^9 tf div (1000 tf + 8 m)) over the item's words, repeats included.

    A document with a NULL id counts in N, L and df and is never listed; rows that repeat an id are documents of their own. An
    item with a NULL id is left out, one that repeats takes its smallest text, one without words or without a match has
    no rows. An empty table on either side gives an empty table; other columns are left out."""
    spark, kept = docs.sparkSession, Kept(docs.sparkSession)
    asked = kept.write(
        items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(query_col).alias("q")).where("item_id is not null").groupBy("item_id").agg(F.min("q").alias("q"))
    )
    size = asked.agg(F.count("*"), F.sum(F.octet_length("q"))).first()
    blocks = max(1, -(-size[0] // items_at_once), -(-int(size[1] or 0) // bytes_at_once))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        texts = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()]  # one block
        if texts:
            out = out.union(search_block(docs, texts, k, kept, id_col, text_col))
    kept.drop(asked)
    return out
