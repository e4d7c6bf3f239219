"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample and every vector is put into a leaf. A query visits leaves in the order of a
priority queue over the tree's nodes. How many leaves are visited is calibrated: a bounded set of queries is answered
exactly against all vectors, block by block, and the visits widen until the wanted recall is reached on them. A query
whose leaves hold fewer than k vectors besides itself goes on to further leaves. Queries
and candidates of a leaf meet in blocks of bounded size; a leaf that holds a third of all vectors is many blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import Kept
from gridspark.llm.vectors import distinct_vectors, matrix, sample_matrix

#: Vectors that the tree is fitted on, children of a node, and vectors of the sample in a leaf, at most.
BOUND, BRANCH, LEAF = 20_000, 8, 64
#: Queries of the calibration, at most, and the recall that they have to reach.
PROBES, RECALL = 128, 0.97
#: Candidates and queries in a block.
BLOCK, QUERIES = 4096, 1024


@dataclass
class Tree:
    """Centres of all nodes, children of each node (none for a leaf) and the number of each leaf."""

    centres: np.ndarray
    children: list[list[int]]
    leaf_of: dict[int, int]

    @property
    def leaves(self) -> int:
        return len(self.leaf_of)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit row: down the tree to the nearest child."""
        at, out = {0: np.arange(len(x))}, np.zeros(len(x), np.int64)
        while at:
            below: dict[int, np.ndarray] = {}
            for node, rows in at.items():
                kids = self.children[node]
                if not kids:
                    out[rows] = self.leaf_of[node]
                    continue
                near = np.argmax(x[rows] @ self.centres[kids].T - 0.5 * (self.centres[kids] ** 2).sum(1), 1)
                for k, kid in enumerate(kids):
                    if (near == k).any():
                        below[kid] = rows[near == k]
            at = below
        return out

    def visits(self, q: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first `most` leaves of a query, and further ones until those hold (`held`, by leaf) `least` vectors; best
        bin first: the node nearest to the query, of all seen, is opened next."""
        heap, out, got = [(0.0, 0)], [], 0
        while heap and (len(out) < most or held is not None and got < least):
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if not kids:
                out.append(self.leaf_of[node])
                got += int(held[out[-1]]) if held is not None else 0
                continue
            far = ((self.centres[kids] - q) ** 2).sum(1)
            for d, kid in zip(far.tolist(), kids):
                heapq.heappush(heap, (d, kid))
        return out


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Labels of rows by Lloyd's rounds from random rows."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = np.argmax(x @ centres.T - 0.5 * (centres ** 2).sum(1), 1)
        for j in range(k):
            if (label == j).any():
                centres[j] = x[label == j].mean(0)
    return np.argmax(x @ centres.T - 0.5 * (centres ** 2).sum(1), 1)


def grow(x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF) -> Tree:
    """The tree of a sample of unit rows."""
    rng = np.random.default_rng(3)
    centres, children, leaf_of = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [[]], {}
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        label = k_means(x[rows], branch, rng) if len(rows) > max(leaf, branch) else np.zeros(len(rows), int)
        parts = [rows[label == j] for j in range(branch) if (label == j).any()]
        if len(parts) < 2:
            leaf_of[node] = len(leaf_of)
            continue
        for part in parts:
            centres.append(x[part].mean(0))
            children.append([])
            children[node].append(len(centres) - 1)
            todo.append((len(centres) - 1, part))
    return Tree(np.array(centres), children, leaf_of)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def best_of(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine) of the k nearest rows of a block for every query but itself, ties to smaller ids.

    The product of the blocks picks what comes near the k-th; those are scored anew, pair by pair, so that equal
    vectors have equal scores."""
    near = unit(queries) @ unit(x).T
    near[query_ids[:, None] == ids[None, :]] = -np.inf
    k = min(k, len(ids))
    bar = np.partition(near, len(ids) - k, 1)[:, len(ids) - k] - 1e-9
    row, col = np.nonzero((near >= bar[:, None]) & np.isfinite(near))
    a, b = queries[row], x[col]
    score = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return query_ids[row[keep]], ids[col[keep]], score[keep]


def visits_needed(tree: Tree, rows: DataFrame, probes: DataFrame, k: int, bound: int, recall: float) -> int:
    """Leaves to visit so that a share `recall` of the probes' exact neighbours lies in them, over all `rows`."""
    picked = probes.orderBy(F.xxhash64("id"), "id").limit(bound).toPandas()  # `bound` rows at most
    if not len(picked):
        return tree.leaves
    queries, query_ids = np.array(picked["v"].tolist(), float), picked["id"].to_numpy(np.int64)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch["v"], queries.shape[1])
                q, i, s = best_of(queries, query_ids, x, batch["id"].to_numpy(), k)
                where = dict(zip(batch["id"].to_pylist(), tree.assign(unit(x)).tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s), pa.array([where[v] for v in i.tolist()], pa.int64())], ["q", "id", "s", "leaf"])

    top = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    true = rows.select("id", "v").mapInArrow(exact, "q long, id long, s double, leaf long").withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("q", "leaf").collect()
    order = {i: {leaf: n for n, leaf in enumerate(tree.visits(v, tree.leaves))} for i, v in zip(query_ids.tolist(), unit(queries))}
    places = sorted(order[r["q"]][r["leaf"]] for r in true)
    return places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)] + 1 if places else tree.leaves


def nearest(
    vectors: DataFrame, queries: Column, k: int = 5, recall: float = RECALL, bound: int = BOUND, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found of every row that `queries` (on column id) selects.

    Score is the cosine in double precision; ties go to the smaller id; a query with fewer candidates gets all of
    them. NULL, zero or non-finite vectors, those of another length than most and NULL ids take no part; rows that
    repeat an id are one vector. An empty table gives an empty table. Other columns are left out."""
    kept = Kept(vectors.sparkSession)
    rows = kept.write(distinct_vectors(vectors, id_col, vector_col))
    tree = grow(sample_matrix(rows, bound))
    asked = rows.where(queries)
    most = visits_needed(tree, rows, asked, k, PROBES, recall)

    @F.arrow_udf("int")
    def leaf(lists: pa.Array) -> pa.Array:
        return pa.array(tree.assign(unit(matrix(lists, tree.centres.shape[1]))) if len(lists) else [], pa.int32())

    placed = kept.write(rows.withColumn("leaf", leaf("v")))
    counts = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row per leaf
    held = np.zeros(tree.leaves, np.int64)
    for r in counts.collect():
        held[r["leaf"]] = r["n"]
    counts = counts.drop("n")

    @F.arrow_udf("array<int>")
    def order(lists: pa.Array) -> pa.Array:
        return pa.array([tree.visits(q, most, held, k + 1) for q in unit(matrix(lists, tree.centres.shape[1]))] if len(lists) else [], pa.list_(pa.int32()))

    candidates = placed.join(F.broadcast(counts), "leaf").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # As few query rows as there are (leaf, block, part) groups that they have to meet.
    share = max(1, -(-asked.count() // QUERIES))
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(share)).cast("int")
    met = (
        placed.where(queries).select(F.col("id").alias("q"), F.col("v").alias("qv"), part.alias("part"), F.explode(order("v")).alias("leaf")).join(F.broadcast(counts), "leaf")
        .withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    )
    given = candidates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(share - 1))))

    def search(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(there):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        q, i, s = best_of(np.stack(asking["qv"]).astype(float), asking["q"].to_numpy(), np.stack(there["v"]).astype(float), there["id"].to_numpy(), k)
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    keys = ["leaf", "block", "part"]
    found = met.select("q", "qv", *keys).groupBy(*keys).cogroup(given.select("id", "v", *keys).groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
