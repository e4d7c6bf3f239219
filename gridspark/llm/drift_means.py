"""Exact k-means on integer vectors in which most rows keep their centroid without a look at all of them.

Each row carries an upper bound of the distance to its own centroid and a lower bound of the distance to any other.
When centroids move, the lower bounds of a cluster's rows are loosened by how much nearer a moved centroid can come to
any point of the sphere that holds the cluster, found by planar geometry, and not by the whole length of its move. A row
whose bounds still part is settled; only the others are scanned against all centroids, in exact integers, with ties to the
smaller number. So the result is that of plain rounds.

The driver holds the centroids and one row of sums per cluster; rows stay in written tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import Kept

#: Components of a vector and their integers per unit.
WIDTH, SCALE = 64, 64
#: Beyond this size of an integer component a squared distance would not fit the 64-bit results.
LARGEST = 1 << 27
#: Up to this size, products of integers are exact in doubles.
EXACT = 1 << 22
#: Bounds part only by more than this share, so that rounding never settles a row.
SLACK = 1e-9
STATE = "id bigint, v array<int>, cluster int, upper double, lower double, distance bigint, scans int"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of every component, of the rows with `width` components, none NULL or non-finite.

    Components whose integer is beyond 2^27 either way have no 64-bit distance; their rows are left out."""
    x = F.col("x")
    whole = (F.size("x") == width) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float(LARGEST // scale)))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.where(F.coalesce(whole, F.lit(False))).select("id", F.transform(x, lambda e: F.floor(e * scale).cast("int")).alias("v"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows and centroids."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def two_nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid (smallest of equals), its squared distance and the next centroid's."""
    far = squared(x, c)
    best, at = far.argmin(1), np.arange(len(x))
    own = far[at, best]
    if len(c) == 1:
        return best, own, np.full(len(x), np.iinfo(np.int64).max)
    far[at, best] = np.iinfo(np.int64).max
    return best, own, far.min(1)


def nearer_at_most(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """A bound of |x - old| - |x - new| over the points x of a sphere, at most the length of the move; it can be negative.

    The difference only depends on x in the plane through the sphere's centre and the move's line. With the middle of
    the move as origin and its direction as axis, points of equal difference are hyperbolas with foci in old and new.
    A point seen from the origin at an angle below a right one has a difference of at most the move's length times the cosine of
    that angle, since the hyperbola stays inside its asymptotes. The difference also is twice the move's length times the
    coordinate along the axis, divided by the sum of both distances."""
    move = float(np.linalg.norm(new - old))
    if move == 0:
        return 0.0
    axis, arm = (new - old) / move, centre - (old + new) / 2
    along, reach = float(axis @ arm), float(np.linalg.norm(arm))
    most, total = along + radius, float(np.linalg.norm(centre - old) + np.linalg.norm(centre - new))
    if most <= 0:
        return 2 * move * most / (total + 2 * radius)
    bounds = [move]
    if reach > radius:
        angle = np.arccos(np.clip(along / reach, -1, 1)) - np.arcsin(min(1.0, radius / reach))
        bounds.append(move * float(np.cos(np.clip(angle, 0, np.pi / 2))))
    bounds.append(2 * move * most / max(move, total - 2 * radius))
    return min(bounds)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, how much nearer any other moved centroid can come to one of its rows."""
    k = len(old)
    return np.array([max((nearer_at_most(old[i], radius[i], old[j], new[j]) for j in range(k) if j != i), default=0.0) for i in range(k)])


def first_pass(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """All rows scanned against all centroids."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch["v"].flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
                best, own, other = two_nearest(x, centroids)
                yield state(batch, best, np.sqrt(own), np.sqrt(other.astype(np.float64)), own, np.ones(len(x), int))

    return rows.mapInArrow(scan, STATE)


def state(batch: pa.RecordBatch, cluster, upper, lower, distance, scans) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        batch["id"], batch["v"], pa.array(cluster, pa.int32()), pa.array(upper, pa.float64()), pa.array(lower, pa.float64()),
        pa.array(distance, pa.int64()), pa.array(scans, pa.int32()),
    ], ["id", "v", "cluster", "upper", "lower", "distance", "scans"])


def next_pass(rows: DataFrame, old: np.ndarray, new: np.ndarray, loose: np.ndarray, last: bool) -> DataFrame:
    """Rows after the centroids have moved: bounds first, then the own centroid, then all of them. The last pass gives
    settled rows their distances too."""
    moved = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["v"].flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            cluster, upper, lower, scans = (batch[c].to_numpy().copy() for c in ("cluster", "upper", "lower", "scans"))
            distance = batch["distance"].to_numpy().copy()
            upper += moved[cluster]
            lower = np.maximum(lower - loose[cluster], 0.0)
            parted = lambda at: upper[at] * (1 + SLACK) + SLACK < lower[at] * (1 - SLACK)
            open_ = np.flatnonzero(~parted(slice(None)))
            if len(open_):
                # The exact distance to the own centroid settles many of them.
                distance[open_] = ((x[open_] - new[cluster[open_]]) ** 2).sum(1)
                upper[open_] = np.sqrt(distance[open_])
                open_ = open_[~parted(open_)]
            if len(open_):
                cluster[open_], distance[open_], other = two_nearest(x[open_], new)
                upper[open_], lower[open_] = np.sqrt(distance[open_]), np.sqrt(other.astype(np.float64))
                scans[open_] += 1
            if last:
                distance = ((x - new[cluster]) ** 2).sum(1)
            yield state(batch, cluster, upper, lower, distance, scans)

    return rows.mapInArrow(settle, STATE)


def sums(rows: DataFrame, k: int, width: int) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
    """(rows, exact sums of components, radius) of each cluster, added up per task first; a row per cluster
    and component reaches the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, radius = np.zeros((k, width), np.int64), np.zeros(k, np.int64), np.zeros(k)
        for batch in batches:
            x = batch["v"].flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, width), np.int64)
            cluster = batch["cluster"].to_numpy()
            for c in np.unique(cluster):
                total[c] += x[cluster == c].sum(0)
            count += np.bincount(cluster, minlength=k)
            np.maximum.at(radius, cluster, batch["upper"].to_numpy())
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(has, pa.int32()), pa.array(count[has]), pa.array(radius[has]), pa.array(total[has].tolist(), pa.list_(pa.int64())),
        ], ["cluster", "count", "radius", "total"])

    parts = rows.select("v", "cluster", "upper").mapInArrow(part, "cluster int, count bigint, radius double, total array<bigint>")
    count, total, radius = np.zeros(k, np.int64), [[0] * width for _ in range(k)], np.zeros(k)
    parts = parts.select("cluster", "count", "radius", F.posexplode("total").alias("p", "x")).groupBy("cluster", "p")
    for r in parts.agg(F.sum("count").alias("n"), F.max("radius").alias("radius"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        count[r["cluster"]], radius[r["cluster"]], total[r["cluster"]][r["p"]] = r["n"], r["radius"], int(r["x"])
    return count, total, radius


def k_means(
    vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH,
    scale: int = SCALE,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans) of every usable row.

    Usable rows are those of `quantised`. Centroids start as the `k` rows with the smallest SHA-256 of `seed:id`, fewer
    if there are fewer; of rows that repeat an id, smaller vectors come first, and a row with a NULL id is clustered
    but is no start unless there are too few others. In each round a centroid with rows becomes the floor of their mean,
    one without stays. `scans` counts the rounds in which a row was compared with all centroids. Equal rows fall
    together; an empty table gives an empty table; other columns are left out. A sum of distances beyond 64 bits is NULL."""
    kept = Kept(vectors.sparkSession)
    rows = kept.write(quantised(vectors, id_col, vector_col, width, scale))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    # `k` rows come to the driver.
    first = rows.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), width)
    if not len(first):
        # One centroid that no row meets keeps the columns' types.
        centroids = np.zeros((1, width), np.int64)
    now = kept.write(first_pass(rows, centroids))
    kept.drop(rows)
    for n in range(rounds):
        count, total, radius = sums(now, len(centroids), width)
        moved = centroids.copy()
        for c in np.flatnonzero(count):
            moved[c] = [t // int(count[c]) for t in total[c]]
        after = kept.write(next_pass(now, centroids, moved, loosening(centroids.astype(float), moved.astype(float), radius), n == rounds - 1))
        kept.drop(now)
        centroids, now = moved, after
    found = {r["cluster"]: r["s"] for r in now.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}  # a row per centroid
    each = [found.get(c) for c in range(len(centroids))]
    inertia = None if None in found.values() or sum(found.values()) >= 1 << 63 else sum(found.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return now.select(
        F.col("id").alias("vec_id"), "cluster", "distance", of(each, "bigint").alias("cluster_inertia"), F.lit(inertia).cast("bigint").alias("inertia"),
        of(digests, "string").alias("centroid_sha256"), "scans",
    )
