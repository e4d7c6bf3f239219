"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned (on a bounded sample) that makes the signs of the coordinates a balanced binary code. A code is
cut into the keys of a few tables. A vector looks up its own key in each table and those with unsure bits flipped, as
far as the squared coordinates behind the flipped bits stay within a budget. Budget and Hamming radius are calibrated
on pairs made to have exactly the threshold's cosine. What meets is decided by the cosine of the original vectors.

Groups of copies do not meet pair by pair: equal vectors are one node, and nodes within half the threshold's angle of
a leader are one class, linked among themselves by the triangle inequality of angles. Between classes, leaders and the
classes' widths decide where they can; only what is left is compared member by member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import Kept, components
from gridspark.llm.vectors import cosine, distinct_vectors, matrix, sample_matrix

#: Vectors that the rotation is learned on, at most; bits of a code at most; rounds of the quantisation.
BOUND, BITS, ROUNDS = 10_000, 64, 40
#: Share of pairs at the threshold that the calibrated budget and radius may miss.
MISS = 0.0002


@dataclass
class Codes:
    """Centre, rotation, bits of each table, budget of flipped squares and Hamming radius."""

    centre: np.ndarray
    rotation: np.ndarray
    cuts: list[tuple[int, int]]
    budget: float
    radius: int

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        """Rotated coordinates of unit rows."""
        return (x / np.sqrt((x * x).sum(1, keepdims=True)) - self.centre) @ self.rotation


def quantisation(x: np.ndarray, bits: int) -> np.ndarray:
    """The rotation of the first principal directions that brings rows closest to corners of a cube."""
    if len(x) < 2:
        return np.eye(x.shape[1])[:, :bits]
    _, _, axes = np.linalg.svd(x[: 50 * x.shape[1]] if len(x) > 50 * x.shape[1] else x, full_matrices=True)
    axes = axes[:bits].T
    v = x @ axes
    r = np.linalg.qr(np.random.default_rng(5).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(ROUNDS):
        u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def fit(vectors: DataFrame, reach: float, tables: int, bound: int = BOUND) -> Codes:
    """Learn the codes of vectors (id, v) and calibrate the search for a cosine of at least `reach`."""
    x = sample_matrix(vectors, bound)
    centre = x.mean(0) if len(x) else np.zeros(x.shape[1])
    rotation = quantisation(x - centre, min(BITS, x.shape[1]))
    bits = rotation.shape[1]
    edges = np.linspace(0, bits, min(tables, bits) + 1).astype(int).tolist()
    codes = Codes(centre, rotation, list(zip(edges, edges[1:])), 0.0, bits)
    if len(x):
        rng = np.random.default_rng(11)
        a = x[rng.integers(0, len(x), 40_000)]
        side = rng.normal(size=a.shape)
        side -= (side * a).sum(1, keepdims=True) * a
        side /= np.maximum(np.sqrt((side * side).sum(1, keepdims=True)), 1e-12)
        b = reach * a + math.sqrt(1 - reach * reach) * side
        p, q = codes.coordinates(a), codes.coordinates(b)
        apart = (p > 0) != (q > 0)
        # A pair meets in a table if one side's flips of the bits that differ are within the budget.
        cost = [np.minimum(*((np.where(apart, s * s, 0)[:, i:j]).sum(1) for s in (p, q))) for i, j in codes.cuts]
        codes.budget = float(np.quantile(np.min(cost, 0), 1 - MISS))
        codes.radius = int(np.quantile(apart.sum(1), 1 - MISS / 4)) + 1
    return codes


def flips(squares: np.ndarray, budget: float) -> np.ndarray:
    """Bit masks over a table's bits whose squares sum to at most the budget, no mask included."""
    masks, sums = np.zeros(1, np.int64), np.zeros(1)
    for bit in np.argsort(squares):
        if squares[bit] > budget:
            break
        more = sums + squares[bit]
        ok = more <= budget
        masks, sums = np.concatenate([masks, masks[ok] | (1 << int(bit))]), np.concatenate([sums, more[ok]])
    return masks


def coded(v: str | Column, codes: Codes) -> Column:
    """struct<code, keys, probes>: the code as a number, the key in each table, and the keys to look up."""

    @F.arrow_udf("struct<code:bigint,keys:array<bigint>,probes:array<bigint>>")
    def take(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in parts:
            c = codes.coordinates(matrix(lists, len(codes.centre)))
            bits = (c > 0).astype(np.uint64)
            code = (bits << np.arange(bits.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)
            keys, probes = [[] for _ in c], [[] for _ in c]
            for t, (i, j) in enumerate(codes.cuts):
                own = ((bits[:, i:j] << np.arange(j - i, dtype=np.uint64)).sum(1, dtype=np.uint64)).astype(np.int64)
                for row, (key, squares) in enumerate(zip(own.tolist(), c[:, i:j] ** 2)):
                    keys[row].append(key << 8 | t)
                    probes[row].append((flips(squares, codes.budget) ^ key) << 8 | t)
            flat = lambda rows: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)))
            yield pa.StructArray.from_arrays([pa.array(code), flat(keys), flat([np.concatenate(p) for p in probes])], ["code", "keys", "probes"])

    return take(F.col(v) if isinstance(v, str) else v)


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def tables_for(n: int) -> int:
    """Tables whose keys keep about one vector each: 16 bits up to 2^18 vectors, 21 up to 2^23, then 32."""
    return 4 if n <= 1 << 18 else 3 if n <= 1 << 23 else 2


def near_duplicates(vectors: DataFrame, reach: float = 0.9, tables: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for every row of `vectors`: vec_id, n_links, component_id, kept, class_id.

    Two vectors link if their cosine, in double precision, is at least `reach`. class_id is the smallest id of the
    class of near copies. NULL, zero or non-finite vectors (and those of another length than most) link with nothing;
    their component is their own id. Rows that repeat an id count as one vector; a NULL id has NULL results and is not
    kept. Other columns are left out."""
    kept = Kept(vectors.sparkSession)
    limit = math.acos(reach)
    half = math.cos(limit / 2) + 1e-9
    one = distinct_vectors(vectors, id_col, vector_col)
    copies = kept.write(one.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("mult")).join(one, "v").select("id", "node", "mult", "v"))
    nodes = copies.where("id = node").select("id", "mult", "v")
    many = nodes.count()
    codes = fit(nodes, reach, tables or tables_for(many))
    nodes = kept.write(nodes.withColumn("c", coded("v", codes)).select("id", "mult", "v", "c.*"))
    base = nodes.select("id", "code", F.explode("keys").alias("key"))
    probe = nodes.select("id", "code", F.explode("probes").alias("key"))

    # Leaders: the smallest id in one of the keys looked up, near enough, that has no leader itself.
    least = base.groupBy("key").agg(F.min(F.struct("id", "code")).alias("l")).select("key", F.col("l.id").alias("lead"), F.col("l.code").alias("lead_code"))
    met = probe.join(least.hint("shuffle_hash"), "key").where((F.col("lead") < F.col("id")) & (hamming("code", "lead_code") <= codes.radius)).select("id", "lead").distinct()
    vector = lambda name: nodes.select(F.col("id").alias(name), F.col("v").alias(f"v_{name}"))
    led = kept.write(met.join(vector("id"), "id").join(vector("lead"), "lead").select("id", "lead", cosine("v_id", "v_lead").alias("cos")).where(F.col("cos") >= half))
    heads = nodes.select(F.col("id").alias("lead")).join(led.select(F.col("id").alias("lead")).distinct(), "lead", "left_anti")
    chosen = led.join(heads, "lead").groupBy("id").agg(F.min(F.struct("lead", "cos")).alias("l"))
    classed = nodes.join(chosen, "id", "left").select(
        "id", "mult", "v", "code", "keys", "probes", F.coalesce("l.lead", "id").alias("cls"),
        F.coalesce(F.acos(F.least(F.col("l.cos"), F.lit(1.0))), F.lit(0.0)).alias("angle"),
    )
    classed = kept.write(classed)
    sizes = classed.groupBy("cls").agg(F.max("angle").alias("wide"), F.sum("mult").alias("weight"), F.count("*").alias("members"))
    sizes = kept.write(sizes.join(classed.select(F.col("id").alias("cls"), "v"), "cls"))

    # Classes that meet in a table; a class of several nodes looks up and is found under each key once.
    single = classed.join(sizes.select("cls", "members"), "cls")
    def entries(keys: str) -> DataFrame:
        alone = single.where("members = 1").select("cls", "code", F.explode(keys).alias("key"))
        group = single.where("members > 1").select("cls", F.explode(keys).alias("key")).distinct()
        return alone.unionByName(group, allowMissingColumns=True)

    found = entries("probes").join(entries("keys").toDF("cls2", "code2", "key").hint("shuffle_hash"), "key")
    near = F.coalesce(hamming("code", "code2") <= codes.radius, F.lit(True))
    pairs = found.where((F.col("cls") != F.col("cls2")) & near).select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")).distinct()
    side = lambda x: sizes.select(F.col("cls").alias(x), F.col("v").alias(f"v_{x}"), F.col("wide").alias(f"w_{x}"), F.col("weight").alias(f"n_{x}"), F.col("members").alias(f"m_{x}"))
    judged = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("cos", cosine("v_a", "v_b")).withColumn("between", F.acos(F.greatest(F.least("cos", F.lit(1.0)), F.lit(-1.0))))
    width = F.col("w_a") + F.col("w_b")
    alone = (F.col("m_a") == 1) & (F.col("m_b") == 1)
    state = F.when(alone, F.when(F.col("cos") >= reach, "all").otherwise("none")).when(F.col("between") + width <= limit - 1e-9, "all").when(F.col("between") - width > limit + 1e-9, "none").otherwise("some")
    judged = kept.write(judged.select("a", "b", "n_a", "n_b", state.alias("state")).where("state <> 'none'"))
    member = lambda x, y: classed.select(F.col("cls").alias(x), F.col("id").alias(y), F.col("v").alias(f"v_{y}"), F.col("mult").alias(f"k_{y}"))
    open_pairs = judged.where("state = 'some'").select("a", "b").join(member("a", "x"), "a").join(member("b", "y"), "b")
    linked = kept.write(open_pairs.where(cosine("v_x", "v_y") >= reach).select("a", "b", "x", "y", "k_x", "k_y"))

    whole = judged.where("state = 'all'")
    by_class = whole.select(F.col("a").alias("cls"), F.col("n_b").alias("n")).unionAll(whole.select("b", "n_a")).groupBy("cls").agg(F.sum("n").alias("far"))
    by_node = linked.select(F.col("x").alias("id"), F.col("k_y").alias("n")).unionAll(linked.select("y", "k_x")).groupBy("id").agg(F.sum("n").alias("more"))
    groups = components(kept, whole.select("a", "b").unionAll(linked.select("a", "b")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    answers = (
        classed.select("id", "cls").join(sizes.select("cls", "weight"), "cls").join(by_class, "cls", "left").join(by_node, "id", "left")
        .join(groups.toDF("cls", "component"), "cls", "left")
        .select(F.col("id").alias("node"), "cls", (F.col("weight") - 1 + zero(F.col("far")) + zero(F.col("more"))).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    )
    named = copies.select("id", "node").join(answers, "node").select("id", "n_links", "component", "cls")
    out = vectors.select(F.col(id_col).alias("vec_id")).join(named.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.when(F.col("vec_id").isNotNull(), zero(F.col("n_links"))).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.coalesce("cls", "vec_id").alias("class_id"),
    )
