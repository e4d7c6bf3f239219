"""Operators on vectors against brute force and on odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import common, hamming, tree_search

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """(number of links, component) of each id, by all cosines in double precision."""
    good = {i: np.array(v, float) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    u = np.array([good[i] / np.sqrt((good[i] ** 2).sum()) for i in ids])
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    out = {i: (0, i) for i, *_ in rows if i is not None}
    comp = np.arange(len(ids))
    while True:
        new = np.array([min([comp[k], *comp[link[k]]]) for k in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    out.update({i: (int(link[k].sum()), ids[comp[k]]) for k, i in enumerate(ids)})
    return out


def planted(seed, d=64):
    """Random vectors, groups of near copies, chains of neighbours close to the threshold, and exact copies."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=d) for _ in range(300)]
    for _ in range(4):
        centre = rng.normal(size=d)
        out += [centre + 0.12 * rng.normal(size=d) for _ in range(25)]
    for angle in (0.3, 0.40, 0.44, 0.452, 0.46):
        for _ in range(25):
            a = rng.normal(size=d)
            a /= np.linalg.norm(a)
            b = rng.normal(size=d)
            b -= (b @ a) * a
            b /= np.linalg.norm(b)
            out += [a, np.cos(angle) * a + np.sin(angle) * b]
    out += [out[3]] * 5 + [2 * out[310]]
    return [(i, np.float32(v).tolist(), 0) for i, v in enumerate(out)]


def test_near_duplicates_against_brute_force(spark):
    rows = planted(1)
    got = {r.vec_id: r for r in hamming.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


@pytest.mark.parametrize("tables", [2, 3])
def test_other_tables(spark, tables):
    rows = planted(2)
    got = {r.vec_id: (r.n_links, r.component_id) for r in hamming.near_duplicates(spark.createDataFrame(rows, SCHEMA), tables=tables).collect()}
    assert got == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0] * 4, 0), (4, [1.0, None, 0.0, 0.0], 0), (5, [nan, 1.0, 0.0, 0.0], 0), (6, [inf, 1.0, 0.0, 0.0], 0),
        (7, [1.0, 0.0, 0.0, 0.0], 0), (8, [2.0, 0.0, 0.0, 0.0], 0), (9, [1.0, 0.2, 0.0, 0.0], 0), (10, [1.0, 0.0, 0.0, 0.0], 0), (50, [0.0, 1.0, 0.0, 0.0], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("theirs")).withColumn("v", F.lit(0)).withColumn("leaf", F.lit(0))
    got = {r.vec_id: (r.n_links, r.component_id) for r in hamming.near_duplicates(df).collect()}
    assert got == brute(rows)
    again = df.union(df.where("vec_id in (7, 3)")).union(df.where("vec_id = 9").withColumn("vec_id", F.lit(None).cast("long")))
    rows2 = hamming.near_duplicates(again).collect()
    assert len(rows2) == len(rows) + 3 and {r.vec_id: (r.n_links, r.component_id) for r in rows2 if r.vec_id is not None} == got
    assert [(r.n_links, r.kept) for r in rows2 if r.vec_id is None] == [(None, False)]
    assert hamming.near_duplicates(df.limit(0)).count() == 0
    found = tree_search.nearest(df, F.col("id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(found, key=lambda r: r.rank)] == [(50, 1, 9), (50, 2, 7), (50, 3, 8), (50, 4, 10)]
    assert tree_search.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_search_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], float)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    found = tree_search.nearest(df, F.col("id") % 50 == 0).collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    asked = np.flatnonzero(ids % 50 == 0)
    assert set(by) == set(ids[asked].tolist())
    for k in asked:
        s = u @ u[k]
        s[k] = -2
        best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        mine = sorted(by[ids[k]])
        hit += len(best & {v for _, v, _ in mine})
        assert [r for r, *_ in mine] == [1, 2, 3, 4, 5]
        assert [(-c, v) for _, v, c in mine] == sorted((-c, v) for _, v, c in mine)
        assert np.allclose([c for *_, c in mine], [s[np.flatnonzero(ids == v)[0]] for _, v, _ in mine], atol=1e-12)
    assert hit >= 0.9 * 5 * len(asked)


def test_equal_vectors_tie_to_smaller_ids(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 32)).astype(np.float32)
    rows = [(i, base[i % 40].tolist(), 0) for i in range(1, 401)]
    for r in tree_search.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 50 == 0, recall=1.0).collect():
        copies = [i for i in range(1, 401) if i % 40 == r.query_id % 40 and i != r.query_id]
        assert r.vec_id == copies[r["rank"] - 1]


def test_components_of_long_chains_and_hubs(spark):
    kept = common.Kept(spark)
    links = [(i, i + 1) for i in range(200, 260)] + [(5, k) for k in range(300, 380)] + [(379, 380), (7, 7), (None, 4), (11, 9)]
    got = {r.id: r.component for r in common.components(kept, spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 200 for i in range(200, 261)} | {k: 5 for k in [5, *range(300, 381)]} | {9: 9, 11: 9}
    assert got == want
    assert common.components(kept, spark.createDataFrame([], "a long, b long")).count() == 0


def test_outliers_beside_dense_groups_get_all_their_rows(spark, monkeypatch):
    rng = np.random.default_rng(7)
    dense = [c + 1e-3 * rng.normal(size=16) for c in 3 * rng.normal(size=(10, 16)) for _ in range(60)]
    rows = [(i, np.float32(v).tolist(), 0) for i, v in enumerate([*dense, *(3 * rng.normal(size=(12, 16)))])]
    monkeypatch.setattr(tree_search, "visits_needed", lambda *a: 1)  # what probes from dense groups alone need
    found = tree_search.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") >= 590).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in found} == {i: 5 for i in range(590, 612)}
