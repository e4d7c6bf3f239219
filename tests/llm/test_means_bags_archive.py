"""Drift-bounded k-means, bag search and the content archive against brute force, on odd inputs and at their limits."""

import collections
import hashlib
import math
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import archive, bag_search, common, drift_means

VECTORS = "vec_id long, embedding array<float>, cluster int, label string"
DOCS = "doc_id long, text string, terms int, score string"
ITEMS = "item_id long, text string, rank string"
PAGES = "page_id long, url string, html string, digest string, head int"


# k-means ------------------------------------------------------------------------------------------------------------

def plain_rounds(rows, k=16, rounds=3, seed=1):
    """{id: (cluster, distance)} and centroids by plain rounds in Python integers."""
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in good if r[0] is not None), key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for n in range(rounds + 1):
        at = [min(range(len(cents)), key=lambda c: (far(v, cents[c]), c)) for _, v in good]
        if n < rounds:
            for c in range(len(cents)):
                mine = [v for (_, v), a in zip(good, at) if a == c]
                if mine:
                    cents[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted((-1 if i is None else i, a, far(v, cents[a])) for (i, v), a in zip(good, at)), cents


def groups(seed, n=400, spread=0.05, centres=20):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 64))
    return [(i, np.float32(middle[i % centres] + spread * rng.normal(size=64)).tolist(), 0, "x") for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.3, 2.0])
def test_k_means_against_plain_rounds(spark, spread):
    rows = groups(int(spread * 100), spread=spread)
    got = drift_means.k_means(spark.createDataFrame(rows, VECTORS)).collect()
    want, cents = plain_rounds(rows)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == want
    total = collections.Counter()
    for _, c, d in want:
        total[c] += d
    for r in got:
        assert r.cluster_inertia == total[r.cluster] and r.inertia == sum(total.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()
    if spread == 0.02:
        assert sum(r.scans for r in got) < 3 * len(got)  # bounds settle rows


def test_k_means_ties_and_copies(spark):
    """Vectors half way between two centroids and hundreds of copies."""
    unit = lambda x: [float(x)] + [0.0] * 63
    rows = [(i, unit(i % 5), 0, "x") for i in range(60)] + [(100 + i, unit(2), 0, "x") for i in range(300)]
    for k in (2, 3, 16):
        got = drift_means.k_means(spark.createDataFrame(rows, VECTORS), k=k).collect()
        assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == plain_rounds(rows, k)[0]


def test_k_means_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    whole = [0.5] * 64
    rows = [
        (1, None, 0, "x"), (2, [], 0, "x"), (3, [1.0] * 63, 0, "x"), (4, [1.0] * 63 + [None], 0, "x"), (5, [nan] + whole[1:], 0, "x"), (6, [inf] + whole[1:], 0, "x"),
        (7, [0.0] * 64, 0, "x"), (7, [0.0] * 64, 0, "x"), (7, whole, 0, "x"), (None, [3.0] * 64, 0, "x"), (8, [-0.01] * 64, 0, None), (9, [2_000_000.0] * 64, 0, "x"),
        (10, [3e38] * 64, 0, "x"),
    ]
    got = drift_means.k_means(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.vec_id for r in got} == {7, None, 8, 9} and sum(r.vec_id == 7 for r in got) == 3
    one = {(r.vec_id, r.cluster, r.distance) for r in got if r.vec_id in (8, 9)}
    assert {d for *_, d in one} == {0}
    assert drift_means.k_means(spark.createDataFrame([], VECTORS)).collect() == []
    assert len(drift_means.k_means(spark.createDataFrame(rows[:6], VECTORS)).collect()) == 0


def test_bound_of_moves():
    """No point of a sphere gets nearer to the moved centroid than the bound says, and the bound is often below the move."""
    rng = np.random.default_rng(4)
    tighter = 0
    for _ in range(400):
        d = int(rng.integers(2, 6))
        centre, old, new = rng.normal(size=(3, d)) * rng.choice([0.2, 1, 5])
        radius = float(rng.exponential(0.6))
        x = rng.normal(size=(500, d))
        x = centre + radius * x / np.linalg.norm(x, axis=1, keepdims=True) * np.where(rng.random((500, 1)) < 0.7, 1, rng.random((500, 1)))
        bound = drift_means.nearer_at_most(centre, radius, old, new)
        gain = (np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)).max()
        move = np.linalg.norm(new - old)
        assert gain <= bound + 1e-9 and bound <= move + 1e-12
        tighter += bound < 0.9 * move
    assert tighter > 150


# Bag search ---------------------------------------------------------------------------------------------------------

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranked(docs, items, k=10):
    bags = [(i, collections.Counter(terms(t))) for i, t, *_ in docs]
    some = [(i, b) for i, b in bags if b]
    total, length = len(some), sum(sum(b.values()) for _, b in some)
    df = collections.Counter(w for _, b in some for w in b)
    out = []
    for item, text in items:
        found = []
        for i, b in some:
            m = 25 + (75 * sum(b.values()) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 8 * m)) for w in terms(text) if w in b)
            if s > 0 and i is not None:
                found.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return out


def corpus(seed, n=300):
    """Texts with copies, texts that only differ in other words, and texts of one bag in another order."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{int(x)}" for x in range(60)] + ["Über", "É1", "ÉCOLE"]
    texts = [" ".join(rng.choice(vocab, int(rng.integers(1, 40)))) for _ in range(n)]
    texts += [texts[5]] * 40 + [" ".join(reversed(t.split())) for t in texts[:20]] + [texts[7] + " other", texts[7] + " words"]
    return [(int(i), t, 0, "x") for i, t in zip(rng.permutation(len(texts)), texts)]


@pytest.mark.parametrize("at_once", [1024, 2])
def test_bag_search_against_all_scores(spark, at_once):
    docs = corpus(1)
    items = [(1, "w1 w2 w2 W3"), (2, "über, école! w9-w9"), (3, "nothing"), (4, "w5 " * 50), (5, docs[5][1]), (9, None), (11, "")]
    got = bag_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS), items_at_once=at_once)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(ranked(docs, items))


def test_bag_search_equal_hashes_stay_apart(spark, monkeypatch):
    docs = corpus(2, 60)
    items = [(1, "w1 w2 w3 w4"), (2, "w9 w8")]
    monkeypatch.setattr(bag_search.F, "xxhash64", lambda *c: F.lit(0).cast("bigint"))
    got = bag_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS))
    assert sorted(map(tuple, got.collect())) == sorted(ranked(docs, items))


def test_bag_search_beyond_exact_doubles(spark, monkeypatch):
    docs, items = corpus(3, 60), [(1, "w1 w2 w3 w4"), (2, "w9 w8")]
    monkeypatch.setattr(bag_search, "EXACT", 1)
    got = bag_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS))
    assert sorted(map(tuple, got.collect())) == sorted(ranked(docs, items))


def test_bag_search_odd_rows(spark):
    docs = [
        (1, None, 0, "x"), (2, "", 0, "x"), (3, " \n.", 0, "x"), (None, "alpha beta", 0, "x"), (5, "alpha", 0, "x"), (5, "alpha", 0, "x"),
        (6, "alpha " * 50_000, 0, "x"), (7, "b" * 300_000, 0, None), (8, "gamma", 0, "x"),
    ]
    items = [(1, "alpha beta"), (None, "alpha"), (2, "alpha"), (2, "beta"), (3, "b" * 300_000)]
    got = bag_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*i, None) for i in items], ITEMS))
    want = ranked(docs, [(1, "alpha beta"), (2, "alpha"), (3, "b" * 300_000)])
    assert sorted(map(tuple, got.collect())) == sorted(want)
    none, asked = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "alpha", "x")], ITEMS)
    assert bag_search.search(none, asked).collect() == []
    assert bag_search.search(spark.createDataFrame(docs, DOCS), asked.where("false")).collect() == []


# Archive ------------------------------------------------------------------------------------------------------------

ODD_PAGES = [
    (4, "http://a/1", "p" * 100, "d", 1), (2, "http://a/2", "p" * 100, "d", 1), (9, None, "p" * 100, "d", 1), (None, "http://n/", "p" * 100, "d", 1),
    (5, "http://a/5", "p" * 99, "d", 1), (6, "http://a/6", "p" * 99, "d", 1), (7, "http://a\r\nWARC-Type: revisit\r\n\r\n", "é" * 50, "d", 1), (8, "http://a/8", "é" * 50, "d", 1),
    (10, "u", None, None, None), (11, "u", "", "d", 1), (12, "u", "body\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\n" * 10, "d", 1), (13, "u", "q" * 400_000, "d", 1),
    (14, "u", "same row " * 20, "d", 1), (14, "u", "same row " * 20, "d", 1), (3, "u", "r" * 120, "d", 1), (3, "v", "r" * 120, "d", 1), (1, "v", "r" * 120, "d", 1),
]


def expected(rows):
    out, first = [], {}
    for i, _, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        revisit = len(body) >= 100 and body in first
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first[body] if revisit else None))
        first.setdefault(body, i)
    return out


by_text = lambda rows: sorted(map(str, map(tuple, rows)))


def test_archive_rows(spark):
    found = archive.write_archive(spark.createDataFrame(ODD_PAGES, PAGES), common.Kept(spark))
    assert by_text(archive.read_pages(found).collect()) == by_text(expected(ODD_PAGES))
    assert found.payloads.count() == len({(h or "") for _, _, h, *_ in ODD_PAGES})
    assert found.headers.count() == len(ODD_PAGES)
    empty = archive.write_archive(spark.createDataFrame([], PAGES), common.Kept(spark))
    assert archive.read_pages(empty).collect() == []


def test_archive_gives_back_every_byte(spark):
    pages = spark.createDataFrame(ODD_PAGES, PAGES)
    found = archive.write_archive(pages, common.Kept(spark))
    got = collections.Counter(bytes(r.payload) for r in archive.records(found).collect())
    assert got == collections.Counter((h or "").encode() for _, _, h, *_ in ODD_PAGES)
    for r in archive.records(found).collect():
        top, http = bytes(r.head).split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
        kept = 0 if fields["WARC-Type"] == "revisit" else len(r.payload)
        assert int(fields["Content-Length"]) == len(http) + kept
        assert fields["WARC-Payload-Digest"] == "sha256:" + r.digest and f"Content-Length: {len(r.payload)}\r\n".encode() in http


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_files_round_trip(spark, compression):
    found = archive.write_archive(spark.createDataFrame(ODD_PAGES, PAGES), common.Kept(spark))
    path = tempfile.mkdtemp(prefix="warc-") + "/out"
    archive.export_warc(found, path, compression, records_per_file=3)
    read = archive.read_warc(spark, path).collect()
    assert len(read) == len(ODD_PAGES)
    want = collections.Counter()
    for r in archive.records(found).collect():
        top, http = bytes(r.head).split(b"\r\n\r\n", 1)
        want[top + b"\r\n\r\n", http + (b"" if b"\nWARC-Type: revisit" in top else bytes(r.payload))] += 1
    assert collections.Counter((bytes(r.head), bytes(r.body)) for r in read) == want


def test_damaged_payload_stops_the_read(spark):
    found = archive.write_archive(spark.createDataFrame(ODD_PAGES, PAGES), common.Kept(spark))
    changed = archive.Archive(found.headers, found.payloads.withColumn("bytes", F.when(F.octet_length("bytes") == 120, F.lit("x").cast("binary")).otherwise(F.col("bytes"))))
    with pytest.raises(Exception, match="no sound payload"):
        archive.read_pages(changed).collect()
    with pytest.raises(Exception, match="no sound payload"):
        archive.read_pages(archive.Archive(found.headers, found.payloads.limit(1))).collect()
