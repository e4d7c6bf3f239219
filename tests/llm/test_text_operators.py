"""Operators on texts against brute force and on odd inputs."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm import common, jaccard, licenses, mixing, packing, pii, quality, toxicity, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD = [
    (1, None, "en", "src1", 0), (2, "", "en", "src1", 0), (3, " \n\t ", None, "src1", 4), (None, "no id at all", "en", "src1", 12),
    (5, "same text here for two rows now", "en", None, 31), (5, "same text here for two rows now", "en", None, 31),
    (6, "x" * 300_000, "de", "src2", 300_000), (7, "word " * 60_000, "fr", "src0", 300_000), (8, "one", "en", "src1", 3),
    (9, "tail éß 中文 \U0001f600 mail a.b@c.de", "es", "src3", 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("mine")).withColumn("label", F.lit(1)).withColumn("key", F.lit(2))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# Words and shingles ------------------------------------------------------------------------------------------------

def test_hashed_words_are_the_words():
    texts = [None, "", "A b\tC", "café a,b;A", " x", "y", "z" * 5000]
    hashes = {}
    for maker, split in ((common.printed, lambda t: t.encode().translate(common.LOWER).split()), (common.alphanumeric, lambda t: common.words(t.encode()))):
        got = [h[a:b].tolist() for h, o in maker()(pa.array(texts)) for a, b in zip(o, o[1:])]
        want = [split(t or "") for t in texts]
        assert list(map(len, got)) == list(map(len, want))
        for g, w in zip(itertools.chain(*got), itertools.chain(*want)):
            assert hashes.setdefault(w, g) == g
        assert len(set(hashes.values())) == len(set(hashes))


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 0.8 <= len(x) / len(y) <= 1.25 and 100 * len(x & y) >= 80 * len(x | y):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard_on_the_table(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs)[0].collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("options", [{}, {"seldom": 2}, {"seldom": 2, "frequent_most": 40}, {"seldom": 2, "shared_from": 1}])
def test_jaccard_near_the_threshold_and_with_hot_keys(spark, options):
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(40):  # chains of edits, so that links and missing links lie close to the threshold
        words = list(base)
        for k in rng.choice(60, i % 9, replace=False):
            words[k] = f"e{i}x{k}"
        rows.append((i, " ".join(words)))
    passage = " ".join(f"p{k}" for k in range(30))
    rows += [(100 + i, passage + " " + " ".join(f"q{i}y{k}" for k in range(i + 1))) for i in range(30)]
    rows += [(200, "a b c"), (201, "A  b\nC"), (202, "a b d"), (203, "one"), (204, "one"), (205, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members, links = jaccard.jaccard_join(df, **options)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()} == brute_components(rows)
    sets = brute_components(rows)
    assert all(sets[r.a][1] == sets[r.b][1] for r in links.collect())


def test_frequent_shingles_are_counted(spark):
    texts = [" ".join(f"p{k}" for k in range(12)) + f" only{i}" for i in range(20)] + ["one two three four five six"] * 5 + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    order = jaccard.frequent(common.Kept(spark), docs, 5, "text", least=2)
    shingle = jaccard.Shingler(5)
    import pyarrow as pa

    powers = [sorted(order(s).tolist()) for s in shingle(pa.array([texts[0], texts[20], "new words that no text has"]))]
    assert powers == [[0] + [4] * 8, [2, 2], [0, 0]]


def test_bitmaps_never_lose_a_link():
    rng = np.random.default_rng(2)
    for n in (1, 5, 80, 900, 5000):
        a = np.unique(rng.integers(1 << 62, size=n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: max(1, int(n * 0.9))], rng.integers(1 << 62, size=max(1, n // 12), dtype=np.uint64)]))
        maps = [np.frombuffer(jaccard.bitmap(x), np.uint8)[None, :] for x in (a, b)]
        width = min(m.shape[1] for m in maps)
        bits = int(np.bitwise_count(jaccard.fold(maps[0], width) ^ jaccard.fold(maps[1], width)).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_jaccard_odd_rows(odd, none):
    got = jaccard.jaccard_join(odd)[0].collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_shingles, by[1].component_id) == (0, 1) and by[2].component_id == 2 and by[3].n_shingles == 0
    assert by[None].component_id is None and by[6].n_shingles == 1 and by[7].n_shingles == 1
    assert jaccard.jaccard_join(none)[0].count() == 0
    kept = jaccard.one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7, 8, 9]


# Toxicity and quality ----------------------------------------------------------------------------------------------

def test_segments_are_all_maximal():
    rng = np.random.default_rng(3)

    def brute(x):
        """Ruzzo and Tompa's recursive definition: the best segment, then the same on either side."""
        if not len(x) or x.max() <= 0:
            return []
        s = np.concatenate([[0], np.cumsum(x)])
        best, a, b = max(((s[b] - s[a]), -a, -b) for a in range(len(x)) for b in range(a + 1, len(x) + 1))
        a, b = -a, -b
        return brute(x[:a]) + [(a, b, best)] + [(p + b, q + b, v) for p, q, v in brute(x[b:])]

    for _ in range(60):
        x = np.round(rng.normal(-0.3, 1, rng.integers(1, 25)), 3)
        got, want = toxicity.segments(x), brute(x)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def auc(y, s):
    y, s = np.array(y), np.array(s)
    p, n = s[y == 1], s[y == 0]
    return (p[:, None] > n).mean() + 0.5 * (p[:, None] == n).mean()


@pytest.mark.parametrize("module,label,bar", [(toxicity, "toxic", 0.7), (quality, "quality", 0.95)])
def test_held_out_accuracy(spark, module, label, bar):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = module.score_documents(docs, module.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert auc([r[label] for r in rows], [r["score"] for r in rows]) > bar
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_held_out_fold_is_never_learned_from(docs, labels):
    flipped = labels.withColumn("toxic", F.when(common.remainder("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert np.array_equal(a.scores, b.scores) and np.array_equal(a.curve, b.curve)
    assert [r.held_out for r in toxicity.score_documents(docs, a).orderBy("doc_id").collect()] == [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs.orderBy("doc_id").collect()]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_odd_rows(module, docs, labels, odd, none):
    model = module.fit(docs, labels)
    got = module.score_documents(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert module.score_documents(none, model).count() == 0
    blind = module.fit(docs, labels.limit(0))
    assert {r.score for r in module.score_documents(docs, blind).collect()} == {0.5}


def test_toxic_stage_drops_what_it_rejects(docs, labels):
    model = toxicity.fit(docs, labels)
    high = {r.doc_id for r in toxicity.score_documents(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()} == high


# Mixing ------------------------------------------------------------------------------------------------------------

def water_fill(budget, nodes):
    """Shares by rounds: what a full child leaves goes to its siblings."""
    share, open_nodes = {k: 0 for k, _, _ in nodes}, [n for n in nodes if n[1] > 0]
    while open_nodes:
        total = sum(w for _, w, _ in open_nodes)
        full = [n for n in open_nodes if n[2] * total <= budget * n[1]]
        if not full:
            share.update({k: budget * w // total for k, w, _ in open_nodes})
            break
        for k, _, cap in full:
            share[k] = cap
            budget -= cap
        open_nodes = [n for n in open_nodes if n not in full]
    return share


def test_budgets_against_rounds(spark):
    rng = np.random.default_rng(4)
    leaves = [(f"d{d}", f"l{l}", f"s{s}", int(rng.integers(0, 500))) for d in range(3) for l in range(3) for s in range(4)]
    weights = [(d, l, s, int(rng.integers(0, 5))) for d, l, s, _ in leaves]
    got = mixing.budgets(
        spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"),
        spark.createDataFrame(weights, "domain string, lang string, source string, weight long"), 5000, 0.0, 2,
    ).collect()
    w = {x[:3]: x[3] for x in weights}
    cap = {x[:3]: 2 * x[3] if w[x[:3]] else 0 for x in leaves}
    part = lambda m, k: sum(v for x, v in m.items() if x[:len(k)] == k)
    top = water_fill(5000, [((d,), part(w, (d,)), part(cap, (d,))) for d in ("d0", "d1", "d2")])
    want = {}
    for d, b in top.items():
        for dl, c in water_fill(b, [((*d, l), part(w, (*d, l)), part(cap, (*d, l))) for l in ("l0", "l1", "l2")]).items():
            want.update(water_fill(c, [((*dl, s), w[(*dl, s)], cap[(*dl, s)]) for s in ("s0", "s1", "s2", "s3")]))
    assert {(r.domain, r.lang, r.source): r.budget for r in got} == want


def test_leaves_without_weight_hold_no_budget(spark):
    leaves = [("d0", "l0", "s", 100), ("d0", "l1", "s", 1000), ("d1", "l0", "s", 10000)]
    weights = [("d0", "l0", "s", 5), ("d0", "l1", "s", 0), ("d1", "l0", "s", 5)]
    got = mixing.budgets(
        spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"),
        spark.createDataFrame(weights, "domain string, lang string, source string, weight long"), 2000, 0.0, 1,
    ).orderBy("domain", "lang").collect()
    assert [r.budget for r in got] == [100, 0, 1900]


def test_mixture_takes_prefixes_of_epochs(docs):
    domain = F.lit("all")
    leaves = docs.select(domain.alias("domain"), "lang", "source")
    got = mixing.mixture(docs, domain, mixing.weights_by_rule(leaves, {}, {"es": 9}), share=0.9, epochs=2).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.lang, r.source].append(r)
    for rows in by.values():
        taken, longest = sum(r.tokens for r in rows), max(r.tokens for r in rows)
        assert rows[0].budget <= taken < rows[0].budget + longest
        ids = collections.Counter((r.doc_id, r.epoch) for r in rows)
        assert max(ids.values()) == 1
        if max(r.epoch for r in rows):  # a second epoch starts when the first gave all
            assert {r.doc_id for r in rows if r.epoch} <= {r.doc_id for r in rows if not r.epoch}


def test_mix_odd_rows(odd, none):
    leaves = odd.select(F.lit("d").alias("domain"), "lang", "source")
    weights = mixing.weights_by_rule(leaves, {}, {})
    got = mixing.mix(odd.withColumn("domain", F.lit("theirs")), F.lit("d"), weights, share=1.0)
    assert got.columns == [*odd.columns, "domain"]
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 6, 7, 8, 9]  # rows without words or without a leaf go
    assert mixing.mix(none, F.lit("d"), weights).count() == 0


# Licenses, URLs and personal data ----------------------------------------------------------------------------------

def test_licenses_against_brute_force(docs):
    for r, t in zip(licenses.scan_documents(docs).orderBy("doc_id").collect(), [x.text for x in docs.orderBy("doc_id").collect()]):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
        places = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


@pytest.mark.parametrize("text,label", [
    ("Licensed under the Apache License, Version 2.0 (the License)", "apache-2.0"), ("licensed UNDER the apache license version 2.0", "apache-2.0"),
    ("Licensed under the old Apache License, Version 2.0", None), ("Copyright (c) 2020 Jane Doe. All rights reserved.", "copyright"),
    ("copyright a b c d e f g h all rights reserved", None), ("Released under the MIT License.", "mit"), ("GNU General Public License, version 3", "gpl-3.0"),
])
def test_template_matches(text, label):
    got = {m[0] for m in licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)(text.encode())["matches"]}
    assert (got == {label}) if label else not got


def test_url_rules_and_words(spark):
    rows = [
        (1, "http://a.net/x", "a.net", "/x", "net/", "block"), (2, "https://WWW.example.net/en/1?q", "www.example.net", "/en/1", "example.net/en/", "allow"),
        (3, "http://example.com/de/2#top", "example.com", "/de/2", "example.com/de/", "block"), (4, "http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        (5, "http://notnet/x", "notnet", "/x", None, "allow"), (6, None, "", "", None, "allow"), (7, "example.com/de/", "", "", None, "allow"),
        (8, "http://freebets.example.com/en/1", "freebets.example.com", "/en/1", None, "block"), (9, "http://h.net?x", "h.net", "", None, "allow"),
        (10, "ftp://line\nbreak.net/y", "line\nbreak.net", "/y", "net/", "block"), (11, "http://free-bets.example.com/", "free-bets.example.com", "/", None, "block"),
        (12, "http://free.example.com/", "free.example.com", "/", None, None),
    ] + [(100 + k, f"http://blog.tion{k % 3}.example.com/en/{k}", f"blog.tion{k % 3}.example.com", f"/en/{k}", None, "allow") for k in range(30)]
    rows += [(200 + k, f"http://free-bets.example.com/en/{k}", "free-bets.example.com", f"/en/{k}", None, "block") for k in range(10)]
    pages = spark.createDataFrame([(i, u, "html", "x") for i, u, *_ in rows], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in urls.judge_pages(pages, urls.fit(pages)).collect()}
    for i, _, host, path, rule, verdict in rows:
        assert (got[i].host, got[i].path, got[i]["rule"]) == (host, path, rule)
        assert verdict in (None, got[i].verdict), got[i]
    assert urls.judge_pages(pages.limit(0), urls.fit(pages.limit(0))).count() == 0


def test_registered_names_are_segmented(spark):
    assert urls.names("freebets.com", "/x") == (["freebets"], ["x"]) and urls.names("www.freebets.co.uk.", "") == (["www", "freebets", "co"], [])
    rows = [(1, "http://freebets.com"), (2, "http://cheapcasinoslots.com/"), (3, "http://www.freebets.org/a")]
    rows += [(100 + k, f"http://blog{k % 3}.site.com/en/{k}") for k in range(30)] + [(200 + k, f"http://free.bets.com/en/{k}") for k in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in urls.judge_pages(pages, urls.fit(pages)).collect()}
    assert all(got[i].verdict == "block" and got[i].score > 0 for i in (1, 2, 3)) and all(got[100 + k].verdict == "allow" for k in range(30))


def test_segmenter_finds_words():
    logs = {w: math.log(n / 100) for w, n in {"free": 20, "bets": 10, "cheap": 10, "pills": 10, "f": 1}.items()}
    segment = urls.Segmenter(logs, 100)
    assert segment("freebets") == ["free", "bets"] and segment("cheappills") == ["cheap", "pills"] and segment("unknown") == ["unknown"]


def test_personal_data_against_brute_force(docs, odd, none):
    model = pii.fit(docs)
    more = ["x a.b@c.de,d@e.f.g@h.ij +a@b.c 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 4111111111111112 +49 (30) 123-456-789 +1 2"]
    texts = [r.text for r in docs.collect()] + [r[1] for r in ODD] + more
    for t in texts:
        t = t or ""
        want = []
        for k, p in pii.STRICT.items():
            for m in re.finditer(p.pattern, t):
                digits = re.sub("[^0-9]", "", m.group())
                fine = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "phone": 9 <= len(digits) <= 15}.get(k)
                if k == "card":
                    double = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
                    fine = 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in double) % 10 == 0
                if fine:
                    want.append((k, m.start(), m.end()))
        good, added = pii.all_spans(t, model)
        assert sorted(good) == sorted(want)
        assert not any(a[1] < b[2] and b[1] < a[2] for a in added for b in good)
    assert pii.find_documents(odd, model).count() == len(ODD) and pii.find_documents(none, pii.fit(none)).count() == 0
    rows = pii.find_documents(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r.base_sha256 == pii.digest(pii.strict_spans(r.text)[0]) for r in rows)
    masked = odd.select("doc_id", pii.redacted("text", model).alias("t")).collect()
    assert {r.doc_id: r.t for r in masked}[9].endswith("mail <email>") and {r.doc_id: r.t for r in masked}[1] is None


def test_loose_writings_reach_the_trees(docs):
    model = pii.fit(docs)
    for text, want in [
        ("call (555) 123-4567 now", ("phone", "(555) 123-4567")), ("ring 030 1234567 today", ("phone", "030 1234567")),
        ("host 192,168,10,1 is up", ("ip", "192,168,10,1")), ("write john12 (at) x (dot) org soon", ("email", "john12 (at) x (dot) org")),
        ("pay 4111.1111.1111.1111 now", ("card", "4111.1111.1111.1111")), ("addr 999,1,1,1 no", None), ("card 4111 1111 1111 1112 x", None), ("v 1,234,567,890", None),
    ]:
        good, added = pii.all_spans(text, model)
        assert not good and [(k, text[a:b]) for k, a, b in added] == ([want] if want else []), text


def test_trees_learn_from_all_candidates(spark):
    text = "case when id < 24000 then concat('mail u', id, '@x.org now') when id < 25000 then concat('host 10.1.', id % 200, '.', id % 250, ' is up') else concat('addr 999.1.1.', id, ' no') end"
    made = spark.range(25300).selectExpr("id", f"{text} as text")
    # Right addresses come after more than 20,000 other right candidates in the order of their texts' hashes.
    docs = made.where("id >= 25000 or (id < 24000) = (xxhash64(text) < 0)").select("text")
    assert docs.where("text like 'mail%'").count() > 10_000
    model = pii.fit(docs)
    assert pii.all_spans("host 192,168,10,1 is up", model)[1] == [("ip", 5, 17)]
    assert pii.fit(docs.repartition(7)) == model


def test_boosted_trees_learn():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, pii.FEATURES))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = pii.boost(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


# Packing -----------------------------------------------------------------------------------------------------------

def best_packing(lengths, capacity):
    """Fewest bins by exhaustive search over small instances."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] >= lengths[k]:
                bins[i] -= lengths[k]
                go(k + 1, bins)
                bins[i] += lengths[k]
        go(k + 1, [*bins, capacity - lengths[k]])

    go(0, [])
    return best


def test_reduction_never_costs_a_bin():
    rng = np.random.default_rng(6)
    for _ in range(150):
        capacity = int(rng.integers(10, 40))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 10)).tolist()
        counts = collections.Counter(x for x in lengths if x < capacity)
        rest = dict(counts)
        fixed = packing.reduce_by_dominance(rest, capacity)
        left = [w for w, n in rest.items() for _ in range(n)]
        assert collections.Counter({w: n for w, n in rest.items()}) + collections.Counter(w for t, items in fixed for w in items * t) == counts
        assert all(sum(items) <= capacity for _, items in fixed)
        full = [w for w, n in counts.items() for _ in range(n)]
        assert sum(t for t, _ in fixed) + (best_packing(left, capacity) if left else 0) == (best_packing(full, capacity) if full else 0)


def test_plan_holds_every_piece_once():
    rng = np.random.default_rng(7)
    for _ in range(50):
        capacity = int(rng.integers(5, 200))
        histogram = {int(w): int(rng.integers(1, 2000)) for w in rng.integers(1, capacity + 1, 30)}
        plan = packing.plan_bins(dict(histogram), capacity)
        held = collections.Counter()
        for times, items in plan:
            assert times > 0 and sum(items) <= capacity
            for w in items:
                held[w] += times
        assert held == histogram


def test_pieces_are_the_tokenizers(spark, docs, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    extra = spark.createDataFrame([(900, "It's <|endoftext|> A<|b İ ΣAΣ é …!? don't,\x0bx\r\ny"), (901, "<|ENDOFTEXT|>")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(extra)
    got = packing.best_fit_packing(rows, with_ids=True)
    want = collections.Counter()
    for r in rows.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want[r.doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    found = got.collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    by = collections.defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length, r.ids))
    for parts in by.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    whole = {r.sequence_id: r.ids for r in packing.sequences(got).collect()}
    assert whole == {k: [x for p in sorted(v) for x in p[2]] for k, v in by.items()}
    assert packing.best_fit_packing(rows.limit(0)).count() == 0


# Pipeline ----------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, docs):
    import corpus_pipeline as cp

    at = docs.withColumn("extra", F.lit(1)).withColumn("score", F.lit(0.0))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.columns == at.columns, name
        at = out
    final = cp.STAGES[-1][1](spark, at, SF)
    assert {r.doc_id for r in final.select("doc_id").collect()} == {r.doc_id for r in at.collect()}
    empty = docs.limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_pipeline_keeps_clean_documents(spark, docs):
    import corpus_pipeline as cp

    kept = {r.doc_id for r in cp.toxic_documents(spark, docs, SF).collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert len(clean - kept) <= 0.02 * len(clean)
    assert isinstance(docs.schema["doc_id"].dataType, T.LongType)


def test_encoder_forgets_and_meets_odd_space(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "CACHE", 5)
    monkeypatch.setattr(packing, "AT_ONCE", 40)
    encode = packing.Encoder(packing.default_vocabulary())
    odd = ["", None, "  a  b ", "a\x0bb\x0cc\x1cd\x1de\x85f　g", "<|endoftext|> hi", "Été ÀB naïve! don't x... ßİ", "wow!!! (a) a.b,c 中文。 ok", "x" * 5000, "\n", "ﬁ ß."]
    texts = pa.array(odd * 3 + [f"word{k} same, same." for k in range(50)], pa.string())
    got = list(packing.encoded(encode, texts))
    assert got == [encode.whole(t or "") for t in texts.to_pylist()]
    assert list(packing.encoded(encode, texts[7:])) == got[7:] and list(packing.encoded(encode, texts[:0])) == []
    assert len(encode.known) < 30


def test_plain_words_pass_no_patterns():
    encode = packing.Encoder(packing.default_vocabulary())
    plain = ["naïve wörds, in-between? no: here; größer... the end!?", "THE End\t(of) straße \"so\" ÿ."]
    odd = ["it's", "x² 12 ab12, 中文, 🙂 ab'", "e\u0301 É İx ab\u0301.", "<|endoftext|> a", "", "...", "a" * 300 + "!" * 300]
    texts = [*plain, *odd, " ".join([*plain, *odd])]
    want = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(pa.array(texts))] == want
    # Words of plain letters and closing marks need neither normalizing nor places in the text.
    fresh = packing.Encoder(packing.default_vocabulary())
    fresh.tokenizer = None
    some = ["naïve wörds, größer... the end!?", "THE End\tstraße ÿ."]
    assert [np.frombuffer(b, "<u4").tolist() for b in fresh(pa.array(some))] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_workers_hand_freed_memory_back():
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024

    def work(parts):
        some = [bytes(2000) for _ in range(100_000)]
        for k in parts:
            yield k, held()
        # A few of them stay and keep the heap from shrinking by itself.
        kept.extend(some[::1000])

    kept = []
    before = held()
    rows = list(common.tidy(work)(iter(range(3))))
    assert [k for k, _ in rows] == [0, 1, 2] and rows[-1][1] > before + 150
    assert held() < before + 80


def test_texts_pass_one_worker_of_a_task(docs, monkeypatch):
    """No write plans two Python evaluations in one task: each would be a worker of its own that outlives it."""
    plans, write = [], common.Kept.write

    def seen(kept, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(kept, df)

    monkeypatch.setattr(common.Kept, "write", seen)
    jaccard.one_per_group(docs)
    tasks = [part for p in plans for part in re.split(r"Exchange", p)]
    assert max(t.count("ArrowEvalPython") for t in tasks) == 1


def test_texts_are_read_in_small_batches(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(key, 4096)
    common.table(spark, SF, "documents")
    assert int(spark.conf.get(key)) == common.BATCH
    spark.conf.set(key, 8)
    common.table(spark, SF, "documents")
    assert int(spark.conf.get(key)) == 8
    spark.conf.unset(key)
