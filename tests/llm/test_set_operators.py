"""Joins, components, search, mixing and the pipeline against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from chunkwright.llm import components, jaccard, mixing, topk


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


class Union:
    def __init__(self, items):
        self.above = {i: i for i in items}

    def root(self, x):
        while self.above[x] != x:
            x = self.above[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.above[max(a, b)] = min(a, b)


def brute_components(texts, n, share):
    sets = {i: shingles(t, n) for i, t in texts.items()}
    found = Union(texts)
    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                found.join(i, j)
    return {i: (len(sets[i]), found.root(i)) for i in ids}


def near_copies(seed, bases=14, copies=12):
    rng = random.Random(seed)
    out = []
    for _ in range(bases):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 4, 6, 9, 20, 60, 150, 400]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 12) + 1)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["changed"], [w[k], f"new{rng.randrange(9)}"]])
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


EDGE = [None, "", "  \n", "one", "one", "One", "one two", "a b c d", "A B C D", "x" * 100_000, "long " * 30_000, "long " * 30_000]


@pytest.mark.parametrize(("n", "share", "seed"), [(4, 85, 1), (5, 80, 2), (4, 85, 3)])
def test_jaccard_join(spark, n, share, seed):
    texts = dict(enumerate(EDGE + near_copies(seed)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("n_shingles", F.lit("mine"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_sets(docs, n=n, share=share).collect()}
    assert got == brute_components(texts, n, share)


def test_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 3)
    monkeypatch.setattr(jaccard, "NEAREST", 2)
    monkeypatch.setattr(jaccard, "CELL", 8)
    monkeypatch.setattr(jaccard, "ROW_NODES", 5)
    texts = dict(enumerate(near_copies(9, bases=2, copies=70)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_sets(docs).collect()}
    assert got == brute_components(texts, 4, 85)


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_BROADCAST_PAIRS", 0)
    texts = dict(enumerate(near_copies(5, bases=4)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_sets(docs).collect()}
    assert got == brute_components(texts, 4, 85)


def test_join_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert jaccard.join_sets(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text), (7, text), (None, text), (3, text + " more"), (None, "quite another text of words"), (9, None), (None, None)]
    got = collections.Counter(map(tuple, jaccard.join_sets(spark.createDataFrame(rows, schema)).collect()))
    assert got == collections.Counter([(7, 37, 3), (7, 37, 3), (None, 37, 3), (3, 38, 3), (None, 2, None), (9, 0, 9), (None, 0, None)])
    kept = jaccard.keep_one(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in kept if r.text) == [(False, 3, text + " more"), (True, None, "quite another text of words")]
    assert sorted((r.doc_id is None, r.doc_id) for r in kept if not r.text) == [(False, 9), (True, None)]
    more = [(1, text, "a"), (2, text, "b"), (2, "another text", "c"), (None, "no id one two", "d"), (None, "no id one two", "e"), (None, "no id one two", "f")]
    kept = jaccard.keep_one(spark.createDataFrame(more, "doc_id long, text string, node string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "no id one two"), (1, text), (2, "another text")]
    assert all(r.node in "abcdef" for r in kept)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.randoms(use_true_random=False), st.sampled_from([80, 85, 90]))
def test_signatures_lose_no_link(size, edits, rng, share):
    a = {rng.getrandbits(64) for _ in range(size)}
    b = set(a)
    for _ in range(edits):
        if rng.random() < 0.5 and len(b) > 1:
            b.remove(rng.choice(sorted(b)))
        else:
            b.add(rng.getrandbits(64))
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    similar = 100 * len(a & b) >= share * len(a | b)
    if similar:
        bands = jaccard.Bands(share)
        assert set(bands.signatures(x).tolist()) & set(jaccard.Bands(share).signatures(y).tolist())
        p, q = (np.frombuffer(jaccard.sketch_of(s), np.uint64) for s in (x, y))
        n = min(len(p), len(q))
        assert jaccard.near(int(np.bitwise_count(jaccard.folded(p, n) ^ jaccard.folded(q, n)).sum()), len(a), len(b), share)


@pytest.mark.parametrize("few", [0, 16_000])
def test_components(spark, few):
    rng = random.Random(6)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)] + [(500, k) for k in range(501, 540)] + [(5, 5)]
    found = Union({x for link in links for x in link})
    for a, b in links:
        found.join(a, b)
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "u long, v long"), few_bytes=few).collect()))
    assert got == {x: found.root(x) for a, b in links if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "u long, v long"), few_bytes=few).count() == 0


# Search


def brute_top(vectors, k):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors}
    out = set()
    for i, q in whole.items():
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in whole.items() if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    return out


@pytest.mark.parametrize(("seed", "shard"), [(1, 64), (2, 10_000)])
def test_top_k(spark, seed, shard):
    rng = np.random.default_rng(seed)
    data = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(600)]
    data += [(1000 + i, data[50][1]) for i in range(300)] + [(2000, [0.0] * 8), (2050, [1.0, 2.0]), (2051, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    odd = spark.createDataFrame([(3000, None), (3050, [1.0, None]), (None, [1.0] * 8), (3100, [float("nan")] * 8), (3150, [float("inf")])], "vec_id long, embedding array<float>")
    got = topk.top_k(topk.quantised(df.union(odd).withColumn("v", F.lit("mine"))), F.col("vec_id") % 50 == 0, k=5, shard_rows=shard)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == brute_top(data, 5)


def test_top_k_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(50, [1.0])], [(1, [1.0]), (2, [1.0])]):
        assert topk.top_k(topk.quantised(spark.createDataFrame(rows, schema)), F.col("vec_id") % 50 == 0).count() == 0
    huge = spark.createDataFrame([(50, [3e38, 1.0]), (1, [3e38, 2.0]), (2, [-3e38, 2.0])], schema)
    got = {r.vec_id: r.score for r in topk.top_k(topk.quantised(huge), F.col("vec_id") == 50).collect()}
    assert got == {1: 2**63 - 1, 2: -(2**63)}


def test_pruning():
    """On clusters most distances are ruled out by stored bounds, and the search stays exact."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 6)) * 5000
    x = np.concatenate([c + rng.normal(size=(400, 6)) * 100 for c in centres]).astype(np.int64)
    ids = np.arange(len(x))
    best = topk.Best(ids, x, 5)
    got = best.of(ids[::50], x[::50])
    scores = x[::50] @ x.T
    want = []
    for i, own in zip(ids[::50].tolist(), scores, strict=True):
        order = [j for j in np.lexsort((ids, -own)).tolist() if j != i][:5]
        want += [(i, j, int(own[j])) for j in order]
    assert got == want
    assert best.tree.computed < len(ids[::50]) * len(x) / 4
    for tree in (topk.MTree(x.astype(float)),):
        for node, kids in enumerate(tree.children):
            for kid, d in zip(kids if kids is not None else (), tree.away[node], strict=False):
                assert abs(np.linalg.norm(tree.x[tree.routing[kid]] - tree.x[tree.routing[node]]) - d) < 1e-6
            if tree.page[node]:
                a, b = tree.page[node]
                assert (np.linalg.norm(tree.x[tree.order[a:b]] - tree.x[tree.routing[node]], axis=1) <= tree.radius[node] + 1e-6).all()
        assert sorted(tree.order.tolist()) == ids.tolist()


# Mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s] + 1e-12}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        source = rng.choices(["a", "b", "é", "Z", None, "c", "empty"], [30, 1, 5, 5, 3, 3, 0])[0]
        rows.append((i, " ".join("w" * rng.randint(1, 4) for _ in range(min(2000, int(rng.paretovariate(1) * 10)))), source))
    rows += [(2000, None, "empty"), (2001, "", "empty"), (2002, "x " * 40_000, "a"), (None, "no id here", "b"), (5, "twice twice", "b"), (5, "twice twice", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"taken": F.lit("mine"), "lang": F.lit("xx")})
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = brute_targets(sizes)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for s, own in by.items():
        assert {r.source_size for r in own} == {sizes[s]}
        assert all(math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9) for r in own)
        assert all(r.taken % r.size == 0 and r.taken <= 2 * r.size if r.size else r.taken == 0 for r in own)
        smallest = min((r.size for r in own if r.size), default=0)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(smallest, 0.02 * want[s])
        assert all(r.taken >= r.size * (want[s] // sizes[s]) for r in own if sizes[s])
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_follows_keys(spark):
    """Of the fractional part, all documents but one are those with the least keys."""
    docs = spark.createDataFrame([(i, "w " * 10, "s") for i in range(500)] + [(900 + i, "w " * 10, "t") for i in range(500)] + [(1900 + i, "w " * 10, "u") for i in range(500)], "doc_id long, text string, source string")
    rows = mixing.mix(docs)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    order = [r.taken // 10 for r in rows.where("source = 't'").orderBy((-F.log(u)).alias("k")).collect()]
    first = order.index(min(order))
    assert sum(x != min(order) for x in order[first:]) <= 1
    assert 0 < first < 500


# Pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(500)]
    texts, toxic, low = {}, {}, {}
    for i in range(700):
        text = rng.choices(base, k=rng.randint(30, 80))
        toxic[i], low[i] = rng.random() < 0.12, rng.random() < 0.12
        if toxic[i]:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), "gromble")
        texts[i] = " ".join(text).upper().replace(" ", "!! ") if low[i] else " ".join(text)
    clean = [i for i in texts if not toxic[i] and not low[i]]
    item = " ".join(rng.choices(base, k=20))
    texts[clean[0]] = item + " and more"
    texts[clean[2]] = texts[clean[1]]
    texts[clean[4]] = texts[clean[3]] + " end"
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not low[i]), int(toxic[i])) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({r.doc_id for r in docs.collect()})
    assert seen[0] == {i for i in texts if not toxic[i]}
    assert seen[1] == set(clean)
    assert seen[2] == set(clean) - {clean[2], clean[4]}
    assert seen[3] == seen[2] - {clean[0]}
    sizes = collections.Counter()
    for i in seen[3]:
        sizes[f"s{i % 3}"] += len(words(texts[i]))
    taken = collections.Counter()
    for r in docs.collect():
        taken[r.source] += r.taken
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) < 0.02 * t
    final = {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert final == {(r.doc_id, r.taken) for r in docs.collect()}


def test_mixing_by_weights(spark, monkeypatch):
    """Heavier documents are taken more often; the caller's columns keep their values; no broadcast is needed."""
    monkeypatch.setattr(mixing, "_BROADCAST_ROWS", 0)
    rows = [(i, "w " * 10, s, [0.1, 1.0][i % 2], "mine") for k, s in enumerate("stu") for i in range(1000 * k, 1000 * k + 500)]
    rows += [(9000, "w", None, None, "mine"), (9001, "w", None, float("nan"), "mine"), (9002, "w", None, float("inf"), "mine"), (9003, "w", None, -1.0, "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double, _key string")
    got = mixing.mix(docs, weight="weight").collect()
    assert {r._key for r in got} == {"mine"}
    part = [r for r in got if r.source == "t"]
    extra = {w: sum(r.taken - min(x.taken for x in part) for r in part if r.weight == w) for w in (0.1, 1.0)}
    assert extra[1.0] > 1.4 * extra[0.1]


def test_pipeline_of_odd_tables(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", None, 5, "x"), (1, text, "en", None, 5, "x"), (2, text, None, "s", None, None), (None, text, "en", "s", 1, "y"), (None, None, None, None, None, "z"), (7, "", "en", "s", 0, "e"), (8, "word " * 60_000, "en", "s", 0, "long")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, n_hit string, key string, expected_grade string"
    docs = spark.createDataFrame([(*r, "kept", "kept", "kept") for r in rows], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        sizes.append(docs.count())
        assert all(r.n_hit == r.key == r.expected_grade == "kept" for r in docs.collect())
    assert sizes[:4] == [7, 7, 4, 4]
    assert {r.doc_id for r in docs.collect()} <= {1, 8}


def test_rounds_give_back_heap(spark, monkeypatch):
    """Between the steps of the join the executors give back heap, so that what single steps need does not add up."""
    given = []
    monkeypatch.setattr(jaccard, "relieved", given.append, raising=False)
    texts = [" ".join(f"w{(i // 4) * 50 + k}" for k in range(40)) + f" end{i}" for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in jaccard.join_sets(docs).collect()} == {0, 4, 8}
    assert len(given) >= 3
