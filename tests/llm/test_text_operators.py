"""Operators on whole texts against brute force, round trips and held-out accuracy."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkwright.llm import chat, decontam, eliasfano, htmltext, lm, quality, textops, tokencounts, toxicity

LETTERS = "abcdefgh"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows(spark, texts, extra=""):
    """doc_id from 0; ``extra`` adds columns whose names clash with results."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumns({c: F.lit("mine") for c in extra.split()}) if extra else df


ODD = [None, "", " ", "\n\t", "one", "one two", "x" * 200_000, "word " * 50_000, "é à ç", "\x00a\x7fb", "same text here now", "same text here now"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB \t\né \x1f", max_size=30), max_size=6))
def test_words_and_hashes(texts):
    raw = [t.encode() for t in texts]
    got = [h[at[i] : at[i + 1]].tolist() for _, _, h, at in textops.hashed_words(raw) for i in range(len(at) - 1)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    names = {}
    for a, b in zip([x for g in got for x in g], [x for w in want for x in w], strict=True):
        assert names.setdefault(b, a) == a
    assert len(set(names.values())) == len(names)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(1)
    texts = [b" ".join(rng.choices([b"a", b"bb", b"c" * 90, b"\t", b"dd\nee"], k=n)) for n in (0, 3, 200, 1, 500)]
    whole = [h[at[i] : at[i + 1]].tolist() for _, _, h, at in textops.hashed_words(texts) for i in range(len(at) - 1)]
    monkeypatch.setattr(textops, "PASS_BYTES", 64)
    assert [h[at[i] : at[i + 1]].tolist() for _, _, h, at in textops.hashed_words(texts) for i in range(len(at) - 1)] == whole


# Decontamination


def brute_hits(text, items, window):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = set(), set()
    for name, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        n = min(window, len(v))
        for s in range(len(v) - n + 1) if n else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[s : s + n]:
                    hit.update(range(i, i + n))
                    found.add(name)
    return len(w), len(hit), sorted(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab ", max_size=24), max_size=4), st.lists(st.text("abc ", max_size=40), min_size=1, max_size=3), st.integers(1, 5))
def test_automaton(items, texts, window):
    named = [(str(i), t) for i, t in enumerate(items)]
    automaton = decontam.Automaton([(n, decontam.words(t.encode())) for n, t in named], window)
    for text in texts:
        tokens = decontam.words(text.encode())
        spans, found = automaton.scan(tokens)
        assert (len(tokens), sum(e - s for s, e in spans), sorted(found)) == brute_hits(text, named, window)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_decontamination(spark):
    rng = random.Random(3)
    words = [rng.choice(LETTERS) + rng.choice(LETTERS) for _ in range(60)]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate((20, 15, 13, 3, 1, 0))] + [(9, None)]
    texts = [*ODD, items[0][1], "x " * 300 + items[1][1].upper() + "," + " y" * 30, "zz " * 400 + items[2][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = rows(spark, texts, "n_words hit_spans note")
    got = {r.doc_id: r for r in decontam.find_hits(docs, bench).collect()}
    blocks = {r.doc_id: r for r in decontam.find_hits(docs, bench, max_block_bytes=30).collect()}
    named = [(str(k), t) for k, t in items if t]
    for i, t in enumerate(texts):
        for r in (got[i], blocks[i]):
            assert (r.n_words, r.n_hit, r.item_ids) == brute_hits(t, named, 13)
            assert r.note == "mine"
    kept = decontam.decontaminate(rows(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if not (lambda n, h, _: h and 20 * h >= n)(*brute_hits(t, named, 13))}
    cut = {r.doc_id: r.text for r in decontam.remove_spans(rows(spark, texts), bench).collect()}
    assert all(brute_hits(t, named[:3], 13)[1] == 0 for t in cut.values())
    assert cut[len(texts) - 1].strip() == ("zz " * 400).strip()
    assert decontam.find_hits(docs.limit(0), bench).count() == 0
    assert decontam.find_hits(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_spans_go_in_the_step_that_finds_them(spark):
    rng = random.Random(9)
    items = [" ".join(rng.choices(LETTERS, k=14)) for _ in range(12)]
    texts = [" ".join([*rng.choices("pqrst", k=400), items[i % 12], "end"]) for i in range(24)] + [None, "", items[3], "p q"]
    docs, bench = rows(spark, texts, "n_hit"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    once = decontam.remove_spans(docs, bench)
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = {i: t.replace(items[i % 12] + " ", "") for i, t in enumerate(texts) if t} | {24: None, 25: ""}
    del want[26]
    assert {r.doc_id: r.text for r in once.collect()} == want
    assert {r.doc_id: r.text for r in decontam.remove_spans(docs, bench, max_block_bytes=60).collect()} == want
    assert once.columns == docs.columns


# Toxicity


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    out = []
    for _ in range(n):
        bad = rng.random() < 0.15
        text = rng.choices(words, k=rng.randint(20, 120))
        for _ in range(max(1, len(text) // 40) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["gromble", "vexard", "plunkhead"]))
        out.append((" ".join(text), int(bad)))
    return out


def test_toxicity(spark):
    corpus = toxic_corpus(1500, 1)
    docs = rows(spark, [t for t, _ in corpus])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(corpus)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    scorer = toxicity.train(docs, labels)
    own = toxicity.Scorer(scorer.rules, scorer.rate, scorer.weights, scorer.grams).ready()
    held = toxic_corpus(400, 2)
    assert np.mean([(own.score(t) >= 0.7) == y for t, y in held]) > 0.98
    plain = "this text says gromble to you"
    for hidden in ("gr0mble", "g.r.o.m.b.l.e", "grommmmble", "GROMBLE!!", "gr0mbl3", "g r o m b l e", "gr0m-ble"):
        assert own.score(plain.replace("gromble", hidden)) >= 0.7, hidden
    for clean in ("", None, "a b c d e", "10 000 and 3.14", "&&& *** the&&&", "one---two"):
        assert own.score(clean) < 0.5, clean
    scored = toxicity.add_scores(rows(spark, [*ODD, plain], "score predicted lang"), scorer).orderBy("doc_id").collect()
    assert [r.predicted for r in scored] == [0] * len(ODD) + [1]
    assert all(0 <= r.score <= 1 and r.lang == "mine" for r in scored)
    assert scored[-2].score == scored[-3].score
    assert toxicity.add_scores(docs.limit(0), scorer).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.add_scores(docs, none).where("predicted = 1").count() == 0


# Quality


def test_ordinal_grades(spark):
    rng = random.Random(5)
    kinds = [["zog", "blip", "wum"], ["fine", "good", "nice"], ["lucid", "deep", "sound"], ["great", "grand", "noble"]]
    common = [f"w{i}" for i in range(50)]

    def text(g):
        return " ".join(rng.choices(common, k=30) + rng.choices(kinds[g], k=4))

    grades = [rng.randrange(4) for _ in range(800)]
    docs = rows(spark, [text(g) for g in grades])
    labels = spark.createDataFrame([*enumerate(grades), (None, 1), (3, None)], "doc_id long, grade int")
    model = quality.train(docs, labels, "grade")
    assert model.grades == [0, 1, 2, 3]
    assert (np.diff(model.thresholds) > 0).all()
    held = [rng.randrange(4) for _ in range(200)]
    got = quality.add_grades(rows(spark, [text(g) for g in held], "expected_grade lang"), model).orderBy("doc_id").collect()
    assert np.mean([abs(r.expected_grade - g) < 0.8 for r, g in zip(got, held, strict=True)]) > 0.9
    assert all(list(r.tail_probabilities) == sorted(r.tail_probabilities, reverse=True) and r.lang == "mine" for r in got)
    assert quality.add_grades(rows(spark, ODD), model).where(quality.passes(0.0)).count() == len(ODD)
    assert quality.add_grades(docs.limit(0), model).count() == 0
    one = quality.train(docs, labels.where("grade = 2"), "grade")
    assert {r.expected_grade for r in quality.add_grades(docs, one).collect()} == {2.0}
    assert quality.add_grades(docs, quality.train(docs, labels.limit(0), "grade")).where(quality.passes()).count() == 800


# Chat

TEXT = st.lists(st.sampled_from([*"ab\\<|>[]/\n", "<|end|>", "</s>", "[INST]", "<<SYS>>", "<|turn|>", "é"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "sys\n<|text|>"]), TEXT), max_size=6))
def test_chat_round_trip(turns):
    found = list(chat.examples(turns))
    assert sum(s is not None for _, s, _ in found) == sum(r == "assistant" for r, _ in turns)
    if turns:
        assert chat.read_back(found[-1][0]) == turns
    assert [chat.unescape(t[s:e]) for t, s, e in found if s is not None] == [t for r, t in turns if r == "assistant"]
    for _, said in turns:
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", chat.escape(said))


def test_chat_table(spark):
    data = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (2, 1, None, "x"), (None, 0, "assistant", "n"), (1, 2, "assistant", "b"), (1, 2, "assistant", "b")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("mine"))
    rows_ = chat.expand(df).collect()
    assert collections.Counter(r.conv_id for r in rows_) == {1: 3, 2: 1, None: 1}
    got = {r.conv_id: r for r in chat.digests(chat.expand(df)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[2].n_turns, got[2].loss_chars, got[None].n_turns) == (4, 3, 2, 0, 1)
    assert chat.digests(chat.expand(df.limit(0))).count() == 0


# Language model


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 300), max_size=200), st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 310), max_size=20))
def test_elias_fano(values, wanted):
    values = sorted(values)
    ef = eliasfano.EliasFano(*eliasfano.EliasFano.encode(np.array(values, np.uint64)))
    assert ef.at(np.arange(len(values))).tolist() == values
    want = [next((i for i, v in enumerate(values) if v >= w), len(values)) for w in wanted]
    assert ef.successor(np.array(wanted, np.uint64))[0].tolist() == want
    if len(values) > 1:
        k = np.arange(len(values) - 1)
        assert [x.tolist() for x in ef.both(k)] == [values[:-1], values[1:]]
    found = ef.find(np.array([*wanted, *values], np.uint64)).tolist()
    assert found == [values.index(x) if x in values else -1 for x in [*wanted, *values]]


def test_elias_fano_is_compact():
    values = np.sort(np.random.default_rng(1).integers(0, 2**40, 100_000).astype(np.uint64))
    n, width, low, high = eliasfano.EliasFano.encode(values)
    ef = eliasfano.EliasFano(n, width, low, high)
    assert (len(low) + len(high)) * 8 < n * (np.log2(2**40 / n) + 2.3)
    assert ef.ones.nbytes <= len(high) / 2
    assert (ef.at(np.arange(0, n, 7)) == values[::7]).all()
    runs = eliasfano.EliasFano(*eliasfano.EliasFano.encode(np.repeat(np.arange(3, dtype=np.uint64) << np.uint64(40), 700)))
    assert runs.successor(np.array([0, 1, 1 << 40, 2 << 40, 1 << 60], np.uint64))[0].tolist() == [0, 700, 700, 1400, 2100]


def floored(p):
    return 10 ** (-min(max(math.ceil(-math.log10(p) * 32 - 1e-9), 0), 254) / 32)


def test_trie():
    rng = np.random.default_rng(0)
    seen = collections.Counter()
    for v, w, u in zip(rng.integers(0, 9, 900), rng.integers(0, 12, 900), rng.integers(0, 7, 900), strict=True):
        seen[int(v) << 50, int(w), int(u)] += 1
    keys = sorted(seen)
    v, w, u = (np.array([k[i] for k in keys], np.uint64) for i in range(3))
    trie = eliasfano.Trie.of(v, w, u, np.array([seen[k] for k in keys]), (5.0, 2.0))
    every = sorted({(a << 50, b, c) for a in range(10) for b in range(14) for c in range(8)})
    contexts = sorted({k[0] for k in every})
    p, rest = trie.query(np.array(contexts, np.uint64), np.full(10, 14), np.tile(np.arange(14, dtype=np.uint64), 10), np.full(140, 8), np.tile(np.arange(8, dtype=np.uint64), 140))
    c_v, c_vw, c_uv = collections.Counter(), collections.Counter(), collections.Counter()
    for (a, b, c), n in seen.items():
        c_v[a] += n
        c_vw[a, b] += n
        c_uv[a, c] += n
    whole = collections.Counter()
    for (a, b, c), code, back in zip(every, p.tolist(), rest.tolist(), strict=True):
        p2, b3, b2 = c_vw[a, b] / (c_v[a] + 5), floored(2 / (c_uv[a, c] + 2)), floored(5 / (c_v[a] + 5))
        want = floored((seen[a, b, c] + 2 * p2) / (c_uv[a, c] + 2)) if seen[a, b, c] else floored(p2) * b3 if p2 else 0.0
        assert math.isclose(eliasfano.value_of(np.array(code)), want, rel_tol=1e-9)
        assert math.isclose(10 ** (-back / 32), b3 * b2, rel_tol=1e-9)
        whole[a, c] += want + b3 * b2 / 14
    assert all(0.8 < x <= 1 + 1e-9 for x in whole.values())
    empty = eliasfano.Trie.of(*(np.empty(0, np.uint64) for _ in range(3)), np.empty(0, np.int64), (5.0, 2.0))
    assert [x.tolist() for x in empty.query(np.array([5], np.uint64), np.array([1]), np.array([1], np.uint64), np.array([1]), np.array([1], np.uint64))] == [[eliasfano.ABSENT], [0]]


@pytest.mark.parametrize(("from_files", "shard_tokens"), [(False, 10**6), (True, 10**6), (True, 60)])
def test_language_model(spark, tmp_path, from_files, shard_tokens):
    """Against counts in plain dictionaries; with small shards frequent words are split by the word before."""
    rng = random.Random(8)
    texts = [*ODD, *(" ".join(rng.choices(["The", "the", "cat", "dog", "sat", "ran"], k=rng.randint(0, 30))) for _ in range(80))]
    if shard_tokens < 100:
        texts = [t for t in texts if len(t or "") < 1000]
    docs = rows(spark, texts, "score n_tokens")
    if from_files:
        docs.repartition(3).write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    got = {r.doc_id: r for r in lm.score(docs, learn, chunk_bytes=500, shard_tokens=shard_tokens, from_files=from_files).collect()}
    splits = lm._splits(docs, shard_tokens)
    assert (len(splits.names) > 3) if shard_tokens < 100 else splits.shards == 8

    def name(word):
        return int(next(textops.hashed_words([word.encode()]))[2][0]) if word else int(lm.END)

    hashes = {"<s>": int(lm.START)}
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for t in texts]
    for w in tokens:
        for x in w:
            if x not in hashes:
                hashes[x] = name(x)
    learnt = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    names = {}

    def context(v, u):
        if (v, u) not in names:
            names[v, u] = int(splits.context(np.array([hashes[v]], np.uint64), np.array([hashes[u]], np.uint64))[0])
        return names[v, u]

    c, c_v, c_vw, c_uv, c_uvw = (collections.Counter() for _ in range(5))
    grams = [[(u, v, x, context(v, u)) for u, v, x in zip(["<s>", "<s>", *w], ["<s>", *w], w, strict=False)] for w in tokens]
    for w, own, g in zip(tokens, learnt, grams, strict=True):
        if own:
            c.update(w)
            for u, v, x, k in g:
                c_v[k] += 1
                c_vw[k, x] += 1
                c_uv[k, u] += 1
                c_uvw[k, u, x] += 1
    n, size = sum(c.values()), len(c)
    m2, m3 = lm.MASSES
    for i, w in enumerate(tokens):
        p1 = [(c[x] + 0.5) / (n + 0.5 * (size + 1)) for x in w]
        total = 0.0
        for (u, _, x, k), q in zip(grams[i], p1, strict=True):
            p2, b3, b2 = c_vw[k, x] / (c_v[k] + m2), floored(m3 / (c_uv[k, u] + m3)), floored(m2 / (c_v[k] + m2))
            p = floored((c_uvw[k, u, x] + m3 * p2) / (c_uv[k, u] + m3)) if c_uvw[k, u, x] else floored(p2) * b3 if p2 else 0.0
            total += math.log10(min(p + b3 * b2 * q, 1))
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, not learnt[i])
        assert math.isclose(r.base_score, sum(map(math.log10, p1)), rel_tol=1e-9)
        assert math.isclose(r.score, total, rel_tol=1e-9)
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_language_model_without_training(spark):
    got = lm.score(rows(spark, ["a b", None]), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)


# HTML


@pytest.fixture(scope="module")
def trees():
    return htmltext.train()


def test_html_held_out(trees):
    rng, exact = random.Random(4711), 0
    for _ in range(150):
        page = htmltext._page(rng)
        tree = htmltext.parse(page)
        label = np.zeros(len(tree.tag), bool)
        label[0] = True
        for i in range(1, len(tree.tag)):
            own = re.search(r'data-keep="(\d)"', tree.attrs[i])
            label[i] = label[tree.parent[i]] and tree.tag[i] not in htmltext.UNSEEN and (own is None or own[1] == "1")
        exact += htmltext.text_of(tree, label) == htmltext.extract(re.sub(r' data-keep="\d"', "", page), trees)
    assert exact >= 135


def test_html_pages(trees):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></ul></nav><div class="ad">Buy this.</div>'
        "<article><h1>A &amp; b &lt;c&gt;</h1><p><b>One  two,\n three.<br><p>Second para &#233;.</article><footer>&copy; x</footer>"
    )
    assert htmltext.extract(page, trees) == "A & b <c>\nOne two, three.\nSecond para é."
    assert htmltext.extract(None, trees) == htmltext.extract("", trees) == ""
    assert htmltext.extract("<p>" * 5000 + "word " * 2000, trees).startswith("word")
    assert isinstance(htmltext.extract("<div>" * 3000 + "x" + "<a <b <!-- never closed", trees), str)


def test_no_contradiction(trees):
    rng = random.Random(12)
    for _ in range(30):
        tree = htmltext.parse(htmltext._page(rng))
        kept = htmltext.decode(tree, trees.predict(htmltext.features(tree)), htmltext.own_text(tree))
        assert all(kept[tree.parent[i]] for i in range(1, len(tree.tag)) if kept[i])


def test_html_table(spark, trees):
    df = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<article><p>Hello there, world.</p></article>")], "page_id long, url string, html string").withColumn("n_chars", F.lit("mine"))
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.add_text(df, trees).collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("Hello there, world.", 19)}
    assert htmltext.add_text(df.limit(0), trees).count() == 0


# Token counts


def test_rollup(spark, tmp_path):
    rollup = tokencounts.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    docs = spark.createDataFrame([("a", "en", "one two"), ("a", None, None), (None, "de", "x" * 100_000), ("a", "en", "one two")], "source string, lang string, text string").withColumn("n_tokens", F.lit("mine"))
    counted = tokencounts.count_tokens(docs, None)
    assert rollup.commit("b1", tokencounts.changes(counted, "w"))
    assert not rollup.commit("b1", tokencounts.changes(counted, "w"))
    want = {("a", "en", "w", 2, 4), ("a", None, "w", 1, 0), (None, "de", "w", 1, 1)}
    assert set(map(tuple, rollup.totals().collect())) == want
    one = counted.where("lang = 'en'").limit(1)
    assert rollup.commit("b2", tokencounts.changes(one, "w", -1).union(tokencounts.changes(one.withColumn("n_tokens", F.lit(7).cast("long")), "v2")))
    assert set(map(tuple, rollup.totals().collect())) == (want - {("a", "en", "w", 2, 4)}) | {("a", "en", "w", 1, 2), ("a", "en", "v2", 1, 7)}
    rollup.commit("b3", tokencounts.changes(counted.where("source is null"), "w", -1))
    assert rollup.totals().where("source is null").count() == 0
    assert rollup.commit("b4", tokencounts.changes(counted.limit(0), "w"))


def test_vocabulary_counts(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
    encode = tokencounts._encoding(open(path, "rb").read(), tokencounts.PIECES).encode_ordinary  # noqa: SIM115
    got = {r.doc_id: r.n_tokens for r in tokencounts.count_tokens(rows(spark, ODD), path).collect()}
    assert got == {i: len(encode(t)) if t else 0 for i, t in enumerate(ODD)}


PAGES = [
    (
        '<html><body><header><h1>Site</h1><nav><a href="/">Home</a></nav></header><article><header><h1>Title of the piece</h1><p>A subtitle for it.</p></header>'
        "<p>This is <a href=1>first</a> and <a href=2>second</a> and also <a href=3>third</a> in prose.</p><p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> is here, as everybody knows.</p>"
        "</article><footer>&copy; 2020 Foo. All rights reserved.</footer></body></html>",
        "Title of the piece\nA subtitle for it.\nThis is first and second and also third in prose.\nEnergy E=m is here, as everybody knows.",
    ),
    (
        "<body><div id=sidebar><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div><div class='content'><h1>Hello</h1><p>Some text goes here, with more words.</p>"
        "<ul><li>item one is here</li><li>item two is there</li></ul></div><div class='comments'><h3>Comments</h3><div class=comment>Nice post!</div></div>"
        "<div class=cookie-banner>We use cookies. <button>OK</button></div></body>",
        "Hello\nSome text goes here, with more words.\nitem one is here\nitem two is there",
    ),
    ("<div>5 < 6 and 7 > 3</div><a href=", "5 < 6 and 7 > 3"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_html_by_hand(trees, page, text):
    assert htmltext.extract(page, trees) == text


@pytest.mark.parametrize(
    "form", ["<a ", "<noscript>", "<", '<a b="x ', "<!-- ", "<p>", "<div>", "<ul><li>", "<!x", "<table><tr><td>", "<script>", '<a =">x<a =\'>', "<a b='\"", "</i>", "<b></i>", "&amp", "<math>"]
)
def test_broken_pages_are_parsed_in_linear_time(form):
    import time

    began = time.time()
    htmltext.parse("<i><div>" + form * (1_000_000 // len(form)))
    assert time.time() - began < 20


# Toxicity: the decoder and its bounds


def every_reading(token):
    """All plain words that the channel allows, with their costs."""
    out = {"": 0.0}
    found = {("", ""): 0.0}
    for i, c in enumerate(token):
        run = i and c == token[i - 1] and (token[i + 1 : i + 2] == c or token[i - 2 : i - 1] == c)
        new = {}
        for (word, last), cost in found.items():
            options = [(x, toxicity._SWAP) for x in toxicity.LOOKALIKES.get(c, "")]
            if c.isalpha():
                options.append((c, 0.0 if c not in toxicity.LOOKALIKES else toxicity._KEEP))
            elif c.isdigit():
                options.append((c, toxicity._KEEP))
            moves = [((word + x, c), cost + k) for x, k in options]
            if not c.isalnum():
                moves.append(((word, last), cost + toxicity._DROP))
            elif run and last == c:
                moves.append(((word, last), cost + toxicity._REPEAT))
            for key, k in moves:
                new[key] = max(new.get(key, -math.inf), k)
        found = new or found
    out = {}
    for (word, _), cost in found.items():
        out[word] = max(out.get(word, -math.inf), cost)
    return out


@settings(max_examples=60, deadline=None)
@given(st.text("ab013@.aaa", min_size=1, max_size=7))
def test_viterbi_finds_the_best_reading(token):
    grams = collections.Counter(g for w in ("abba", "baa", "aib", "eab", "aeo", "bbb") for g in toxicity.grams_of(w))
    model = toxicity.CharModel.of(grams)

    def value(word, cost):
        padded = "^^^" + word + "$"
        return cost + sum(model.logp(padded[i : i + 3], padded[i + 3]) for i in range(len(word) + 1))

    readings = every_reading(token)
    best = max(value(w, c) for w, c in readings.items())
    got = toxicity.restore(token, model)
    assert math.isclose(value(got, readings[got]), best, rel_tol=1e-9)


def test_long_runs_score_in_linear_time():
    import time

    grams = {"^^^a": 5, "^^ab": 3, "^abc": 3, "abc$": 2}
    own = toxicity.Scorer({"abc": (3.0, True)}, 0.0, (1.0, 1.0, 1.0), grams).ready()
    for sep in " \t.,-_*/@$!|+(&":
        began = time.time()
        for text in ("a b c " + sep * 100_000 + "ab", "a" + sep * 100_000 + "a", ("a" + sep) * 50_000, (sep + "1") * 50_000):
            own.score(text)
        assert time.time() - began < 10, sep


def test_disguised_words_are_learnt(spark):
    rng = random.Random(4)
    corpus = toxic_corpus(600, 3)
    hide = {"gromble": "gr0mble", "vexard": "v.exard", "plunkhead": "plunkkkhead"}
    texts = [" ".join(hide[w] if w in hide and rng.random() < 0.5 else w for w in t.split()) for t, _ in corpus]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(corpus)], "doc_id long, toxic int")
    docs = rows(spark, [*texts, None, ""]).union(rows(spark, texts).where("doc_id < 50"))
    scorer = toxicity.train(docs, labels.union(spark.createDataFrame([(600, 0), (601, 0)], labels.schema)))
    again = toxicity.train(docs.repartition(3), labels.repartition(2).union(spark.createDataFrame([(600, 0), (601, 0)], labels.schema)))
    assert scorer.rules == again.rules
    assert scorer.weights == again.weights
    assert {"gromble", "vexard", "plunkhead"} <= {r.rstrip("*") for r in scorer.rules} | {w for r in scorer.rules for w in hide if r.endswith("*") and w.startswith(r[:-1])}
    clash = rows(spark, ["this gromble gromble gromble text", "fine"], "score predicted")
    kept = toxicity.drop_toxic(clash, scorer)
    assert kept.columns == clash.columns
    assert [tuple(r) for r in kept.collect()] == [(1, "fine", "mine", "mine")]


def test_toxicity_learns_from_all_rows(spark):
    """A word of the few toxic rows among more than 8,000 is learnt from all of them; counts in small parts are the same."""
    rng = random.Random(7)
    words = ["".join(rng.choices("aeioulnrst", k=6)) for _ in range(300)]
    texts = [" ".join([*rng.choices(words, k=8), *(["zqualm"] if i % 1700 == 0 else [])]) for i in range(17_000)]
    labels = spark.createDataFrame([(i, int(i % 1700 == 0)) for i in range(17_000)], "doc_id long, toxic int")
    scorer = toxicity.train(rows(spark, texts), labels)
    ratio = math.log(10.5 / (0.5 / ((16_990 * 8) / (10 * 9))))
    assert any(math.isclose(r[0], ratio, rel_tol=0.02) for f, r in scorer.rules.items() if f.startswith("zqu"))
    counts = toxicity._counted(rows(spark, texts[:300]).select("text"), toxicity._grams, ["n"])
    want = {r.key: r.n for r in counts.collect()}
    assert want["zqua"] == sum("zqualm" in t for t in texts[:300])
    few = toxicity._counted(rows(spark, texts[:300]).repartition(1).select("text"), toxicity._grams, ["n"])
    assert {r.key: r.n for r in few.collect()} == want


def test_logistic_steps_agree(spark):
    rng = random.Random(3)
    points = [(float(y), y * rng.random() * 9, rng.gauss(3 * y - 2, 2), rng.randint(1, 4)) for y in (0, 1) for _ in range(40)]
    inputs = spark.createDataFrame(points, "y double, x1 double, x2 double, n long")
    a, b = (toxicity._weights(inputs, most=k) for k in (100, 10))
    assert np.allclose(a, b, rtol=1e-8)
    x = np.array([[p[1], p[2], 1.0] for p in points])
    n, y = np.array([p[3] for p in points]), np.array([p[0] for p in points])
    assert np.abs(x.T @ (n * (y - 1 / (1 + np.exp(-x @ a)))) - 0.05 * np.array(a)).max() < 1e-6


def test_steps_of_toxicity_leave_no_cache():
    """Workers are used again by later stages: what a module keeps would stay in each of them."""
    assert not [k for k, x in vars(toxicity).items() if hasattr(x, "cache_info")]


def test_feature_counts_of_parts(monkeypatch):
    """Counts in Arrow are those of a plain count, for rows in one part or in many, and a text counts once for a feature."""
    rng = random.Random(11)
    names = ["ab", "abc", "abcd\x1fabcé", "abcdefgh", "abcd\x1f", "gr0mble\x1fgromble", "x" * 50, "éàçñ"]
    table = [(rng.random() < 0.4, {x: rng.randint(1, 5) for x in rng.sample(names, rng.randint(0, 6))}) for _ in range(40)]
    want = collections.defaultdict(lambda: [0, 0, 0, 0])
    for y, groups in table:
        own = {g: {f for w in g.split("\x1f") for f in [w, *(f"{w[:n]}*" for n in range(3, 8) if len(w) >= n)]} for g in groups}
        for f in set().union(*own.values()):
            want[f][y] += 1
        for g, n in groups.items():
            for f in own[g]:
                want[f][2 + y] += n
    kinds = pa.schema([("toxic", pa.bool_()), ("names", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])
    batch = pa.RecordBatch.from_pylist([{"toxic": y, "names": list(g), "times": list(g.values())} for y, g in table], schema=kinds)
    for keys, groups in ((200_000, 100_000), (5, 7)):
        monkeypatch.setattr(toxicity, "_KEYS", keys)
        monkeypatch.setattr(toxicity, "_GROUPS", groups)
        got = collections.defaultdict(lambda: [0, 0, 0, 0])
        for part in toxicity._feature_counts(iter([batch.slice(0, 13), batch.slice(13, 0), batch.slice(13)])):
            for key, *sums in zip(*(c.to_pylist() for c in part.columns), strict=True):
                got[key] = [a + b for a, b in zip(got[key], sums, strict=True)]
        assert got == want
    assert list(toxicity._feature_counts(iter([]))) == []


def test_usual_tokens_take_the_short_way(monkeypatch):
    """A token is looked into once for all texts of a task, and the short ways change no result."""
    rng = random.Random(5)
    signs = "abcAB é1@$!|+(.,-_ \t\u0301\u00adﬁªµаіѕ0'\"*/K€"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(1500)] + ["h a t e you", "x h.a.t.e a b c", "a  b  c  d", "A-B-C-D e f g", "so \"Fine,\" grooom (bac) Übel?!"] * 2
    model = toxicity.CharModel.of({g: 2 for w in ("abba", "hate", "fine", "éa") for g in toxicity.grams_of(w)})
    seen, real = collections.Counter(), toxicity.variants
    monkeypatch.setattr(toxicity, "variants", lambda t, *rest: (seen.update([t]), real(t, *rest))[1])
    known = {}
    short = [toxicity.forms(t, model, {}, known) for t in texts]
    assert set(seen.values()) == {1}
    monkeypatch.setattr(toxicity, "_USUAL", re.compile("(?!)"))
    monkeypatch.setattr(toxicity, "_LOOSE", re.compile(""))
    monkeypatch.setattr(toxicity, "_MARKS", "")
    assert [toxicity.forms(t, model, {}, {}) for t in texts] == short


# Quality: bounds, ties, slopes


def test_quality_learns_from_all_rows(spark):
    """Rows beyond one shard count: each of 30 words marks two rows of low quality, and all are learnt."""
    rng = random.Random(8)
    common = [f"w{i}" for i in range(40)]
    marks = ["".join(rng.choices("xyzqk", k=7)) for _ in range(30)]
    texts = [" ".join([*rng.choices(common, k=10), *([marks[i % 30]] * 5 if i < 60 else [])]) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(600)], "doc_id long, grade int")
    a, b = (quality.train(rows(spark, texts).repartition(k), labels, "grade", max_rows=100) for k in (2, 5))
    assert (a.words == b.words).all()
    assert (a.thresholds == b.thresholds).all()
    assert (a.values([(m + " ").encode() for m in marks]) < a.values([b"w1 w2 w3"])[0]).all()


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i} of words") for i in range(300)] + [(2, "same"), (3, "same")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 2)], "doc_id long, grade int")
    a, b = (quality.train(docs.repartition(k), labels, "grade", max_rows=400, rounds=5) for k in (2, 5))
    assert a.grades == [1, 2]
    assert (a.words == b.words).all()
    assert (a.thresholds == b.thresholds).all()
    kept = textops.bounded(docs.withColumn("k", F.xxhash64("text")), F.col("k"), 10)
    assert kept.count() == 10
    low = quality.drop_low(rows(spark, ["text 1 of words"], "expected_grade tail_probabilities"), a)
    assert low.columns == ["doc_id", "text", "expected_grade", "tail_probabilities"]


def test_likelihood_slopes():
    rng = np.random.default_rng(5)
    n, k, width = 12, 4, 7
    y, sizes = rng.integers(0, k, n), rng.integers(1, 5, n)
    keys, times, pairs = rng.integers(0, width, sizes.sum()), rng.random(sizes.sum()), rng.random((n, 3))
    params = [rng.normal(size=width) * 0.1, rng.normal(size=3) * 0.01, rng.normal(size=k - 1) * 0.3]  # far from where likelihoods are floored
    args = (y, k, np.repeat(np.arange(n), sizes), keys, times, pairs, 0.01)
    _, slopes = quality.loss_and_slopes(params, *args)
    for p, slope in zip(params, slopes, strict=True):
        for i in range(len(p)):
            up, down = ([q.copy() for q in params] for _ in range(2))
            at = next(j for j, q in enumerate(params) if q is p)
            up[at][i] += 1e-6
            down[at][i] -= 1e-6
            assert math.isclose((quality.loss_and_slopes(up, *args)[0] - quality.loss_and_slopes(down, *args)[0]) / 2e-6, slope[i], rel_tol=1e-4, abs_tol=1e-6)


# Token counts: batch ids, compaction, counts against plain code


def test_rollup_ids_and_compaction(spark, tmp_path):
    rollup = tokencounts.Rollup(spark, str(tmp_path / "rollup"))
    one = spark.createDataFrame([("a", "en", 3)], "source string, lang string, n_tokens long")
    for name in ("2024/01", "../x", "", "é%2F ", "batch=1"):
        assert rollup.commit(name, tokencounts.changes(one, "w"))
        assert rollup.committed(name)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "w", 5, 15)]
    rollup.compact()
    assert not rollup.commit("2024/01", tokencounts.changes(one, "w"))
    assert rollup.commit("later", tokencounts.changes(one, "w", -1))
    rollup.compact()
    rollup.compact()
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "w", 4, 12)]
    assert not rollup.commit("later", tokencounts.changes(one, "w"))


def test_op2_query(spark, tmp_path):
    from chunkwright.llm import queries

    texts = [*ODD, *(f"some words {i} " * (i % 7) for i in range(60))]
    data = [(i if i != 4 else None, t, [None, "s1", "s2"][i % 3], ["en", None][i % 2]) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = collections.Counter()
    encode = tokencounts._encoding(open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read(), tokencounts.PIECES).encode_ordinary  # noqa: SIM115
    for _, t, s, lang in data:
        for name, n in (("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))), ("byte_bpe_50k", len(encode(t or "")))):
            want[s, lang, name, "docs"] += 1
            want[s, lang, name, "tokens"] += n
    got = queries.op2_token_counts(spark, str(tmp_path)).collect()
    assert len(got) == len(want) / 2
    assert all((r.n_docs, r.n_tokens) == (want[r.source, r.lang, r.tokenizer, "docs"], want[r.source, r.lang, r.tokenizer, "tokens"]) for r in got)
