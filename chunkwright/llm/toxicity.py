"""Toxicity scoring of text restored by a noisy-channel decoder.

A token that may be disguised (letters mixed with digits or symbols, a letter three
times or more in a row, single letters set apart) becomes a character lattice. Viterbi
search over the last three characters finds the most likely plain word under a
character language model, where the channel explains each written character as a look-alike
of a letter, as a separator that was put in, or as a repeated letter. The plain and
the restored tokens are then scored. The channel writes a letter with at most ``WRITTEN``
characters and words have at most ``LETTERS`` letters, so a longer token is no disguise and
stays as it is.

The scorer is learnt from labelled rows, whose texts are decoded like those to be scored: words and
word beginnings become rules where their texts are toxic far more often than chance allows. Their
log-likelihood ratios, summed over a text and held against its length, enter a logistic
score; large sums saturate smoothly, so that more evidence always means a higher input.

Rows: null and empty texts score like texts without a rule. Very long texts and tokens are scored
whole, in linear time. Repeated rows each get the same score. With no labelled rows every score is
near 0; with a few dozen toxic ones no word may stand out, and nothing is flagged. An empty table
gives an empty result. Extra columns pass through; columns named like the results are replaced
(the names are parameters).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwright.llm.textops import fresh, hashed_words, mix, released, small, small_batches, stored, utf8

#: What a written character may stand for.
LOOKALIKES = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "<": "c",
    "€": "e",
    "£": "l",
    "¡": "i",
    "а": "a",
    "е": "e",
    "о": "o",
    "р": "p",
    "с": "c",
    "х": "x",
    "і": "i",
    "ѕ": "s",
    "у": "y",
}
_SWAP, _DROP, _REPEAT, _KEEP = -0.7, -0.7, -0.2, -4.0
_ORDER = 4
_PREFIXES = range(3, 8)
#: Most letters of a word, and most characters that the channel writes for a letter.
LETTERS, WRITTEN = 40, 8
#: Joins the forms of one token; white space to ``str.split``, so it is in no token.
_JOINT = "\x1f"
_ODD = re.compile(r"([^\W\d_])\1\1|[^\W\d_][\W\d_]+[^\W\d_]|\d[^\W\d_]|[^\W\d_]\d|[Ѐ-ӿ]")
_LEAD = re.compile(r"^[@$!|+(<€£¡]{1,2}(?=[^\W_])")
_TRAIL = re.compile(r"(?<=[^\W_])[@$|+€£]{1,2}$")
#: A letter set apart, and what may stand between two. No character is both, so a run is read once.
_APART, _BETWEEN = r"(?:[^\W_]|[@$!|+])", r"[ \t.,\-_*/]"
_SPACED = re.compile(rf"(?<![^\W_])(?<![@$])(?:{_APART}{_BETWEEN}{{1,2}}){{3,}}{_APART}(?![^\W_]|[@$])")
#: What every run has inside: a text without it has none, and most texts are without it.
_LOOSE = re.compile(rf"{_BETWEEN}{_APART}{_BETWEEN}{{1,2}}{_APART}{_BETWEEN}")
#: Tokens that NFKC leaves alone and no disguise is found in, but for a letter three times in a row.
_USUAL = re.compile("[\"']?([A-Za-zÀ-ÖØ-öø-ÿ]+)[.,;:!?)\"']*")
_TRIPLE = re.compile(r"(.)\1\1")
_MARKS = ".,;:!?()\"'"
_HIDDEN = re.compile("[­​-‏⁠﻿̀-ͯ]")


@dataclass
class CharModel:
    """Interpolated (Witten-Bell) character n-gram model of words, with word edges."""

    counts: dict[str, dict[str, int]] = field(default_factory=dict)

    @classmethod
    def of(cls, grams: dict[str, int]) -> CharModel:
        counts: dict[str, dict[str, int]] = defaultdict(dict)
        for gram, n in grams.items():
            for k in range(len(gram)):
                part = counts[gram[k:-1]]
                part[gram[-1]] = part.get(gram[-1], 0) + n
        return cls(dict(counts))

    def logp(self, context: str, c: str) -> float:
        p = 1e-4
        for k in range(len(context), -1, -1):
            if seen := self.counts.get(context[k:]):
                total, kinds = sum(seen.values()), len(seen)
                p = (seen.get(c, 0) + kinds * p) / (total + kinds)
        return math.log(p)


def grams_of(word: str) -> list[str]:
    padded = "^" * (_ORDER - 1) + word + "$"
    return [padded[i : i + _ORDER] for i in range(len(padded) - _ORDER + 1)]


def restore(token: str, model: CharModel, cache: dict[tuple[str, str], float] | None = None) -> str:
    """The most likely plain word behind a token. Long tokens are decoded too, state by state."""
    memo: dict[tuple[str, str], float] = {} if cache is None else cache

    def logp(context: str, c: str) -> float:
        if (context, c) not in memo:
            memo[context, c] = model.logp(context, c)
        return memo[context, c]

    token = token.lower()
    start = "^" * (_ORDER - 1)
    best: dict[tuple[str, str], tuple[float, tuple]] = {(start, ""): (0.0, ())}
    for i, c in enumerate(token):
        run = i and c == token[i - 1] and (token[i + 1 : i + 2] == c or token[i - 2 : i - 1] == c)
        options = [(x, _SWAP) for x in LOOKALIKES.get(c, "")]
        if c.isalpha():
            options.append((c, 0.0 if c not in LOOKALIKES else _KEEP))
        elif c.isdigit():
            options.append((c, _KEEP))
        new: dict[tuple[str, str], tuple[float, tuple]] = {}

        def put(key: tuple[str, str], value: tuple[float, tuple], new: dict = new) -> None:
            if key not in new or new[key][0] < value[0]:
                new[key] = value

        for (context, last), (score, path) in best.items():
            for x, cost in options:
                put((context[1:] + x, c), (score + cost + logp(context, x), (path, x)))
            if not c.isalnum():
                put((context, last), (score + _DROP, path))
            elif run and last == c:
                put((context, last), (score + _REPEAT, path))
        best = new or best
    _, path = max((score + logp(context, "$"), path) for (context, _), (score, path) in best.items())
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


def plain(token: str) -> str:
    """The token in lower case without what is no letter or digit at its ends."""
    token = token.strip(_MARKS)
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b].lower()


def variants(token: str, model: CharModel | None, memo: dict | None = None) -> list[str]:
    """The plain token and, if it may be disguised, what it is restored to."""
    if (usual := _USUAL.fullmatch(token)) and not _TRIPLE.search(own := usual[1].lower()):
        return [own]
    token = unicodedata.normalize("NFKC", token)
    core = plain(token)
    if not core or model is None:
        return [core] if core else []
    shown = _HIDDEN.sub("", token)
    lead, trail = _LEAD.search(shown), _TRAIL.search(shown)
    whole = (lead[0] if lead else "") + plain(shown) + (trail[0] if trail else "")
    if len(whole) > LETTERS * WRITTEN or whole == core and not _ODD.search(core):
        return [core]
    return [core, restore(whole, model, memo)]


def spaced(text: str) -> list[str]:
    """Runs of single letters set apart, joined."""
    return [re.sub(_BETWEEN, "", m[0]) for m in _SPACED.finditer(text)]


def apart(text: str, tokens: Iterable[str], model: CharModel | None, memo: dict | None = None) -> Iterator[list[str]]:
    """The forms of each run of single letters set apart."""
    if _LOOSE.search(text) and sum(len(t) <= 2 for t in set(tokens)) > 2:
        for joined in spaced(text):
            short = model is not None and len(joined) <= LETTERS * WRITTEN
            yield [plain(joined), restore(joined, model, memo)] if short else [plain(joined)]


def forms(text: str | None, model: CharModel | None, memo: dict, known: dict[str, str]) -> tuple[int, dict[str, int]]:
    """How many tokens a text has, and how often each group of forms of one token. ``known`` keeps the groups of tokens."""
    tokens, out = (text or "").split(), {}
    for t, n in Counter(tokens).items():
        group = known.get(t)
        if group is None:
            group = _JOINT.join(dict.fromkeys(variants(t, model, memo)))
            if len(t) <= LETTERS * WRITTEN:
                known[t] = group
        if group:
            out[group] = out.get(group, 0) + n
    for own in apart(text or "", tokens, model, memo):
        group = _JOINT.join(dict.fromkeys(own))
        out[group] = out.get(group, 0) + 1
    return len(tokens), out


class Scorer:
    """Weights of words and word beginnings, and how they make a score.

    ``rules`` maps a feature to its log-likelihood ratio and to whether clean texts all
    but never have it. The ratios of such strict features add up to ``x1``; those of the others,
    less as many as a toxic text of that many words has weak words, make ``x2``.
    """

    def __init__(self, rules: dict[str, tuple[float, bool]], rate: float, weights: tuple[float, float, float], grams: dict[str, int]) -> None:
        self.rules, self.rate, self.weights, self.grams = rules, rate, weights, grams

    def ready(self) -> Scorer:
        """Builds what only a worker needs; the pickled form stays small."""
        self.model = CharModel.of(self.grams) if self.grams else None
        self.memo: dict[tuple[str, str], float] = {}
        self.lengths = sorted({len(r) - 1 for r in self.rules if r.endswith("*")})
        self.head = min(self.lengths, default=_PREFIXES[0])
        self.heads = {(r[:-1] if r.endswith("*") else r)[: self.head] for r in self.rules}
        self.known: dict[str, tuple[float, bool] | tuple[()]] = {}
        return self

    def of_word(self, word: str) -> list[tuple[float, bool]]:
        if word[: self.head] not in self.heads:
            return []
        names = [f"{word[:n]}*" for n in self.lengths if len(word) >= n] + [word]
        return [self.rules[n] for n in names if n in self.rules]

    def of_token(self, token: str) -> tuple[float, bool] | tuple[()]:
        if len(self.memo) > 100_000:
            self.memo.clear()
        return strongest([r for w in variants(token, self.model, self.memo) for r in self.of_word(w)])

    def inputs(self, text: str) -> tuple[float, float]:
        tokens, known = text.split(), self.known
        strict = weak = 0.0
        if len(known) > 150_000:
            known.clear()
        get = known.get
        for t in tokens:
            r = get(t)
            if r is None:
                r = self.of_token(t)
                if len(t) <= LETTERS * WRITTEN:
                    known[t] = r
            if r:
                strict, weak = (strict + r[0], weak) if r[1] else (strict, weak + r[0])
        for words in apart(text, tokens, self.model, self.memo):
            if r := strongest([r for w in words for r in self.of_word(w)]):
                strict, weak = (strict + r[0], weak) if r[1] else (strict, weak + r[0])
        return combined(strict, weak, len(tokens), self.rate)

    def score(self, text: str | None) -> float:
        return logistic(self.inputs(text or ""), self.weights)


def strongest(found: list[tuple[float, bool]]) -> tuple[float, bool] | tuple[()]:
    return (max(f[0] for f in found), any(f[1] for f in found)) if found else ()


def combined(strict: float, weak: float, n: int, rate: float) -> tuple[float, float]:
    """The score's inputs: evidence of strict rules, and of weak ones held against the length; -5 without any of these."""
    return 20 * strict / (20 + strict), _soft(weak - rate * n) if weak else -5.0


def _soft(x: float) -> float:
    return 30 * x / (30 + x) if x > 0 else 10 * x / (10 - x)


def logistic(x: tuple[float, float], w: tuple[float, float, float]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] * x[0] + w[1] * x[1] + w[2]))))


#: Keys that a task counts before it hands their counts on.
_KEYS = 200_000


def _counted(rows: DataFrame, add, names: list[str], spread=None) -> DataFrame:
    """Sums by key over all rows: ``add`` puts a row's counts, one for each name, into a dict. Summed in each task before the shuffle.

    ``spread``, if there is one, then puts a key's counts into another dict, under the keys that come out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                add(counts, *row)
                if len(counts) > _KEYS:
                    yield packed(counts)
                    counts = {}
        yield packed(counts)

    def packed(counts: dict[str, list[int]]) -> pa.RecordBatch:
        if spread:
            own: dict[str, list[int]] = {}
            for key, n in counts.items():
                spread(own, key, *n)
            counts = own
        sums = [pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *sums], ["key", *names])

    schema = "key string, " + ", ".join(f"{n} long" for n in names)
    return rows.mapInArrow(released(run), schema).groupBy("key").agg(*(F.sum(n).alias(n) for n in names))


def chance(hits: int, n: int, rate: float) -> float:
    """Chernoff bound on the chance of ``hits`` or more toxic texts among ``n`` at a base rate."""
    p = hits / n
    if p <= rate:
        return 1.0
    rest = (1 - p) * math.log((1 - p) / (1 - rate)) if p < 1 else 0.0
    return math.exp(-n * (p * math.log(p / rate) + rest))


def rules_of(found: dict[str, tuple[int, int, int, int]], tries: dict[int, int], texts: tuple[int, int], words: tuple[int, int], lift: float, level: float = 0.05) -> dict[str, tuple[float, bool]]:
    """Rules from counts: ``found`` has of each feature the clean and toxic texts with it and its occurrences in both.

    A feature gets a rule if its texts are toxic ``lift`` times as often as others, and far more often
    than chance allows after as many tries as features are in as many toxic texts (``tries``, by the number of
    toxic texts). Of a word and its beginnings, a shorter one goes where a longer one, whose texts
    all have the shorter one too, explains nearly the same toxic texts.
    """
    share, upto, more = texts[1] / sum(texts), {}, 0
    for k in sorted(tries, reverse=True):
        more += tries[k]
        upto[k] = more
    good = {f for f, (clean, toxic, *_) in found.items() if toxic >= lift * share * (clean + toxic) and chance(toxic, clean + toxic, share) * max(upto.get(toxic, 0), 1) < level}
    longest: dict[str, int] = defaultdict(int)
    for f in good:
        for n in _PREFIXES:
            if len(f.rstrip("*")) > n:
                longest[f"{f[:n]}*"] = max(longest[f"{f[:n]}*"], found[f][1])
    odds, rules = max(words[0], 1) / max(words[1], 1), {}
    for f in sorted(f for f in good if longest.get(f, 0) < 0.9 * found[f][1]):
        clean, toxic, t0, t1 = found[f]
        ratio = math.log((t1 + 0.5) / (t0 / odds + 0.5 / odds))
        if ratio > 1:
            rules[f] = (ratio, (toxic + 1) / (clean + toxic + 2) >= 0.98)
    return rules


def _weights(inputs: DataFrame, most: int = 100_000) -> tuple[float, float, float]:
    """Logistic weights of (y, x1, x2, n rows): Newton's steps with a small penalty over all rows.

    Where a count shows at most ``most`` rows the driver adds them up, else each step is one aggregation. Sums are exact
    or of decimals, so that their order does not matter.
    """
    sums = _sums_of(inputs.toArrow()) if inputs.count() <= most else _sums_by_spark(inputs)
    w = np.zeros(3)
    for _ in range(50):
        found = sums(w)
        curve = np.zeros((3, 3))
        curve[np.triu_indices(3)] = found[3:]
        curve = curve + np.triu(curve, 1).T
        step = np.linalg.solve(curve + 0.05 * np.eye(3), np.array(found[:3]) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def _sums_of(table: pa.Table):
    y, x1, x2, n = (table.column(c).to_numpy().astype(float) for c in ("y", "x1", "x2", "n"))
    x = [x1, x2, np.ones(len(y))]

    def sums(w: np.ndarray) -> list[float]:
        p = 1 / (1 + np.exp(-np.clip(w[0] * x1 + w[1] * x2 + w[2], -30, 30)))
        terms = [n * (y - p) * c for c in x] + [n * p * (1 - p) * x[i] * x[j] for i in range(3) for j in range(i, 3)]
        return [math.fsum(t) for t in terms]

    return sums


def _sums_by_spark(inputs: DataFrame):
    x = [F.col("x1"), F.col("x2"), F.lit(1.0)]

    def sums(w: np.ndarray) -> list[float]:
        z = sum((F.lit(float(k)) * c for k, c in zip(w, x, strict=True)), F.lit(0.0))
        rows = inputs.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
        terms = [F.col("n") * (F.col("y") - F.col("p")) * c for c in x]
        terms += [F.col("n") * F.col("p") * (1 - F.col("p")) * x[i] * x[j] for i in range(3) for j in range(i, 3)]
        return [float(v or 0) for v in rows.agg(*(F.sum(t.cast("decimal(38,15)")).alias(f"s{k}") for k, t in enumerate(terms))).first()]

    return sums


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds two min-hashes of the text's four-word shingles."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        keys: list[list[int]] = [[], []]
        for _, _, h, at in hashed_words(utf8(table.column("text"))):
            for i in range(len(at) - 1):
                w = h[at[i] : at[i + 1]]
                if len(w) >= 4:
                    w = w[:-3] * np.uint64(3) + w[1:-2] * np.uint64(5) + w[2:-1] * np.uint64(7) + w[3:]
                for k, own in enumerate(keys):
                    own.append(int(mix(w ^ np.uint64(k + 1)).min()) - (1 << 63) if len(w) else 0)
        for k, own in enumerate(keys):
            table = table.append_column(f"k{k}", pa.array(own, pa.int64()))
        yield from table.to_batches()


def _words(counts: dict[str, list[int]], text: str) -> None:
    for word in {plain(t) for t in set(text.split())}:
        if len(word) <= LETTERS:
            if own := counts.get(word):
                own[0] += 1
            else:
                counts[word] = [1]


def _grams(counts: dict[str, list[int]], text: str, n: int = 1) -> None:
    for word in {plain(t) for t in set(text.split())}:
        if word.isalpha() and len(word) <= LETTERS:
            for g in grams_of(word):
                counts.setdefault(g, [0])[0] += n


def _features(groups: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The features (words and word beginnings) of groups of forms: those of group ``i`` are ``ids[at[i]:at[i + 1]]``, each once."""
    forms = pc.split_pattern(groups, _JOINT)
    owner = np.repeat(np.arange(len(groups)), pc.list_value_length(forms).to_numpy())
    words = forms.flatten()
    size = pc.utf8_length(words).to_numpy()
    found, owners = [words], [owner]
    for n in _PREFIXES:
        long = size >= n
        found.append(pc.binary_join_element_wise(pc.utf8_slice_codeunits(words.filter(pa.array(long)), 0, n), "*", ""))
        owners.append(owner[long])
    coded = pa.concat_arrays(found).dictionary_encode()
    n = max(len(coded.dictionary), 1)
    pairs = np.unique(np.concatenate(owners) * n + coded.indices.to_numpy())
    return coded.dictionary, pairs % n, np.searchsorted(pairs, np.arange(len(groups) + 1) * n)


def _feature_sums(batch: pa.RecordBatch) -> pa.Table:
    """Of each feature of rows (toxic, names, times): the clean and the toxic texts with it, and its occurrences in both."""
    names, y = batch.column("names"), np.array(batch.column("toxic").to_pylist(), bool)
    row = np.repeat(np.arange(len(batch)), pc.list_value_length(names).to_numpy())
    coded = names.flatten().dictionary_encode()
    code, times = coded.indices.to_numpy(), batch.column("times").flatten().to_numpy()
    key, ids, at = _features(coded.dictionary)
    n, many = len(key), np.diff(at)[code]
    ids = ids[np.repeat(at[code] - np.cumsum(many) + many, many) + np.arange(many.sum())]
    row, times = np.repeat(row, many), np.repeat(times, many)
    texts = np.unique(row * n + ids) if n else row
    sums = [np.bincount((own := texts[y[texts // max(n, 1)] == side]) % max(n, 1), minlength=n) for side in (False, True)]
    sums += [np.bincount(ids[own := y[row] == side], times[own], n).astype(np.int64) for side in (False, True)]
    return pa.table([key.cast(pa.string()), *map(pa.array, sums)], _FEATURE_SUMS)


_FEATURE_SUMS = ["key", "clean", "toxic", "t0", "t1"]
#: Groups of forms whose features are counted at once, about.
_GROUPS = 100_000


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of all rows (toxic, names, times) by feature, in parts: whole rows at a time, added up in each task before the shuffle."""

    def added(tables: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(tables).group_by("key").aggregate([(c, "sum") for c in _FEATURE_SUMS[1:]])
        return sums.select(["key", *(f"{c}_sum" for c in _FEATURE_SUMS[1:])]).rename_columns(_FEATURE_SUMS)

    held: list[pa.Table] = []
    for batch in batches:
        upto = np.cumsum(pc.list_value_length(batch.column("names")).to_numpy())
        first = 0
        while first < len(batch):
            last = max(int(np.searchsorted(upto, (upto[first - 1] if first else 0) + _GROUPS, "right")), first + 1)
            held.append(_feature_sums(batch.slice(first, last - first)))
            first = last
            if sum(map(len, held)) > 2 * _KEYS:
                held = [added(held)]
                if len(held[0]) > _KEYS:
                    yield from held.pop().to_batches()
    if held:
        yield from added(held).to_batches()


def train(docs: DataFrame, labels: DataFrame, *, support: int = 3, lift: float = 3.0) -> Scorer:
    """Learns from ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic).

    All labelled rows are used. Of copies and near copies, found by two min-hashes, one counts. Counts of
    letters and features, and the steps of the logistic fit, are aggregations over all rows; the driver gets
    the letter model, the features that are toxic often enough, and sums. These do not depend on the order of
    rows, so that reruns agree.
    """
    small_batches(docs.sparkSession)
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(small(one), "doc_id").select("text", "toxic", F.xxhash64("text").alias("h"))
    sketched = picked.mapInArrow(released(_sketched), "text string, toxic int, h long, k0 long, k1 long")
    rows = stored(sketched.withColumn("id", F.monotonically_increasing_id()), "toxicity-rows")
    kept = rows.drop("text")
    for key in ("k0", "k1"):
        kept = kept.groupBy(key).agg(F.max_by(F.struct("id", "h", "k0", "k1"), F.struct("toxic", "h", "id")).alias("x"), F.max("toxic").alias("toxic")).select("x.*", "toxic")
    texts = stored(rows.select("id", "text").join(kept.select("id", "toxic"), "id").select("text", "toxic"), "toxicity-texts")
    grams = {r.key: r.n for r in _counted(texts.select("text"), _words, ["n"], _grams).where("n >= 2").collect()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo, known = CharModel.of(grams) if grams else None, {}, {}
        for batch in batches:
            table, found = pa.Table.from_batches([batch]), []
            for text in table.column("text").to_pylist():
                found.append(forms(text, model, memo, known))
                for cache in (memo, known):
                    if len(cache) > 100_000:
                        cache.clear()
            arrays = [pa.array(y > 0 for y in table.column("toxic").to_pylist()), pa.array([n for n, _ in found], pa.int64())]
            arrays += [pa.array([list(c) for _, c in found], pa.list_(pa.string())), pa.array([list(c.values()) for _, c in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["toxic", "size", "names", "times"])

    decoded = stored(texts.mapInArrow(released(decode), "toxic boolean, size long, names array<string>, times array<long>"), "toxicity-decoded")
    sizes = {r.toxic: (r.n, r["size"]) for r in decoded.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    of_texts, of_words = zip(*(sizes.get(y, (0, 0)) for y in (False, True)), strict=True)
    if not all(of_texts):
        return Scorer({}, 0.0, (0.0, 0.0, 30.0 if of_texts[1] else -30.0), grams)
    parts = decoded.select("toxic", "names", "times").mapInArrow(released(_feature_counts), "key string, clean long, toxic long, t0 long, t1 long")
    sums = parts.groupBy("key").agg(*(F.sum(c).alias(c) for c in _FEATURE_SUMS[1:]))
    counts = stored(sums.where(F.col("toxic") >= support), "toxicity-features")
    tries = {r.toxic: r["count"] for r in counts.groupBy("toxic").count().collect()}
    able = counts.where(F.col("toxic") >= lift * of_texts[1] / sum(of_texts) * (F.col("clean") + F.col("toxic"))).collect()
    rules = rules_of({r.key: (r.clean, r.toxic, r.t0, r.t1) for r in able}, tries, of_texts, of_words, lift)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, known = Scorer(rules, 0.0, (0.0, 0.0, 0.0), {}).ready(), {}
        for batch in batches:
            strict, weak, few = [], [], []
            for groups, times in zip(batch.column("names").to_pylist(), batch.column("times").to_pylist(), strict=True):
                sums, n = [0.0, 0.0], 0
                for group, c in zip(groups, times, strict=True):
                    if group not in known:
                        known[group] = strongest([r for w in group.split(_JOINT) for r in probe.of_word(w)])
                    if r := known[group]:
                        sums[r[1]] += c * r[0]
                        n += 0 if r[1] else c
                strict.append(sums[1])
                weak.append(sums[0])
                few.append(n)
                if len(known) > 100_000:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("size"), pa.array(strict, pa.float64()), pa.array(weak, pa.float64()), pa.array(few, pa.int64())], ["toxic", "size", "strict", "weak", "few"])

    each = stored(decoded.mapInArrow(released(evidence), "toxic boolean, size long, strict double, weak double, few long"), "toxicity-evidence")
    used = each.where("toxic and few > 0").agg(F.sum("few").alias("few"), F.sum("size").alias("size")).first()
    rate = (used.few or 0) / max(used["size"] or 0, 1)
    over = F.col("weak") - rate * F.col("size")
    soft = F.when(over > 0, 30 * over / (30 + F.abs(over))).otherwise(10 * over / (10 + F.abs(over)))
    inputs = each.select(F.col("toxic").cast("double").alias("y"), (20 * F.col("strict") / (20 + F.col("strict"))).alias("x1"), F.when(F.col("weak") == 0, -5.0).otherwise(soft).alias("x2"))
    weights = _weights(stored(inputs.groupBy("y", "x1", "x2").agg(F.count("*").alias("n")), "toxicity-inputs"))
    return Scorer(rules, rate, weights, grams)


def add_scores(docs: DataFrame, scorer: Scorer, *, threshold: float = 0.7, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold) to each row."""
    small_batches(docs.sparkSession)
    kept = docs.drop(score, predicted)
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(scorer.rules, scorer.rate, scorer.weights, scorer.grams).ready()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            scores = [own.score(t) for t in table.column("text").to_pylist()]
            table = table.select(names).append_column(score, pa.array(scores, pa.float64()))
            yield from table.append_column(predicted, pa.array([int(s >= threshold) for s in scores], pa.int32())).to_batches()

    return kept.mapInArrow(released(run), schema)


def drop_toxic(docs: DataFrame, scorer: Scorer, *, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged, whatever their columns are named."""
    score, predicted = fresh(docs, "score"), fresh(docs, "predicted")
    return add_scores(docs, scorer, threshold=threshold, score=score, predicted=predicted).where(F.col(predicted) == 0).select(docs.columns)
