"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds
turn its value into probabilities of reaching each grade. Features: hashed words,
pairs of neighbouring byte classes (which see capitals, symbol noise and tables), and words
that repeat a near one, all as means over the text, so that its length does not count.

Rows: null and empty texts have no features and get the thresholds' own probabilities.
Repeated rows each get the same result. Rows of labels without a grade are left out; with
fewer than two grades every text is expected to have the one grade (0 if there is none).
An empty table gives an empty result. Extra columns pass through; ``ADDED`` names
replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwright.llm.textops import fresh, hashed_words, released, small, small_batches, stored, trim, utf8

BITS = 16
#: Pairs of byte classes, then shares of words that repeat the word one, two and three places before.
_PAIRS = 256 + 3
ADDED = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probabilities", T.ArrayType(T.DoubleType()))])


def _classes() -> np.ndarray:
    """Byte classes: letters, capitals, digits, parts of UTF-8 letters, spaces, single symbols."""
    out = np.full(256, 15, np.uint8)
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[0x80:] = 3
    for k, group in enumerate((" ", "\n\r", "\t\v\f", ".", ",;:", "!?", "#$%&*@^~", "|", "<>/\\", "'\"`", "()[]{}"), 4):
        out[[ord(c) for c in group]] = k
    return out


_CLASS = _classes()


def shape_of(text: bytes, words: np.ndarray) -> np.ndarray:
    """Shares of the pairs of neighbouring byte classes, and of words that repeat a near one."""
    out = np.zeros(_PAIRS)
    c = _CLASS[np.frombuffer(text, np.uint8)].astype(np.int64)
    if len(c) > 1:
        out[:256] = np.bincount(c[:-1] * 16 + c[1:], minlength=256) / (len(c) - 1)
    for k in range(1, min(4, len(words))):
        out[255 + k] = np.mean(words[k:] == words[:-k])
    return out


class Model:
    def __init__(self, grades: list[int], words: np.ndarray, pairs: np.ndarray, thresholds: np.ndarray) -> None:
        self.grades, self.words, self.pairs, self.thresholds = grades, words, pairs, thresholds

    def values(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, _, h, at in hashed_words(texts):
            total = np.concatenate(([0.0], np.cumsum(self.words[(h >> np.uint64(64 - BITS)).astype(np.int64)])))
            n = np.diff(at)
            out[first : first + len(n)] = np.diff(total[at]) / np.maximum(n, 1)
            for i in range(len(n)):
                out[first + i] += shape_of(texts[first + i], h[at[i] : at[i + 1]]) @ self.pairs
        return out

    def tails(self, values: np.ndarray) -> np.ndarray:
        """P(grade >= each grade but the least), one row for each text."""
        return 1 / (1 + np.exp(-np.clip(values[:, None] - self.thresholds[None, :], -30, 30)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch])
        texts, keys, times, pairs = utf8(table.column("text")), [], [], []
        for first, _, h, at in hashed_words(texts):
            own = (h >> np.uint64(64 - BITS)).astype(np.int64)
            for i in range(len(at) - 1):
                k, n = np.unique(own[at[i] : at[i + 1]], return_counts=True)
                keys.append(k)
                times.append(n / max(int(at[i + 1] - at[i]), 1))
                pairs.append(shape_of(texts[first + i], h[at[i] : at[i + 1]]))
        cols = [table.column("k").combine_chunks(), table.column("grade").combine_chunks(), *(pa.array(x, pa.list_(kind)) for x, kind in ((keys, pa.int32()), (times, pa.float64()), (pairs, pa.float64())))]
        yield pa.RecordBatch.from_arrays(cols, ["k", "grade", "keys", "times", "pairs"])


def train(docs: DataFrame, labels: DataFrame, grade: str, *, max_rows: int = 6000, rounds: int = 120, decay: float = 1e-3) -> Model:
    """Fits ``docs`` (doc_id, text) with ``labels`` (doc_id, ``grade``), on all labelled rows.

    Rows are dealt by a hash of their text to shards of about ``max_rows``, each shard is fitted in one task,
    and the parameters are averaged, weighted by rows. Parameters are summed as whole numbers of
    ``_STEP``, and a shard's rows are sorted before its fit, so that reruns agree. The driver gets a
    bounded number of sums, whatever the number of rows. Of equal doc_ids in the labels, and of equal texts, the
    highest grade counts.
    """
    small_batches(docs.sparkSession)
    one = labels.where(F.col("doc_id").isNotNull() & F.col(grade).isNotNull()).groupBy("doc_id").agg(F.max(grade).cast("int").alias("grade"))
    picked = docs.select("doc_id", "text").join(small(one), "doc_id").groupBy("text").agg(F.max("grade").alias("grade"))
    rows = stored(picked.withColumn("k", F.xxhash64("text")), "quality-rows")
    sizes = rows.groupBy("grade").count().collect()
    grades, n = sorted(r.grade for r in sizes), sum(r["count"] for r in sizes)
    if len(grades) < 2:
        return Model(grades or [0], np.zeros(1 << BITS), np.zeros(_PAIRS), np.zeros(0))

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("k", "ascending"), ("grade", "ascending")])
        keys, times, pairs = (table.column(c).combine_chunks() for c in ("keys", "times", "pairs"))
        y = np.searchsorted(grades, table.column("grade").to_numpy())
        params = fit(y, len(grades), np.asarray(keys.flatten()), np.asarray(times.flatten()), np.diff(np.asarray(keys.offsets)), np.asarray(pairs.flatten()).reshape(-1, _PAIRS), rounds, decay)
        del table, keys, times, pairs
        trim()
        return _sums([np.rint(np.concatenate(params) / _STEP).astype(np.int64) * len(y)])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sums(x for batch in batches if batch.num_rows for x in np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)).to_batches()

    features = rows.mapInArrow(released(_features), "k long, grade int, keys array<int>, times array<double>, pairs array<double>")
    dealt = features.withColumn("shard", F.pmod("k", F.lit(-(-n // max_rows)))).groupBy("shard")
    sums = stored(dealt.applyInArrow(shard, "sums array<long>"), "quality-shards").coalesce(_PARTIALS).mapInArrow(released(added), "sums array<long>").collect()
    total = np.sum([np.array(r.sums, np.int64) for r in sums if r.sums], axis=0) * (_STEP / n)
    words, pairs, edges = np.split(total, [1 << BITS, (1 << BITS) + _PAIRS])
    return Model(grades, words, pairs, edges)


#: Parameters are summed in whole multiples of this (a sum over 2**32 rows of values up to 2**10 fits), in so many parts at most.
_STEP, _PARTIALS = 2.0**-20, 8


def _sums(arrays) -> pa.Table:
    """One row with the sum of whole-number arrays; no row without any."""
    total = None
    for x in arrays:
        total = x.copy() if total is None else total + x
    return pa.table({"sums": pa.array([] if total is None else [total], pa.list_(pa.int64()))})


#: Scales of the two kinds of features, by which one learning rate suits both.
_SCALE = (6.0, 30.0)


def thresholds_of(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free parameters: the first, then logs of the steps."""
    return np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))


def loss_and_slopes(params: list[np.ndarray], y: np.ndarray, k: int, row: np.ndarray, keys: np.ndarray, times: np.ndarray, pairs: np.ndarray, decay: float) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the grades with its penalty, and its slopes by the parameters."""
    words, wide, free = params
    n = len(y)
    value = np.bincount(row, words[keys] * times * _SCALE[0], n) + pairs @ wide * _SCALE[1]
    edges = np.concatenate(([-np.inf], thresholds_of(free), [np.inf]))
    with np.errstate(over="ignore"):
        upper, lower = (1 / (1 + np.exp(-(edges[y + s] - value))) for s in (1, 0))
    p = np.maximum(upper - lower, 1e-9)
    d_up, d_low = upper * (1 - upper) / p / n, lower * (1 - lower) / p / n
    slope = d_up - d_low  # of the loss by the value
    by_edge = (np.bincount(y, d_low, k + 1) - np.bincount(y + 1, d_up, k + 1))[1:k]
    tail = np.cumsum(by_edge[::-1])[::-1]
    slopes = [
        np.bincount(keys, slope[row] * times * _SCALE[0], len(words)) + decay * words,
        pairs.T @ slope * _SCALE[1] + decay * wide,
        np.concatenate((tail[:1], tail[1:] * np.exp(free[1:]))),
    ]
    return float(-np.log(p).mean() + decay / 2 * ((words**2).sum() + (wide**2).sum())), slopes


def fit(y: np.ndarray, k: int, keys: np.ndarray, times: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, rounds: int, decay: float) -> list[np.ndarray]:
    """Weights of words and pairs, and thresholds of ``k`` grades: maximum likelihood with a quadratic penalty, by Adam on all of a shard's rows at once."""
    row = np.repeat(np.arange(len(y)), sizes)
    counts = np.array([(y >= j).mean() for j in range(1, k)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(counts / (1 - counts))
    params = [np.zeros(1 << BITS), np.zeros(_PAIRS), np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-3))))]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for t in range(1, rounds + 1):
        _, slopes = loss_and_slopes(params, y, k, row, keys, times, pairs, decay)
        for q, g, (m, v) in zip(params, slopes, moment, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return [params[0] * _SCALE[0], params[1] * _SCALE[1], thresholds_of(params[2])]


def add_grades(docs: DataFrame, model: Model, *, names: tuple[str, str] = ("expected_grade", "tail_probabilities")) -> DataFrame:
    """Adds the expected grade and, for each grade but the least, the chance to reach it."""
    small_batches(docs.sparkSession)
    kept = docs.drop(*names)
    own = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.diff(model.grades).astype(float)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            tails = model.tails(model.values(utf8(table.column("text"))))
            table = table.select(own).append_column(names[0], pa.array(model.grades[0] + tails @ steps, pa.float64()))
            yield from table.append_column(names[1], pa.array(list(tails), pa.list_(pa.float64()))).to_batches()

    added = [T.StructField(name, field.dataType) for name, field in zip(names, ADDED.fields, strict=True)]
    return kept.mapInArrow(released(run), T.StructType([*kept.schema.fields, *added]))


def drop_low(docs: DataFrame, model: Model, *, chance: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged, whatever their columns are named."""
    names = fresh(docs, "expected_grade"), fresh(docs, "tail_probabilities")
    return add_grades(docs, model, names=names).where(passes(chance, names[1])).select(docs.columns)


def passes(chance: float = 0.5, tails: str = "tail_probabilities"):
    """True where the highest grade is reached with at least this chance (with one grade: always)."""
    return F.coalesce(F.try_element_at(tails, F.lit(-1)) >= chance, F.lit(True))
