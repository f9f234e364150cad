"""Language-model scoring with a distributed Elias-Fano n-gram trie.

A trigram model with Dirichlet smoothing at each order: p3(w | u v) = (c(u v w) + m3 p2(w | v)) / (c(u v) + m3),
p2(w | v) = (c(v w) + m2 p1(w)) / (c(v) + m2), and p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) gives an
unknown word the share of one type. The model is too large for one machine, so it is dealt into shards
by the trigrams' middle word, which is all the context that smoothing needs: a shard has every count of v, v w, u v and
u v w of its words v. A word that is too frequent for one shard is split by the word before it, and
each split keeps its own lower order; so no shard grows with a frequent word, and probabilities still sum to one.

Documents go in chunks of bounded bytes. A chunk sends each shard its distinct words and trigrams
with their training counts, packed in a few arrays. The shard sums the counts, builds its trie of
quantised smoothed probabilities and back-off weights in mapped memory, and answers each chunk's trigrams by successor
search. Each chunk then meets its answers and is scored. Words are named by 64-bit hashes, and within
a context by 32 bits of them.

Rows: null and empty texts are one end token. Repeated rows count and are scored one by one. Rows
without a doc_id are learnt from and not held out. Very long texts are a chunk of their own. Without
training rows every token is unknown. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.eliasfano import Trie, value_of
from chunkwright.llm.textops import hashed_words, mix, released, small_batches, stored, tidy, utf8

START, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
_C, _D = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407)
#: Bytes of a chunk's texts, tokens of a shard, and smoothing masses of the second and the third order.
CHUNK_BYTES, SHARD_TOKENS, MASSES = 8 << 20, 2_000_000, (500.0, 5.0)
#: What a chunk sends; None stands for numbers that are mostly small.
_KINDS = {"words": np.uint64, "word_counts": None, "contexts": np.uint64, "ctx_sizes": None, "successors": np.uint32, "sizes": None, "before": np.uint32, "counts": None}
#: A task passes over words that it has seen less often; a word to be split has some hundred thousand times as many.
_RARE = 4
_PACKED = "part int, chunk string, " + ", ".join(f"{name} binary" for name in _KINDS)
_ANSWER = "part int, chunk string, word_counts binary, p binary, rest binary, tokens long, types long"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _sent(values: np.ndarray, kind) -> bytes:
    """Bytes of an array; of small numbers a byte each, 255 for larger ones, which follow."""
    if kind:
        return values.tobytes()
    large = values[values >= 255]
    return len(values).to_bytes(4, "little") + np.minimum(values, 255).astype(np.uint8).tobytes() + large.astype(np.uint32).tobytes()


def _got(raw: bytes, kind) -> np.ndarray:
    if kind:
        return np.frombuffer(raw, kind)
    n = int.from_bytes(raw[:4], "little")
    out = np.frombuffer(raw, np.uint8, n, 4).astype(np.uint32)
    out[out == 255] = np.frombuffer(raw[4 + n :], np.uint32)
    return out


class Splits:
    """Which words v are split, in how many ways; and the shards."""

    def __init__(self, words: dict[int, int], shards: int) -> None:
        self.names = np.array(sorted(words), np.uint64)
        self.ways = np.array([words[w] for w in sorted(words)], np.uint64)
        self.shards = shards

    def context(self, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The name under which a shard has v before, if it is split, words like u."""
        if not len(self.names):
            return mix(v)
        at = np.minimum(np.searchsorted(self.names, v), len(self.names) - 1)
        ways = np.where(self.names[at] == v, self.ways[at], np.uint64(1))
        return mix(v + (mix(u ^ _D) % ways) * _C)

    def shard(self, name: np.ndarray) -> np.ndarray:
        return ((name >> np.uint64(32)) * np.uint64(self.shards)) >> np.uint64(32)


class Chunk:
    """Distinct words and trigrams of some texts, in the order in which shards hold them."""

    def __init__(self, texts: list[bytes], train: np.ndarray, splits: Splits) -> None:
        self.splits = splits
        tokens, middle, sizes = [], [], []
        for _, _, h, at in hashed_words(texts):
            tokens.append(np.insert(h, at[1:], END))
            middle.append(np.insert(h, at[:-1], START))
            sizes.append(np.diff(at) + 1)
        self.sizes = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        t, v = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (tokens, middle))
        del tokens, middle
        mask = np.repeat(train, self.sizes)
        self.starts = np.cumsum(np.append(0, self.sizes))[:-1]
        self.words, self.word_of = np.unique(t, return_inverse=True)
        self.word_counts = np.bincount(self.word_of, mask, len(self.words)).astype(np.uint32)
        u = np.roll(v, 1)
        u[self.starts] = START
        name, pair = splits.context(v, u), (t & np.uint64(0xFFFFFFFF00000000)) | (u >> np.uint64(32))
        del t, u, v
        order = np.lexsort((pair, name))
        name, pair = name[order], pair[order]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (pair[1:] != pair[:-1])
        self.gram_of = np.empty(len(name), np.int64)
        self.gram_of[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.counts = np.add.reduceat(mask[order].astype(np.uint32), first).astype(np.uint32) if len(first) else np.empty(0, np.uint32)
        self.name, self.pair = name[first], pair[first]

    def packed(self, chunk: str) -> pa.RecordBatch:
        """What each shard gets of this chunk."""
        new_v = np.ones(len(self.name), bool)
        new_v[1:] = self.name[1:] != self.name[:-1]
        w = (self.pair >> np.uint64(32)).astype(np.uint32)
        new_vw = new_v.copy()
        new_vw[1:] |= w[1:] != w[:-1]
        at_v, at_vw = np.flatnonzero(new_v), np.flatnonzero(new_vw)
        rank = np.cumsum(new_vw) - 1  # of each trigram's v w
        values = {
            "words": self.words,
            "word_counts": self.word_counts,
            "contexts": self.name[at_v],
            "ctx_sizes": np.diff(np.append(rank[at_v], len(at_vw))).astype(np.uint32),
            "successors": w[at_vw],
            "sizes": np.diff(np.append(at_vw, len(w))).astype(np.uint32),
            "before": (self.pair & np.uint64(0xFFFFFFFF)).astype(np.uint32),
            "counts": self.counts,
        }
        every = np.arange(self.splits.shards + 1, dtype=np.uint64)
        shard = self.splits.shard(self.name)
        by_word, by_v = np.searchsorted(self.splits.shard(self.words), every), np.searchsorted(shard[at_v], every)
        by_vw, by_gram = np.searchsorted(shard[at_vw], every), np.searchsorted(shard, every)
        cuts = (by_word, by_word, by_v, by_v, by_vw, by_vw, by_gram, by_gram)
        full = np.flatnonzero((np.diff(by_word) > 0) | (np.diff(by_gram) > 0)).tolist()
        columns = [pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.string())]
        columns += [pa.array([_sent(values[name][at[p] : at[p + 1]], kind) for p in full], pa.binary()) for (name, kind), at in zip(_KINDS.items(), cuts, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["part", "chunk", *values])


def _chunked(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[str, pa.Table]]:
    """(chunk, rows) with rows of one place, in order, by running size; the same rows make the same chunks in each pass."""
    now, k, size = None, 0, 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        names = []
        for place, n in zip(table.column("place").to_pylist(), pc.binary_length(table.column("text")).to_pylist(), strict=True):
            if place != now:
                now, k, size = place, 0, 0
            elif size + (n or 0) > chunk_bytes:
                k, size = k + 1, 0
            size += (n or 0) + 1
            names.append(f"{place}|{k}")
        edge = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
        for a, b in zip(edge, [*edge[1:], len(names)], strict=True):
            yield names[a], table.slice(a, b - a)


def _packer(splits: Splits, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, train = None, [], []
        for name, rows in _chunked(batches, chunk_bytes):
            if name != now and texts:
                yield Chunk(texts, np.array(train, bool), splits).packed(now)
                texts, train = [], []
            now = name
            texts += utf8(rows.column("text"))
            train += rows.column("train").to_pylist()
        if texts:
            yield Chunk(texts, np.array(train, bool), splits).packed(now)

    return run


def _named(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _chunked(batches, chunk_bytes):
            yield from rows.select(["doc_id", "text", "train"]).append_column("chunk", pa.array([name] * len(rows), pa.string())).to_batches()

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that a task has seen often, with how often, and (null) all that it has seen, ends included."""
    names, counts, total = np.empty(0, np.uint64), np.empty(0, np.int64), 0
    held: list[np.ndarray] = []

    def merge() -> None:
        nonlocal names, counts
        n, c = np.unique(np.concatenate(held), return_counts=True)
        names, at = np.unique(np.concatenate((names, n)), return_inverse=True)
        counts = np.bincount(at, np.concatenate((counts, c)), len(names)).astype(np.int64)
        held.clear()

    for batch in batches:
        for _, _, h, at in hashed_words(utf8(batch.column(0))):
            held.append(h)
            total += len(h) + len(at) - 1
            if sum(map(len, held)) > 1_000_000:
                merge()
    if held:
        merge()
    often = counts >= _RARE
    words = pa.concat_arrays([pa.array([None], pa.int64()), pa.array(names[often].view(np.int64))])
    table = pa.table([words, pa.array(np.append(total, counts[often]))], ["word", "n"])
    yield from table.to_batches(max_chunksize=100_000)


def _splits(rows: DataFrame, shard_tokens: int) -> Splits:
    """Shards by a count of all tokens; words with more than a quarter of a shard's share are split."""
    counted = rows.select("text").mapInArrow(released(_word_counts), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stored(counted, "lm-words")
    total = counted.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    shards = max(-(-total // shard_tokens), 8)
    share = max(total / (4 * shards), 1)
    # Fewer than 4 * shards words can have more than that share.
    found = counted.where(F.col("word").isNotNull() & (F.col("n") > share)).collect()
    return Splits({r.word % (1 << 64): int(-(-r.n // share)) for r in found}, shards)


def _answers(masses: tuple[float, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Builds each shard, in turn, from all that chunks have sent to it and answers each of them."""
        now, rows = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                part, chunk = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if part != now and rows:
                    yield from _shard(now, rows, masses)
                    rows = []
                now = part
                rows.append((chunk, *(_got(batch.column(2 + i)[k].as_py(), kind) for i, kind in enumerate(_KINDS.values()))))
        if rows:
            yield from _shard(now, rows, masses)

    return run


def _shard(part: int, rows: list[tuple], masses: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    words, at = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    totals = np.bincount(at, np.concatenate([r[2] for r in rows]), len(words)).astype(np.uint32)
    word_ends = np.cumsum([0, *(len(r[1]) for r in rows)])
    name, pair, count = [], [], []
    for _, _, _, contexts, ctx_sizes, successors, sizes, before, counts in rows:
        learnt = np.flatnonzero(counts)
        name.append(np.repeat(np.repeat(contexts, ctx_sizes), sizes)[learnt])
        pair.append(((np.repeat(successors, sizes).astype(np.uint64) << np.uint64(32)) | before)[learnt])
        count.append(counts[learnt])
    name, pair, count = np.concatenate(name), np.concatenate(pair), np.concatenate(count).astype(np.int64)
    order = np.lexsort((pair, name))
    name, pair, count = name[order], pair[order], count[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (pair[1:] != pair[:-1])
    first = np.flatnonzero(new)
    count = np.add.reduceat(count, first) if len(first) else count
    name, pair = name[first], pair[first]
    trie = Trie.of(name, pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF), count, masses)
    del name, pair, count, order, new
    fields = [f.split() for f in _ANSWER.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    for k, (chunk, _, _, contexts, ctx_sizes, successors, sizes, before, _) in enumerate(rows):
        p, rest = trie.query(contexts, ctx_sizes, successors, sizes, before)
        values = [part, chunk, totals[at[word_ends[k] : word_ends[k + 1]]].tobytes(), p.tobytes(), rest.tobytes(), int(totals.sum()) if not k else 0, int((totals > 0).sum()) if not k else 0]
        yield pa.RecordBatch.from_arrays([pa.array([v], kinds[kind]) for v, (_, kind) in zip(values, fields, strict=True)], [f for f, _ in fields])


def _scorer(splits: Splits, tokens: int, types: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        empty = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not docs.num_rows:
            return empty.empty_table()
        train = docs.column("train").to_numpy().astype(bool)
        chunk = Chunk(utf8(docs.column("text")), train, splits)
        parts = np.argsort(answers.column("part").to_numpy())

        def whole(name: str, kind) -> np.ndarray:
            blocks = answers.column(name).to_pylist()
            return np.frombuffer(b"".join(blocks[p] for p in parts), kind)

        counts, p, rest = whole("word_counts", np.uint32).astype(float), whole("p", np.uint16), whole("rest", np.uint8)
        if len(counts) != len(chunk.words) or len(p) != len(chunk.name) or len(rest) != len(chunk.name):
            raise RuntimeError(f"the answers do not fit chunk {key}: the input has changed between two reads")
        share = (counts + 0.5) / (tokens + 0.5 * (types + 1))
        base = np.add.reduceat(np.log10(share)[chunk.word_of], chunk.starts)
        known = np.add.reduceat((counts > 0)[chunk.word_of].astype(np.int64), chunk.starts)
        chance = value_of(p)[chunk.gram_of] + value_of(rest)[chunk.gram_of] * share[chunk.word_of]
        score = np.add.reduceat(np.log10(np.minimum(chance, 1.0)), chunk.starts)
        return pa.table([docs.column("doc_id"), pa.array(~train), pa.array(chunk.sizes, pa.int64()), pa.array(known), pa.array(base), pa.array(score)], empty.names)

    return run


def score(docs: DataFrame, learn: Column, *, masses: tuple[float, float] = MASSES, chunk_bytes: int = CHUNK_BYTES, shard_tokens: int = SHARD_TOKENS, from_files: bool = False) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text) with the model learnt from rows where ``learn`` holds.

    All passes must see the same chunks. With ``from_files``, ``docs`` is read straight from
    Parquet files, and a chunk is a run of rows of one file split; otherwise the rows are first
    written to the shared folder.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if not from_files:
        docs = stored(docs.select("doc_id", "text", learn.alias("_learn")), "lm-rows")
        learn = F.col("_learn")
    place = F.concat_ws("|", "_metadata.file_path", "_metadata.file_block_start")
    rows = docs.select("doc_id", "text", F.coalesce(learn, F.lit(True)).alias("train"), place.alias("place"))
    splits = _splits(rows, shard_tokens)
    packed = rows.select("place", "text", "train").mapInArrow(released(_packer(splits, chunk_bytes)), _PACKED)
    answers = stored(packed.repartition(splits.shards, "part").sortWithinPartitions("part").mapInArrow(released(_answers(masses)), _ANSWER), "lm-answers")
    tidy(spark)
    total = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    run = _scorer(splits, total.tokens, total["types"])
    named = rows.mapInArrow(released(_named(chunk_bytes)), "doc_id long, text string, train boolean, chunk string")
    scored = named.groupBy("chunk").cogroup(answers.select("chunk", "part", "word_counts", "p", "rest").groupBy("chunk")).applyInArrow(run, _SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total.tokens).cast("long").alias("train_tokens"), "base_score", "score")
