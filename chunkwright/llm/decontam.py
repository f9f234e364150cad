"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every word sequence that occurs in some test items. Training
tokens stream through it; at each token it knows the longest suffix of the stream
that occurs in some item. Where that is as long as a window (13 item words, or a
whole shorter item), the window's words are hit.

Test items come in blocks of bounded size. In one pass over the documents the hashes of all their
windows are looked up among the block's; a text that shares one streams through the automaton of the
items that it shares windows with. Equal windows have equal hashes, so no hit is lost, and the
automaton is exact, so none is made up. No block makes a shuffle.

Rows: null or empty texts have no words and are never contaminated. Repeated rows
each get their own result. Very long texts are read whole. Other columns pass through untouched;
``find_hits`` adds its results under ``names`` and replaces columns of these names, while
``decontaminate`` and ``remove_spans`` return just the columns of their input, whatever their names.
An empty benchmark hits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwright.llm.textops import ASCII_LOWER, fresh, hashed_words, mix, released, small_batches, stored, utf8

#: Everything below 0x80 but letters and digits separates words.
_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in ASCII_LOWER)

#: Blocks that one step holds.
_STEPS = 2
#: Most slots of a block's first filter (a byte each), and automata that a task keeps.
_SLOTS, _KEPT = 1 << 24, 512

ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z lower-cased."""
    return text.translate(_WORDS).split()


class Automaton:
    """Generalised suffix automaton over the words of test items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[str]] = [set()]
        self.shortest = window
        self.shorts: dict[int, dict[int, set[str]]] = {}
        last_of: list[tuple[str, list[int]]] = []
        for item, tokens in items:
            if tokens:
                coded = [self.ids.setdefault(w, len(self.ids)) for w in tokens]
                last_of.append((item, coded))
                self._add(coded)
        self._own = [set() for _ in self.length]
        for item, coded in last_of:
            self._mark(item, coded)

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.length)
        self.length.append(self.length[p] + 1)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _add(self, coded: list[int]) -> None:
        last = 0
        for c in coded:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
                continue
            new = len(self.length)
            self.length.append(self.length[last] + 1)
            self.next.append({})
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
            last = new

    def _mark(self, item: str, coded: list[int]) -> None:
        """Notes for the state of each window which items have it."""
        if len(coded) < self.window:
            self.shortest = min(self.shortest, len(coded))
            state = 0
            for c in coded:
                state = self.next[state][c]
            self.shorts.setdefault(state, {}).setdefault(len(coded), set()).add(item)
            return
        state, size = 0, 0
        for c in coded:
            state, size = self.step(state, size, c)
            at = self._at(state, self.window) if size >= self.window else -1
            if at >= 0:
                self._own[at].add(item)

    def _at(self, state: int, size: int) -> int:
        """The state of the suffix of ``size`` words of the match that ended in ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """The longest suffix of the stream that occurs in an item, after word ``c``."""
        while c not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            size = self.length[state]
        return self.next[state][c], size + 1

    def scan(self, tokens: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit spans [start, end) of word positions, merged, and the items that occur."""
        spans: list[list[int]] = []
        found: set[str] = set()
        if len(tokens) < self.shortest or not self.ids:
            return spans, found
        get = self.ids.get
        codes = np.fromiter([get(w, -1) for w in tokens], np.int64, len(tokens))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        for i in np.flatnonzero(ends - starts >= self.shortest):
            state = size = 0
            for at, c in enumerate(codes[starts[i] : ends[i]].tolist(), int(starts[i]) + 1):
                state, size = self.step(state, size, c)
                best = 0
                if size >= self.window:
                    best = self.window
                    found |= self._own[self._at(state, self.window)]
                if self.shorts and size >= self.shortest:
                    best = max(best, self._short(state, size, found))
                if best:
                    if spans and spans[-1][1] >= at - best:
                        spans[-1][1] = at
                        while len(spans) > 1 and spans[-2][1] >= at - best:
                            spans[-2][1] = spans.pop()[1]
                        spans[-1][0] = min(spans[-1][0], at - best)
                    else:
                        spans.append([at - best, at])
        return spans, found

    def _short(self, state: int, size: int, found: set[str]) -> int:
        """The longest whole short item that ends here; all that do are added to ``found``."""
        best = 0
        while state > 0:
            for n, items in self.shorts.get(state, {}).items():
                if n <= size:
                    found |= items
                    best = max(best, n)
            state = self.link[state]
            size = min(size, self.length[state]) if state >= 0 else 0
        return best


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


class Block:
    """Some test items: hashes of their windows by length, and automata of those that a text needs."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.items, self.window = items, window
        by_length: dict[int, tuple[list, list]] = {}
        for first, _, h, at in hashed_words([raw for _, raw in items], _WORDS):
            for i in range(len(at) - 1):
                if n := min(window, int(at[i + 1] - at[i])):
                    own = window_hashes(h[at[i] : at[i + 1]], n)
                    hashes, names = by_length.setdefault(n, ([], []))
                    hashes.append(own)
                    names.append(np.full(len(own), first + i, np.int32))
        self.known = {}
        for n, (hashes, names) in by_length.items():
            h, k = np.concatenate(hashes), np.concatenate(names)
            order = np.argsort(h, kind="stable")
            bits = min(max(16 * len(h), 1 << 12), _SLOTS).bit_length()
            seen = np.zeros(1 << bits, bool)
            seen[h >> np.uint64(64 - bits)] = True
            self.known[n] = (h[order], k[order], seen, np.uint64(64 - bits))
        self.automata: dict[frozenset[int], Automaton] = {}

    def candidates(self, h: np.ndarray, at: np.ndarray) -> dict[int, set[int]]:
        """Of texts with word hashes ``h`` from offsets ``at``: the items with which each shares a window."""
        out: dict[int, set[int]] = {}
        for n, (known, names, seen, shift) in self.known.items():
            own = window_hashes(h, n)
            spots = np.flatnonzero(seen[own >> shift])
            a, b = (np.searchsorted(known, own[spots], side) for side in ("left", "right"))
            text = np.searchsorted(at, spots, "right") - 1
            fine = (b > a) & (spots + n <= at[text + 1])
            for i, x, y in zip(text[fine].tolist(), a[fine].tolist(), b[fine].tolist(), strict=True):
                out.setdefault(i, set()).update(names[x:y].tolist())
        return out

    def automaton(self, wanted: set[int]) -> Automaton:
        key = frozenset(wanted)
        if key not in self.automata:
            if len(self.automata) >= _KEPT:
                self.automata.clear()
            self.automata[key] = Automaton([(self.items[k][0], words(self.items[k][1])) for k in sorted(key)], self.window)
        return self.automata[key]

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, list[list[int]], set[str]]]:
        """Words, hit spans and items that occur, of each text."""
        for first, _, h, at in hashed_words(texts, _WORDS):
            found = self.candidates(h, at)
            for i, n in enumerate(np.diff(at).tolist()):
                yield n, *(self.automaton(found[i]).scan(words(texts[first + i])) if i in found else ([], set()))


def _blocks(benchmark: DataFrame, max_block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Test items in blocks of a bounded size; the first may be empty."""
    block: list[tuple[str, bytes]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text")).where("text is not null")
    for item, text in rows.toLocalIterator():
        raw = text.encode()
        if block and size + len(raw) > max_block_bytes:
            yield block
            block, size = [], 0
        block.append((item, raw))
        size += len(raw)
    yield block


def _merge(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(a + b):
        if out and out[-1][1] >= s:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, max_block_bytes: int = 8 << 20, names: list[str] | None = None) -> DataFrame:
    """Adds ``ADDED`` to each row of ``docs`` (column ``text``), under ``names``.

    Test items are read in blocks of at most ``max_block_bytes`` (one longer item makes a
    block of its own); a few blocks are shipped with one narrow step over the documents, and
    between such steps the rows are written and read again. So what a task
    holds does not grow with the benchmark. ``item_ids`` are the sorted ids, as strings, of items with an
    occurring window.
    """
    return _scanned(docs, benchmark, window, max_block_bytes, names or ADDED.names)


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, max_block_bytes: int, names: list[str], finish=None) -> DataFrame:
    """``find_hits``; ``finish`` turns each table with its hits into rows of ``docs``, in the step of the last blocks."""
    small_batches(docs.sparkSession)
    out = docs.drop(*names)
    added = [T.StructField(name, f.dataType) for name, f in zip(names, ADDED.fields, strict=True)]
    schema = T.StructType([*out.schema.fields, *added])
    blocks = _blocks(benchmark, max_block_bytes)
    step, first = list(islice(blocks, _STEPS)), True
    while step:
        after = list(islice(blocks, 1))
        last = finish if not after else None
        out = out.mapInArrow(released(_scanner(step, window, names, first, last)), docs.schema if last else schema)
        if after:
            out = stored(out, "decontam")
        step, first = after + list(islice(blocks, _STEPS - 1 if after else 0)), False
    return out


def _scanner(step: list[list[tuple[str, bytes]]], window: int, names: list[str], first: bool, finish=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Block(items, window) for items in step]
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts = utf8(table.column("text"))
            before = [(r[names[2]], {*r[names[3]]}) for r in table.select(names[2:]).to_pylist()] if not first else [([], set())] * len(texts)
            for block in blocks:
                counts, found = [], []
                for (old, had), (n, span, own) in zip(before, block.scan(texts), strict=True):
                    counts.append(n)
                    found.append((_merge(span, old) if old else span, own | had))
                before = found
            hits = [sum(e - s for s, e in span) for span, _ in before]
            table = table.select([c for c in table.column_names if c not in names])
            columns = (counts, hits, [span for span, _ in before], [sorted(ids) for _, ids in before])
            for name, values, kind in zip(names, columns, (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())), strict=True):
                table = table.append_column(name, pa.array(values, kind))
            yield from (finish(table) if finish else table).to_batches()

    return run


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words", coverage: float = 0.05):
    """True where hit words make at least ``coverage`` of all words."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) >= F.lit(coverage) * F.col(n_words) - 1e-9)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, coverage: float = 0.05) -> DataFrame:
    """Drops the contaminated rows of ``docs``; the others come out unchanged."""
    names = [fresh(docs, n) for n in ADDED.names]
    hits = find_hits(docs, benchmark, window=window, names=names)
    return hits.where(~is_contaminated(names[1], names[0], coverage)).select(docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, coverage: float = 0.05, max_block_bytes: int = 8 << 20) -> DataFrame:
    """Drops contaminated rows and cuts the hit spans, separators included, from the texts of the others.

    The step that finds the last spans cuts them too, so that a task needs one Python worker and no text is copied twice.
    """
    names, columns = [fresh(docs, n) for n in ADDED.names], docs.columns

    def finish(table: pa.Table) -> pa.Table:
        n, hit = (table.column(c).to_pylist() for c in names[:2])
        table = table.filter(pa.array([not (h > 0 and h >= coverage * k - 1e-9) for k, h in zip(n, hit, strict=True)], pa.bool_()))
        spans = table.column(names[2]).to_pylist()
        if any(spans):
            texts = [cut(t, s) if s else t for t, s in zip(table.column("text").to_pylist(), spans, strict=True)]
            at = table.column_names.index("text")
            table = table.set_column(at, "text", pa.array(texts, table.schema.field("text").type))
        return table.select(columns)

    return _scanned(docs, benchmark, window, max_block_bytes, names, finish)


def cut(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans and the separators that follow each of them."""
    raw = text.encode()
    flags = np.frombuffer(raw.translate(_WORDS), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8)))) == 1)
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : edge[s]])
        at = int(edge[e]) if e < len(edge) else len(raw)
    return (b"".join(out) + raw[at:]).decode()
