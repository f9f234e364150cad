"""Elias-Fano sequences and a three-level n-gram trie over them, laid out as one mapped image."""

from __future__ import annotations

import mmap
import os

import numpy as np

_ONE = np.uint64(1)
_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Of each byte the places of its set bits, in order.
_PLACES = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _set = [k for k in range(8) if _byte >> k & 1]
    _PLACES[_byte, : len(_set)] = _set


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits, one after another, least bit first, as bytes of whole 64-bit words; one word more at the end."""
    if not width or not len(values):
        return np.zeros(16, np.uint8)
    out = []
    step = 1 << 16  # a multiple of 8 values ends on a byte
    for k in range(0, len(values), step):
        bits = (values[k : k + step, None] >> np.arange(width, dtype=np.uint64)) & _ONE
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate([*out, np.zeros(8 + -sum(map(len, out)) % 8, np.uint8)])


def _in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit of each word: byte sums by one multiplication, then a table."""
    s = words - ((words >> _ONE) & np.uint64(0x5555555555555555))
    s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
    s = ((s + (s >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES
    k = k.astype(np.uint64)
    place = np.bitwise_count(((k * _BYTES | _TOPS) - s) & _TOPS).astype(np.uint64) << np.uint64(3)
    rest = k - (((s << np.uint64(8)) >> place) & np.uint64(255))
    return place.astype(np.int64) + _PLACES[(words >> place) & np.uint64(255), rest]


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary; ``width`` is below 57.

    The unary bits stay packed. Selection goes by the rank before each word, then within the word.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.width, self.low, self.words = n, width, low.view(np.uint64), high.view(np.uint64)
        kind = np.uint32 if len(high) < 1 << 28 else np.int64
        self.ones = np.zeros(len(self.words), kind)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.ones[1:])
        self.zeros = (np.arange(len(self.words)) * 64 - self.ones).astype(kind)
        self.last = int(self.at(np.array([n - 1]))[0]) >> width if n else -1

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        width = min(max(0, (int(values[-1]) // n).bit_length() - 1), 56) if n else 0
        high = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        # A zero and a whole word at least follow the last one.
        bits = np.zeros(-(-(int(high[-1]) + 130 if n else 1) // 64) * 64, np.uint8)
        bits[high] = 1
        return n, width, _pack(values & np.uint64((1 << width) - 1), width), np.packbits(bits, bitorder="little")

    def _one(self, k: np.ndarray) -> np.ndarray:
        """Places of the k-th set bits, from 0."""
        word = np.searchsorted(self.ones, k.astype(self.ones.dtype), "right") - 1
        return word * 64 + _in_word(self.words[word], k - self.ones[word])

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Places of the k-th unset bits, from 0."""
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), "right") - 1
        return word * 64 + _in_word(~self.words[word], k - self.zeros[word])

    def _after(self, at: np.ndarray) -> np.ndarray:
        """64 bits from each place on."""
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        return (self.words[word] >> shift) | ((self.words[np.minimum(word + 1, len(self.words) - 1)] << _ONE) << (np.uint64(63) - shift))

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        return ((self.low[word] >> shift) | ((self.low[word + 1] << _ONE) << (np.uint64(63) - shift))) & np.uint64((1 << self.width) - 1)

    def at(self, k: np.ndarray) -> np.ndarray:
        return ((self._one(k) - k).astype(np.uint64) << np.uint64(self.width)) | self._lows(k)

    def both(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k-th element and the one after it."""
        first = self._one(k)
        ahead = self._after(first + 1)
        second = first + 1 + np.bitwise_count((ahead & (~ahead + _ONE)) - _ONE).astype(np.int64)
        if len(far := np.flatnonzero(ahead == 0)):
            second[far] = self._one(k[far] + 1)
        return tuple(((place - j).astype(np.uint64) << np.uint64(self.width)) | self._lows(j) for place, j in ((first, k), (second, k + 1)))

    def _range(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) element whose high part is ``high``: the ones after a zero."""
        at = np.where(high > 0, self._zero(np.maximum(high - 1, 0)), -1) + 1
        ends = ~self._after(at)
        size = np.bitwise_count((ends & (~ends + _ONE)) - _ONE).astype(np.int64)
        if len(long := np.flatnonzero(ends == 0)):
            size[long] = self._zero(high[long]) - at[long]
        return at - high, at - high + size

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each value the place of the first element that is not less (``n`` if there is none), and whether it is equal."""
        if not self.n or not len(values):
            return np.full(len(values), self.n), np.zeros(len(values), bool)
        high, low = (values >> np.uint64(self.width)).astype(np.int64), values & np.uint64((1 << self.width) - 1)
        inside = high <= self.last
        a, b = self._range(np.where(inside, high, 0))
        a, b = np.where(inside, a, self.n), np.where(inside, b, self.n)
        top = b.copy()
        while len(open_ := np.flatnonzero(a < b)):
            mid = (a[open_] + b[open_]) >> 1
            less = self._lows(mid) < low[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
        equal = np.flatnonzero(a < top)
        same = np.zeros(len(values), bool)
        same[equal] = self._lows(a[equal]) == low[equal]
        return a, same

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value; -1 where it is not there."""
        at, same = self.successor(values)
        return np.where(same, at, -1)


#: Codes stand for 10 ** (-code / _FINE), probabilities rounded down to that; the least is code ``LEAST``.
_FINE, LEAST, ABSENT = 32, 254, 65_535


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.ceil(-np.log10(p) * _FINE - 1e-9), 0, LEAST).astype(np.uint8)


def value_of(codes: np.ndarray) -> np.ndarray:
    """The probabilities that codes, or sums of codes, stand for; 0 for ``ABSENT``."""
    return np.where(codes == ABSENT, 0.0, 10.0 ** (-codes.astype(float) / _FINE))


class Trie:
    """Trigrams (u, v, w) below their middle word: contexts v, their successors w, and below these the words u before.

    Each level is an Elias-Fano sequence of rank * 2**32 + word, where the rank is the parent's
    place in the level above, so that the sequence is monotone and a search is relative to the context. Monotone
    pointers lead from each parent to its first child. ``pairs`` are the (v, u). Quantised
    to a byte each are kept: the smoothed probability of w after v without its unigram part, that of w
    after u v likewise, and the back-off weights of v and of u v.

    A trigram's probability is (c(uvw) + m3 p2(w | v)) / (c(uv) + m3), with p2(w | v) =
    (c(vw) + m2 p1(w)) / (c(v) + m2): a probability without p1, and a weight of p1, come out of a query.
    """

    LEVELS = ("contexts", "pointers", "successors", "below", "trigrams", "pairs")
    CODES = ("back_v", "p_vw", "p_uvw", "back_uv")

    def __init__(self, header: dict, buffer) -> None:
        raw = np.frombuffer(buffer, np.uint8)

        def part(name: str) -> np.ndarray:
            a, n = header["parts"][name]
            return raw[a : a + n]

        self.contexts, self.pointers, self.successors, self.below, self.trigrams, self.pairs = (EliasFano(*header[k], part(k + "_low"), part(k + "_high")) for k in self.LEVELS)
        self.back_v, self.p_vw, self.p_uvw, self.back_uv = map(part, self.CODES)

    @classmethod
    def of(cls, contexts: np.ndarray, successors: np.ndarray, before: np.ndarray, counts: np.ndarray, masses: tuple[float, float]) -> Trie:
        """From (v, w, u) in order, each once, with counts over 0; the image is written into a mapped memory file."""
        m2, m3 = masses
        names, rank = np.unique(contexts, return_inverse=True)
        key = (rank.astype(np.uint64) << np.uint64(32)) | successors
        new = np.diff(key, prepend=key[:1] + _ONE) != 0 if len(key) else np.empty(0, bool)
        first = np.flatnonzero(new)
        parent = np.cumsum(new) - 1
        level = key[first]
        up = rank[first]
        pairs, pair = np.unique((rank.astype(np.uint64) << np.uint64(32)) | before, return_inverse=True)
        c_v, c_uv = np.bincount(rank, counts, len(names)), np.bincount(pair, counts, len(pairs))
        c_vw = np.add.reduceat(counts, first).astype(float) if len(first) else np.empty(0)
        p2 = c_vw / (c_v[up] + m2)
        p3 = (counts + m3 * p2[parent]) / (c_uv[pair] + m3)
        levels = {
            "contexts": names,
            "pointers": np.searchsorted(up, np.arange(len(names) + 1)),
            "successors": level,
            "below": np.append(first, len(key)),
            "trigrams": (parent.astype(np.uint64) << np.uint64(32)) | before,
            "pairs": pairs,
        }
        codes = {"back_v": quantised(m2 / (c_v + m2)), "p_vw": quantised(p2), "p_uvw": quantised(p3), "back_uv": quantised(m3 / (c_uv + m3))}
        header: dict = {"parts": {}}
        blocks: list[np.ndarray] = []
        size = 0

        def add(name: str, block: np.ndarray) -> None:
            nonlocal size
            header["parts"][name] = (size, len(block))
            blocks.append(np.pad(block, (0, -len(block) % 8)))
            size += len(blocks[-1])

        for name, values in levels.items():
            n, width, low, high = EliasFano.encode(values)
            header[name] = (n, width)
            add(name + "_low", low)
            add(name + "_high", high)
        for name, block in codes.items():
            add(name, block)
        return cls(header, _mapped(blocks, size))

    def query(self, contexts: np.ndarray, ctx_sizes: np.ndarray, successors: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the probability without its unigram part, and of the weight of that part, of trigrams in order.

        ``ctx_sizes`` are the numbers of successors of each context, ``sizes`` those of the words before each successor.
        """
        v = np.repeat(self.contexts.find(contexts), ctx_sizes)
        vw = self._child(self.successors, self.pointers, v, successors)
        v3, vw3 = np.repeat(v, sizes), np.repeat(vw, sizes)
        uv = self._child(self.pairs, None, v3, before)
        uvw = self._child(self.trigrams, self.below, vw3, before)
        back_uv = np.where(uv >= 0, _taken(self.back_uv, uv), 0)
        backed = np.where(vw3 >= 0, _taken(self.p_vw, vw3) + back_uv, ABSENT)
        p = np.where(uvw >= 0, _taken(self.p_uvw, uvw), backed)
        rest = np.minimum(back_uv + np.where(v3 >= 0, _taken(self.back_v, v3), 0), 255)
        return p.astype(np.uint16), rest.astype(np.uint8)

    def _child(self, level: EliasFano, pointers: EliasFano | None, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of words below their parents; -1 where there is none, or no parent."""
        out = np.full(len(parent), -1)
        seen = np.flatnonzero(parent >= 0)
        if len(seen):
            rank = parent[seen]
            out[seen] = level.find((rank.astype(np.uint64) << np.uint64(32)) | word[seen])
            if pointers is not None:
                # Within the parent's own children: pointers are read once for each run of a parent.
                edge = np.flatnonzero(np.diff(rank, prepend=-1))
                run = np.diff(np.append(edge, len(rank)))
                low, top = (np.repeat(x.astype(np.int64), run) for x in pointers.both(rank[edge]))
                found = out[seen]
                out[seen] = np.where((found >= low) & (found < top), found, -1)
        return out


def _taken(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return codes[np.maximum(at, 0)].astype(np.int64) if len(codes) else np.zeros(len(at), np.int64)


def _mapped(blocks: list[np.ndarray], size: int) -> mmap.mmap:
    """The blocks in a mapped memory file (an anonymous map where there are none)."""
    fd = os.memfd_create("trie") if hasattr(os, "memfd_create") else -1
    try:
        if fd >= 0:
            os.ftruncate(fd, max(size, 1))
        out = mmap.mmap(fd, max(size, 1))
    finally:
        if fd >= 0:
            os.close(fd)
    for block in blocks:
        out.write(block.tobytes())
    return out
