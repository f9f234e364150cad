"""Self-join of word n-gram sets at a Jaccard threshold, by PartEnum signatures.

A set's elements are 64-bit hashes of its n-word shingles. Sets of one size band share a
partition of the hash domain into ``n1`` parts of three cells. Two sets of the
band that are similar enough differ in at most ``k`` elements (their Hamming distance), so in
more than ``SPARE`` of the parts they differ in one element at most, and there two of the three
cells are equal. Each set has a signature for each part and each two of its cells;
similar sets share one. Sets near a band's upper edge also get the next band's signatures.

Signatures without elements would be shared by unrelated sets. As more than
``SPARE`` parts agree, a set with at most ``SPARE`` parts that have an empty pair of cells needs no
empty signature; the rare others emit all of theirs. Nothing is lost.

Candidates are checked exactly, in rounds. Of the sets that share a signature each is first
paired with the one that shares most with others; of these pairs each set checks its best
one. Groups of sets that share a signature and are not yet in one component then give pairs
across their components: a small group all of them, a large one a few for each two
components, so that its pairs do not grow with the square of its size. Each round checks the
nearest pairs of each two components, until none is left unchecked. Links inside a component may
stay unseen, but no component is ever split. Before a check, the sizes and a parity sketch of the sets bound the
overlap from above; pairs that they rule out need no check.

No group is gathered in one row or task: its members are dealt to cells of a bounded number by their hash in every
join on the group, and what is left of a large group is compared cell by cell: those outside of its
largest component with each other and with slices of that component.

Rows: null or empty texts have no shingles and are alone. Copies, and texts with equal sets,
share one node. Repeated rows and rows without a doc_id take part like others; a component's id
is its least doc_id, and null if it has none. Very long texts are hashed whole, in passes. An empty table
gives an empty result. Extra columns, whatever their names, do not matter to the join and pass through ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkwright.llm.components import components
from chunkwright.llm.textops import fresh, hashed_words, mix, released, relieved, small_batches, stored, tidy, utf8

#: Ratio of a band's edges, and spare parts.
BAND, SPARE = 1.35, 2
#: Groups of so many sets at most give all their pairs; larger ones a few for each component.
SMALL, NEAREST = 32, 32
#: Members of a group in one cell, nodes in one row, and signatures in one range, each about.
CELL, ROW_NODES, RANGE_SIGNATURES = 4096, 4096, 4_000_000
#: Pairs that are few enough to broadcast (16 bytes each).
_BROADCAST_PAIRS = 250_000
_C = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than ``n`` words make one shingle."""
    for _, _, h, at in hashed_words(texts):
        if len(h) >= n:
            wide = h[: len(h) - n + 1] * _C[0]
            for k in range(1, n):
                wide = wide + h[k : len(h) - n + 1 + k] * _C[k % len(_C)] * np.uint64(2 * (k // len(_C)) + 1)
            wide = mix(wide)
        for i in range(len(at) - 1):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= n:
                yield np.unique(wide[a : b - n + 1])
            elif b > a:
                own = sum(x * int(_C[k % len(_C)]) * (2 * k + 1) for k, x in enumerate(h[a:b].tolist())) + b - a
                yield mix(np.array([own % (1 << 64)], np.uint64))
            else:
                yield np.empty(0, np.uint64)


def node_of(items: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    name = int(np.bitwise_xor.reduce(mix(items ^ _C[5]))) + int(np.sum(mix(items ^ _C[6]))) + len(items)
    return int(mix(np.array([name % (1 << 64)], np.uint64)).view(np.int64)[0])


def sketch_of(items: np.ndarray) -> bytes:
    """Parities of the numbers of elements by cell, a bit each, with one to two cells an element.

    Sketches of two sets differ in at most as many cells as the sets differ in elements. Cells
    go by low hash bits, so a sketch folds to half its size by XOR of its halves.
    """
    cells = max(64, 1 << (len(items) - 1).bit_length())
    counts = np.bincount((items & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch (as 64-bit words) folded to a number of words."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), 0)


class Bands:
    """Size bands and their partitions for ``share`` percent similarity."""

    def __init__(self, share: int) -> None:
        self.share = share
        self.edges = [1]
        self.cells: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, size: int) -> int:
        while self.edges[-1] <= size:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND)))
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def distance(self, a: int, b: int) -> int:
        """The largest Hamming distance of sets of these sizes that are similar enough."""
        return ((100 - self.share) * (a + b)) // (100 + self.share)

    def wanted(self, size: int) -> list[int]:
        """The bands whose signatures a set of this size has."""
        own = self.of(size)
        largest = size * 100 // self.share
        return list(range(own, self.of(largest) + 1))

    def parts(self, band: int) -> int:
        """Parts of the band's partition; ``wanted`` has made the band's upper edge."""
        top = self.edges[band + 1] - 1
        return self.distance(top, top) // 2 + 1 + SPARE

    def signatures(self, items: np.ndarray) -> np.ndarray:
        """64-bit signatures of a set of sorted element hashes."""
        found = []
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(items ^ _C[4]))))
        for band in self.wanted(len(items)):
            n1 = self.parts(band)
            if band not in self.cells:
                name = [i * int(_C[5]) + (band + 1) * int(_C[6]) for i in range(3 * n1)]
                self.cells[band] = np.array([(i << 64) // (3 * n1) for i in range(3 * n1)], np.uint64), np.array([x % (1 << 64) for x in name], np.uint64)
            cells, name = self.cells[band]
            at = np.append(np.searchsorted(items, cells), len(items))
            sums, sizes = (total[at[1:]] - total[at[:-1]]).reshape(n1, 3), np.diff(at).reshape(n1, 3)
            pair = np.stack((sums[:, 0] * _C[0] + sums[:, 1], sums[:, 0] * _C[1] + sums[:, 2], sums[:, 1] * _C[2] + sums[:, 2] * _C[3]), 1)
            empty = np.stack((sizes[:, 0] + sizes[:, 1], sizes[:, 0] + sizes[:, 2], sizes[:, 1] + sizes[:, 2]), 1) == 0
            own = mix(pair.reshape(-1) + name)
            found.append(own if empty.any(1).sum() > SPARE else own[~empty.reshape(-1)])
        return np.concatenate(found) if found else np.empty(0, np.uint64)


def _described(n: int):
    """Each row's set: doc_id, the row's key, size, node and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes, nodes, sketches = [], [], []
            for items in shingle_sets(utf8(table.column("text")), n):
                sizes.append(len(items))
                nodes.append(node_of(items) if len(items) else None)
                sketches.append(sketch_of(items) if len(items) else None)
            table = table.select(["doc_id", "key"]).append_column("size", pa.array(sizes, pa.int64()))
            yield from table.append_column("node", pa.array(nodes, pa.int64())).append_column("sketch", pa.array(sketches, pa.binary())).to_batches()

    return run


def _signed(n: int, share: int, parts: int):
    """Signatures, packed by hash range: (part, sigs, nodes). A task sends each set once."""

    def flush(sigs: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        s, v = np.concatenate(sigs), np.concatenate(nodes)
        part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        order = np.argsort(part.astype(np.uint32), kind="stable")
        s, v, part = s[order], v[order], part[order]
        at = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        full = [p for p in range(parts) if at[p + 1] > at[p]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array([s[at[p] : at[p + 1]].astype(np.uint32).tobytes() for p in full], pa.binary()), pa.array([v[at[p] : at[p + 1]].tobytes() for p in full], pa.binary())],
            ["part", "sigs", "nodes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, sigs, nodes, held, seen = Bands(share), [], [], 0, set()
        for batch in batches:
            for items in shingle_sets(utf8(pa.Table.from_batches([batch]).column("text")), n):
                if len(items) and (node := node_of(items)) not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(node)
                    own = bands.signatures(items)
                    sigs.append(own)
                    nodes.append(np.full(len(own), node, np.int64))
                    held += len(own)
            if held > 1_000_000:
                yield from flush(sigs, nodes)
                sigs, nodes, held = [], [], 0
        if held:
            yield from flush(sigs, nodes)

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ranges of signatures, one after another: the distinct groups of sets that share one, with how often.

    A group (g, n, times) comes in rows of at most ``ROW_NODES`` of its ``n`` nodes.
    """
    now, sigs, nodes = None, [], []
    for batch in batches:
        for part, s, v in zip(batch.column("part").to_pylist(), batch.column("sigs"), batch.column("nodes"), strict=True):
            if part != now and sigs:
                yield from _range_groups(sigs, nodes)
                sigs, nodes = [], []
            now = part
            sigs.append(np.frombuffer(s.as_buffer(), np.uint32).copy())
            nodes.append(np.frombuffer(v.as_buffer(), np.int64).copy())
    if sigs:
        yield from _range_groups(sigs, nodes)


def _range_groups(sigs: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    s, v = np.concatenate(sigs), np.concatenate(nodes)
    order = np.argsort(s, kind="stable")
    s, v = s[order], v[order]
    same = s[1:] == s[:-1]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    groups: dict[bytes, int] = {}
    for a, b in zip(edge[::2].tolist(), (edge[1::2] + 1).tolist(), strict=True):
        own = np.unique(v[a:b])
        if len(own) > 1:
            key = own.tobytes()
            groups[key] = groups.get(key, 0) + 1
    rows: list[tuple[int, int, int, np.ndarray]] = []
    held = 0
    for key, times in groups.items():
        own = np.frombuffer(key, np.int64)
        g = int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True)
        for k in range(0, len(own), ROW_NODES):
            rows.append((g, len(own), times, own[k : k + ROW_NODES]))
            held += len(rows[-1][3])
        if held > 50_000:
            yield _group_rows(rows)
            rows, held = [], 0
    if rows:
        yield _group_rows(rows)


def _group_rows(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[3]) for r in rows)]), pa.int32()), pa.array(np.concatenate([r[3] for r in rows])))
    return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), lists], ["g", "n", "times", "nodes"])


def near(apart, size_a, size_b, share: int):
    """False where the sizes, or that sketches differ in ``apart`` cells, rule out the similarity."""
    return (100 * np.minimum(size_a, size_b) >= share * np.maximum(size_a, size_b)) & ((100 + share) * apart <= (100 - share) * (size_a + size_b))


def _sketch_filter(share: int, names: list[str]):
    """Keeps pairs that the sketches allow; adds in how many cells they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, far = [], []
            columns = [batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "size_a", "size_b")]
            for x, y, p, q in zip(*columns, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                n = min(len(x), len(y))
                far.append(int(np.bitwise_count(folded(x, n) ^ folded(y, n)).sum()))
                keep.append(bool(near(far[-1], p, q, share)))
            table = pa.Table.from_batches([batch]).select(names).append_column("apart", pa.array(far, pa.int64()))
            yield from table.filter(pa.array(keep, pa.bool_())).to_batches()

    return run


def _sets(n: int):
    """(node, items) of texts; items are the packed element hashes. Texts of another set than the named one are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, nodes, items = pa.Table.from_batches([batch]), [], []
            for want, own in zip(table.column("node").to_pylist(), shingle_sets(utf8(table.column("text")), n), strict=True):
                if len(own) and ((node := node_of(own)) == want or want is None):
                    nodes.append(node)
                    items.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(items, pa.binary())], ["node", "items"])

    return run


def _checked(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("items_a").to_pylist(), batch.column("items_b").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= share * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "similar"])

    return run


def _across(share: int, joining: bool):
    """Of one cell of a group: pairs of sets of two components that the sketches allow and that are not checked yet.

    Members with ``side`` 1 are a slice of the group's largest component and are met by the others
    only; without any, the others meet each other. ``joining``: components with such a pair then
    count as one, so of n components at most ``NEAREST`` * (n - 1) pairs come out. Otherwise each set
    gives its nearest, up to ``NEAREST``. The first of a pair is the one outside the largest component.
    """

    def pairs_of(node: np.ndarray, root: np.ndarray, side: np.ndarray, size: np.ndarray, sketches: list[bytes], failed: list[list[int] | None]) -> Iterator[tuple[int, int]]:
        words = min(map(len, sketches)) // 8
        bits = np.stack([folded(np.frombuffer(x, np.uint64), words) for x in sketches])
        mixed, place = bool(side.any()), {x: i for i, x in enumerate(node.tolist())}
        known: dict[int, set[int]] = {}
        for i, own in enumerate(failed):
            for j in (place[x] for x in own or () if x in place):
                known.setdefault(i, set()).add(j)
                known.setdefault(j, set()).add(i)
        for i in np.flatnonzero(side == 0).tolist():
            others = side == 1 if mixed else np.arange(len(node)) > i
            # The components that i may join: of each the sets that are nearest to i. Then they count as one.
            while len(rest := np.flatnonzero(others & (root != root[i]))):
                rest = rest[100 * np.minimum(size[rest], size[i]) >= share * np.maximum(size[rest], size[i])]
                apart = np.bitwise_count(bits[rest] ^ bits[i]).sum(1, dtype=np.int64)
                fine = near(apart, size[rest], size[i], share)
                if i in known:
                    fine &= ~np.isin(rest, list(known[i]))
                rest, apart = rest[fine], apart[fine]
                if not len(rest):
                    break
                rest = rest[np.argsort(apart, kind="stable")]
                if not joining:
                    yield from ((int(node[i]), int(node[j])) for j in rest[:NEAREST].tolist())
                    break
                for r in np.unique(root[rest]):
                    for j in rest[root[rest] == r][:NEAREST].tolist():
                        yield int(node[i]), int(node[j])
                    root[root == r] = root[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, int, int], None] = {}
            for g, x, y, node, root, own in _groups(batch):
                _, root = np.unique(root, return_inverse=True)
                column = {c: own.field(c)[x:y] for c in ("side", "size", "sketch", "failed")}
                for pair in pairs_of(node, root, column["side"].to_numpy(), column["size"].to_numpy(), column["sketch"].to_pylist(), column["failed"].to_pylist()):
                    out[(g, *pair)] = None
            rows = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["g", "own", "other"])

    return run


def _groups(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(group, first, last, nodes, roots, members) of each group, or cell of a group, of the batch."""
    lists = batch.column("members")
    at, flat = np.asarray(lists.offsets).tolist(), lists.values
    node, root = flat.field("node").to_numpy(), flat.field("root").to_numpy()
    for k, g in enumerate(batch.column("g").to_pylist()):
        x, y = at[k], at[k + 1]
        if y - x > 1:
            yield g, x, y, node[x:y], root[x:y], flat


def _all_pairs(share: int):
    """Of small groups: the pairs of sets of two components whose sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = [np.empty((0, 2), np.int64)]
            for _, x, y, node, root, own in _groups(batch):
                size = own.field("size").to_numpy()[x:y]
                i, j = np.triu_indices(len(node), 1)
                apart = (root[i] != root[j]) & near(0, size[i], size[j], share)
                i, j = node[i[apart]], node[j[apart]]
                found.append(np.stack((np.minimum(i, j), np.maximum(i, j)), 1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return run


def _cells(n) -> F.Column:
    """Cells of a group of ``n`` members."""
    return F.ceil(n / CELL).cast("int")


def _cell(node: str, cells) -> F.Column:
    return F.pmod(F.xxhash64(node), cells.cast("long")).cast("int")


def _every_cell(groups: DataFrame) -> DataFrame:
    """Rows of groups (g, n, ..), one for each cell, to meet members dealt out by ``_cell``."""
    return groups.withColumn("cell", F.explode(F.sequence(F.lit(0), _cells(F.col("n")) - 1))).drop("n")


def _clusters(docs: DataFrame, n: int, share: int) -> tuple[DataFrame, DataFrame]:
    """Each row's set (doc_id, key, size, node, sketch), and the root of each node in a component of several."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    keyed = docs.select("doc_id", "text", _key().alias("key"))
    rows = stored(keyed.mapInArrow(released(_described(n)), "doc_id long, key long, size long, node long, sketch binary"), "jaccard-rows")
    # About as many signatures as there are, for ranges that one task holds with ease.
    signatures = rows.agg(F.coalesce(F.sum(3 * BAND * (100 - share) / (100 + share) * F.col("size") + 9), F.lit(0.0)).alias("n")).first().n
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(1.5 * signatures) // RANGE_SIGNATURES + 1, 8)
    # One row stands for all with the same set; its doc_id finds its text again.
    distinct = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    packed = docs.mapInArrow(released(_signed(n, share, parts)), "part int, sigs binary, nodes binary")
    groups = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(released(_buckets), "g long, n long, times long, nodes array<long>")
    groups = stored(groups.groupBy("g", "n", "nodes").agg(F.sum("times").alias("times")), "jaccard-groups")
    tidy(spark)
    relieved(spark)
    member = groups.select("g", "n", "times", F.explode("nodes").alias("node"))
    # Of a group, the set that shares most with others stands in the middle.
    needed = member.groupBy("node").agg(F.sum(F.col("times") * (F.col("n") - 1)).alias("shared"))
    needed = stored(needed.join(distinct, "node"), "jaccard-nodes")
    nameless = not needed.where("doc_id is null").isEmpty()
    facts = needed.select("node", "size", "sketch")
    ranked = member.join(needed.select("node", "shared"), "node")
    middle = ranked.groupBy("g", "n").agg(F.max_by("node", F.struct("shared", "node")).alias("a"))
    ranked = ranked.withColumn("cell", _cell("node", _cells(F.col("n")))).select("g", "cell", "node", "times")
    stars = ranked.join(_every_cell(middle), ["g", "cell"]).where("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.sum("times").alias("times"))

    def allowed(pairs: DataFrame) -> DataFrame:
        names = pairs.columns
        fields = ", ".join(f"{c} long" for c in [*names, "apart"])
        for x in "ab":
            pairs = pairs.join(facts.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")), x)
        return pairs.mapInArrow(_sketch_filter(share, names), fields)

    def paired(pairs: DataFrame) -> DataFrame:
        """Pairs (own, other) as (a, b, own), each once; a failed one is later remembered at ``own``."""
        return pairs.groupBy(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(F.min("own").alias("own"))

    # Each set has one pair with a middle and remembers it, so that no middle remembers many.
    best = allowed(stars).groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a"))
    best = stored(paired(best.select(F.col("b").alias("own"), F.col("a").alias("other"))), "jaccard-stars")

    def sets_of(nodes: DataFrame, few: bool) -> DataFrame:
        """(node, items) of some nodes, from the text of one document each."""
        wanted = needed.join(nodes, "node").select("doc_id", "node")
        named = wanted.where("doc_id is not null")
        sets = docs.join(F.broadcast(named) if few else named, "doc_id").select("node", "text").mapInArrow(_sets(n), "node long, items binary")
        if nameless:
            rest = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("node"), "text").mapInArrow(_sets(n), "node long, items binary")
            sets = sets.union(rest.join(wanted.where("doc_id is null").select("node"), "node", "left_semi"))
        return stored(sets.dropDuplicates(["node"]), "jaccard-sets")

    def check(pairs: DataFrame) -> DataFrame:
        few = pairs.count() <= _BROADCAST_PAIRS
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), few)
        own = pairs
        if few:
            pairs = F.broadcast(pairs)
        pairs = pairs.select("a", "b")
        for x in "ab":
            pairs = pairs.join(sets.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}")), x)
        done = pairs.mapInArrow(_checked(share), "a long, b long, similar boolean")
        done = stored(done.join(own, ["a", "b"]).select("a", "b", "own", "similar"), "jaccard-pairs")
        tidy(spark)
        relieved(spark)
        return done

    def place(open_: DataFrame, roots: DataFrame) -> DataFrame:
        """Members, with their roots, of groups that are not in one component; their group's size too."""
        placed = open_.select("g", "n", F.explode("nodes").alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = placed.withColumn("cell", _cell("node", _cells(F.col("n"))))
        torn = placed.groupBy("g", "n").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("g", "n")
        return placed.join(_every_cell(torn), ["g", "cell"]).join(facts.select("node", "size"), "node")

    def dealt(members: DataFrame) -> DataFrame:
        """Members of large groups in cells (g, i, j, members): those outside the largest component, slice by slice, with each other and with its slices.

        A group that fits one cell is one, and none of its members is copied.
        """
        whole = members.where(F.col("n") <= CELL).select("g", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "root", F.lit(0).alias("side"), "size", "sketch", "failed")
        members = members.where(F.col("n") > CELL)
        count = members.groupBy("g", "n", "root").agg(F.count("*").alias("c"))
        main = count.groupBy("g", "n").agg(F.max(F.struct("c", "root")).alias("m")).select("g", "n", F.col("m.root").alias("main"), _cells(F.col("m.c")).alias("mains"), _cells(F.col("n") - F.col("m.c")).alias("rests"))
        rows = members.drop("n").join(_every_cell(main), ["g", "cell"])
        rows = rows.withColumn("side", (F.col("root") == F.col("main")).cast("int"))
        own = _cell("node", F.when(F.col("side") == 1, F.col("mains")).otherwise(F.col("rests")))
        rows = rows.withColumn("own", own)
        others = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
        mains = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: F.struct(F.col("own").alias("i"), (-1 - j).alias("j")))
        as_main = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda i: F.struct(i.alias("i"), (-1 - F.col("own")).alias("j")))
        rows = rows.withColumn("at", F.explode(F.when(F.col("side") == 1, as_main).otherwise(F.concat(others, mains))))
        rows = rows.select("g", "at.i", "at.j", "node", "root", "side", "size", "sketch", "failed").union(whole)
        return rows.groupBy("g", "i", "j").agg(F.collect_list(F.struct("node", "root", "side", "size", "sketch", "failed")).alias("members"))

    def rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left").withColumn(f"root_{x}", F.coalesce(f"root_{x}", x))
        return pairs.where("root_a <> root_b")

    checked, large, listed = check(best), None, None
    while True:
        links = checked.where("similar").select(F.col("a").alias("u"), F.col("b").alias("v"))
        roots = stored(components(links), "jaccard-roots")
        first = listed is None
        if first:
            open_ = place(groups, roots)
            few = open_.where(F.col("n") <= SMALL).groupBy("g").agg(F.collect_list(F.struct("node", "root", "size")).alias("members"))
            listed = stored(allowed(few.mapInArrow(released(_all_pairs(share)), "a long, b long").distinct()), "jaccard-listed")
            tidy(spark)
            relieved(spark)
            open_ = open_.where(F.col("n") > SMALL)
        else:
            open_ = place(groups.join(large, "g", "left_semi"), roots)
        # Of listed pairs each two components check their nearest; large groups give theirs anew.
        left = rooted(listed.join(checked, ["a", "b"], "left_anti"), roots)
        place_of = F.row_number().over(W.partitionBy(F.least("root_a", "root_b"), F.greatest("root_a", "root_b")).orderBy("apart", "a", "b"))
        picked = left.withColumn("n", place_of).where(F.col("n") <= NEAREST).select(F.col("a").alias("own"), F.col("b").alias("other"))
        wrong = checked.where("not similar").select(F.col("own").alias("node"), F.when(F.col("own") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"))
        wrong = wrong.groupBy("node").agg(F.collect_list("other").alias("failed"))
        members = open_.join(facts.drop("size").join(wrong, "node", "left"), "node")
        found = stored(dealt(members).mapInArrow(released(_across(share, first)), "g long, own long, other long"), "jaccard-open")
        large = found.select("g").distinct()
        pairs = stored(paired(picked.union(found.select("own", "other"))), "jaccard-next")
        if pairs.isEmpty():
            return rows, roots
        checked = checked.union(check(pairs))


def _key():
    """Names a row by its doc_id and text."""
    return F.xxhash64("doc_id", "text")


def join_sets(docs: DataFrame, *, n: int = 4, share: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Two rows link when 100 * |intersection| >= share * |union| of their n-word shingle sets.
    """
    rows, roots = _clusters(docs, n, share)
    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("own_id"))
    placed = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = placed.groupBy("root").agg(F.min("own_id").alias("component_id"))
    named = placed.join(ids, "root").select("node", "component_id")
    # A node may have many rows: adaptive execution splits such a key of the left side.
    out = rows.join(named, "node", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, n: int = 4, share: int = 85) -> DataFrame:
    """``docs`` with one row of each component: one with the least doc_id (rows without one come last).

    Rows without words are alone and stay. Rows with the same doc_id and text become one.
    """
    rows, roots = _clusters(docs, n, share)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key"))
    least = rows.where("node is not null").groupBy("node").agg(first.alias("x")).join(roots, "node", "left")
    best = least.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("x").alias("x")).select(F.col("x.key").alias("k"))
    alone = rows.where("node is null").select(F.col("key").alias("k")).distinct()
    key = fresh(docs, "key")
    kept = docs.withColumn(key, _key()).join(best.union(alone).withColumnRenamed("k", key), key, "left_semi")
    return kept.dropDuplicates([key]).select(docs.columns)
