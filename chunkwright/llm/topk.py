"""Exact top-k search by inner product with M-trees.

Vectors are dealt into shards of bounded size. In each, vectors get one more component so that the
largest inner products become the least Euclidean distances, and one M-tree is bulk-loaded. Its
routing objects are vectors of the shard; each entry keeps a covering radius and its distance to the
parent's routing object, and leaves are pages of neighbouring rows. The queries stream past the tree in
batches. A query first goes down to its nearest page, which gives it a limit; then entries whose
stored distance and radius put them beyond the limit are ruled out by the triangle inequality
without computing their distance, and the pages that are left are read best-first: in each
turn every query of the batch reads its next best pages (one, then two, four and so on), until the next
one is beyond its k-th best. Within a page
stored distances rule out rows. Shards' best are merged by rank. Scores are exact integers.

Rows: vectors that are null, or hold null or non-finite components, and rows without an id take no
part. Shorter vectors count as padded with zeros. Ties go to the smaller id. A query's own id is
no candidate for it. Repeated rows are candidates of their own (of equal ones ``k`` can matter, and
more are not dealt out); of several rows with a query's id the least vector asks. Scores beyond 64 bits
are cut to the limits. No queries or no candidates: an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkwright.llm.textops import released, small_batches

LEAF, FAN = 256, 16
#: Bytes of a shard's vectors, and fewest vectors of a shard that is made for the sake of more tasks.
SHARD_BYTES, SHARD_ROWS = 32 << 20, 4096
SCHEMA = "query_id long, vec_id long, score long"
_NONE = -(1 << 62)


def _away(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` to those of ``b``."""
    square = (a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)
    return np.sqrt(np.maximum(square, 0))


class MTree:
    """A bulk-loaded M-tree over the rows of ``x`` (float64).

    A node has a routing object (a row of ``x``), a covering radius, and either children with their
    distances to it, or a page: rows ``order[first:last]`` with theirs.
    """

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.routing: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.page: list[tuple[int, int] | None] = []
        self.away: list[np.ndarray] = []
        self.order = np.empty(0, np.int64)
        if len(x):
            self._build()
        self.reach = np.array(self.radius)

    def _node(self, routing: int) -> int:
        self.routing.append(routing)
        self.radius.append(0.0)
        self.children.append(None)
        self.page.append(None)
        self.away.append(np.empty(0))
        return len(self.routing) - 1

    def _build(self) -> None:
        pages, size = [], 0
        work = [(self._node(0), np.arange(len(self.x)))]
        while work:
            node, rows = work.pop()
            away = np.sqrt(((self.x[rows] - self.x[self.routing[node]]) ** 2).sum(1))
            self.radius[node] = float(away.max())
            if len(rows) <= LEAF:
                by = np.argsort(away, kind="stable")
                pages.append(rows[by])
                self.page[node], self.away[node] = (size, size + len(rows)), away[by]
                size += len(rows)
                continue
            parts = self._split(rows)
            kids = [self._node(r) for r, _ in parts]
            self.children[node] = np.array(kids)
            self.away[node] = np.sqrt(((self.x[[r for r, _ in parts]] - self.x[self.routing[node]]) ** 2).sum(1))
            work.extend((kid, own) for kid, (_, own) in zip(kids, parts, strict=True))
        self.order = np.concatenate(pages)

    def _split(self, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Up to ``FAN`` parts around routing objects at even steps of the rows; equal rows are cut into even parts."""
        picked = np.unique(rows[np.linspace(0, len(rows) - 1, FAN).astype(np.int64)])
        near = _away(self.x[rows], self.x[picked]).argmin(1)
        parts = [(r, rows[near == k]) for k, r in enumerate(picked.tolist())]
        parts = [(r, own) for r, own in parts if len(own)]
        if len(parts) > 1:
            return parts
        return [(int(own[0]), own) for own in np.array_split(rows, min(FAN, -(-len(rows) // LEAF)))]

    def _by_node(self, node: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if not len(node):
            return
        order = np.argsort(node, kind="stable")
        edge = np.flatnonzero(np.diff(node[order], prepend=-1))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
            yield int(node[order[a]]), order[a:b]

    def _children_of(self, q: np.ndarray, who: np.ndarray, node: np.ndarray, far: np.ndarray, limit: np.ndarray):
        """(query, child, its distance) for pairs of query and inner node; without a distance where the bounds rule the child out."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for parent, at in self._by_node(node):
            kids = self.children[parent]
            open_ = np.abs(far[at][:, None] - self.away[parent]) - self.reach[kids] <= limit[who[at]][:, None]
            some = np.flatnonzero(open_.any(0))
            self.ruled_out += open_.size - open_[:, some].size
            if len(some):
                away = _away(q[who[at]], self.x[[self.routing[k] for k in kids[some]]])
                self.computed += away.size
                i, j = np.nonzero(open_[:, some])
                out.append((who[at][i], kids[some][j], away[i, j]))
        return tuple(np.concatenate(part) for part in zip(*out, strict=True))

    def search(self, q: np.ndarray, limit: np.ndarray, read) -> None:
        """Offers each query the pages that may hold one of its best, best-first.

        ``limit`` has each query's greatest distance of interest; ``read(queries, rows, open)`` looks at
        those rows (where ``open``) and lowers it in place. ``computed`` and ``ruled_out`` count distances.
        """
        self.computed = self.ruled_out = 0
        if not len(self.x) or not len(q):
            return
        everyone = np.arange(len(q))
        root = np.zeros(len(q), np.int64), _away(q, self.x[self.routing[:1]])[:, 0]
        inner = np.array([c is not None for c in self.children])
        who, node, far = everyone, *root
        first = np.full(len(q), -1)
        while len(who):
            done = ~inner[node]
            first[who[done]] = node[done]
            self._read(node[done], who[done], far[done], limit, read)
            who, node, far = who[~done], node[~done], far[~done]
            if len(who):
                w, n, f = self._children_of(q, who, node, far, np.full(len(q), np.inf))
                best = np.lexsort((f, w))
                best = best[np.diff(w[best], prepend=-1) != 0]
                who, node, far = w[best], n[best], f[best]
        pages = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        who, node, far = everyone, *root
        while len(who):
            leaf = ~inner[node]
            pages.append((who[leaf], node[leaf], far[leaf]))
            who, node, far = who[~leaf], node[~leaf], far[~leaf]
            if len(who):
                who, node, far = self._children_of(q, who, node, far, limit)
                near = far - self.reach[node] <= limit[who]
                who, node, far = who[near], node[near], far[near]
        who, node, far = (np.concatenate(part) for part in zip(*pages, strict=True))
        rest = node != first[who]
        who, node, far = who[rest], node[rest], far[rest]
        low = far - self.reach[node]
        order = np.lexsort((low, who))
        turn = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        turn = np.log2(turn + 1).astype(np.int64)
        for k in range(int(turn.max(initial=-1)) + 1):
            now = order[turn == k]
            now = now[low[now] <= limit[who[now]]]
            if not len(now):
                break
            self._read(node[now], who[now], far[now], limit, read)

    def _read(self, node: np.ndarray, who: np.ndarray, far: np.ndarray, limit: np.ndarray, read) -> None:
        for leaf, at in self._by_node(node):
            a, b = self.page[leaf]
            open_ = np.abs(far[at][:, None] - self.away[leaf]) <= limit[who[at]][:, None]
            some = np.flatnonzero(open_.any(0))
            self.ruled_out += len(at) * (b - a - len(some))
            if len(some):
                self.computed += len(at) * len(some)
                read(who[at], self.order[a:b][some], open_[:, some])


class Best:
    """The best ``k`` rows of a shard for queries that come in batches, by exact integer inner products."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.floats = x.astype(float)
        norm = (self.floats**2).sum(1)
        self.most = float(norm.max(initial=0))
        self.wide = float(np.abs(self.floats).max(initial=0)) * max(x.shape[1], 1)
        self.tree = MTree(np.concatenate((self.floats, np.sqrt(np.maximum(self.most - norm, 0))[:, None]), 1))

    def of(self, query_ids: np.ndarray, q: np.ndarray) -> list[tuple[int, int, int]]:
        """(query id, id, score) of each query's best rows, the best first."""
        # Components beyond the rows' width meet zeros.
        cut = np.pad(q, ((0, 0), (0, max(self.x.shape[1] - q.shape[1], 0))))[:, : self.x.shape[1]]
        floats = cut.astype(float)
        here = (floats**2).sum(1)
        slack = 1e-6 * (1 + np.sqrt(here + self.most))
        limit = np.full(len(q), np.inf)
        exact = self.wide * max(float(np.abs(floats).max(initial=0)), 1.0) < 1 << 52
        scores, names = np.full((len(q), self.k), _NONE, np.int64), np.full((len(q), self.k), np.iinfo(np.int64).max)
        lists: list[list[tuple[int, int]]] = [[] for _ in q]

        def read(who: np.ndarray, rows: np.ndarray, open_: np.ndarray) -> None:
            own = np.broadcast_to(self.ids[rows], open_.shape)
            open_ = open_ & (own != query_ids[who][:, None])
            if not exact:
                for i, w in enumerate(who.tolist()):
                    asked = cut[w].tolist()
                    lists[w] += [(-sum(a * b for a, b in zip(self.x[r].tolist(), asked, strict=True)), int(self.ids[r])) for r in rows[open_[i]].tolist()]
                    lists[w] = sorted(lists[w])[: self.k]
                    if len(lists[w]) == self.k:
                        limit[w] = math.sqrt(max(0.0, here[w] + self.most + 2 * float(lists[w][-1][0]))) * (1 + 1e-9) + slack[w]
                return
            found = (floats[who] @ self.floats[rows].T).astype(np.int64)
            found[~open_] = _NONE
            better = (open_ & (found >= scores[who, -1][:, None])).any(1)
            if not better.any():
                return
            who, found, open_, own = who[better], found[better], open_[better], own[better]
            all_scores, all_names = np.concatenate((scores[who], found), 1), np.concatenate((names[who], np.where(open_, own, np.iinfo(np.int64).max)), 1)
            order = np.lexsort((all_names, -all_scores), axis=1)[:, : self.k]
            scores[who], names[who] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_names, order, 1)
            last = scores[who, -1]
            limit[who] = np.where(last == _NONE, np.inf, np.sqrt(np.maximum(here[who] + self.most - 2.0 * last, 0)) + slack[who])

        self.tree.search(np.pad(floats, ((0, 0), (0, 1))), limit, read)
        if exact:
            return [(int(query_ids[i]), int(n), int(s)) for i in range(len(q)) for s, n in zip(scores[i], names[i], strict=True) if s != _NONE]
        return [(int(query_ids[i]), n, max(-(1 << 63), min((1 << 63) - 1, -s))) for i, own in enumerate(lists) for s, n in own]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(lists.offsets))
    flat, width = np.asarray(lists.flatten()), int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


def _searched(k: int):
    """Over rows sorted by shard: the shard's vectors, then the queries in any number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, best = None, [], None
        for batch in (b for b in batches if b.num_rows):
            table = pa.Table.from_batches([batch])
            place = table.column("shard").to_numpy() * 2 + table.column("asks").to_numpy()
            edge = np.flatnonzero(np.diff(place, prepend=-1))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(place)], strict=True):
                part = table.slice(a, b - a)
                if place[a] >> 1 != shard:
                    shard, held, best = place[a] >> 1, [], None
                if not place[a] & 1:
                    held.append(part)
                    continue
                if best is None and held:
                    whole = pa.concat_tables(held)
                    times = whole.column("times").to_numpy()
                    best, held = Best(np.repeat(whole.column("vec_id").to_numpy(), times), np.repeat(_matrix(whole.column("v")), times, 0), k), []
                if best is not None:
                    rows = best.of(part.column("vec_id").to_numpy(), _matrix(part.column("v")))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    return run


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): components floor(scale * x) of the rows that take part."""
    e = F.col("embedding")
    whole = F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == math.inf))
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & ~F.coalesce(bad, F.lit(False))).select("vec_id", whole.alias("v"))


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``vectors`` (vec_id, v: integers).

    The stated query set meets all rows shard by shard: a task holds one shard of at most ``shard_rows``
    vectors on average (by default as many as ``SHARD_BYTES`` hold) and one batch of queries.
    """
    spark = vectors.sparkSession
    small_batches(spark, 1 << 20)
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    shards = -(-size.n // (shard_rows or max(SHARD_BYTES // (8 * max(size.width, 1)), 1)))
    shards = max(shards, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size.n // SHARD_ROWS)), 1)
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    held = vectors.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("times"))
    held = held.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("shard"), F.lit(0).alias("asks"), "vec_id", "v", "times")
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("asks"), "vec_id", "v", F.lit(1).cast("long").alias("times"))
    found = held.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks").mapInArrow(released(_searched(k)), SCHEMA)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
