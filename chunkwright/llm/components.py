"""Connected components of a link table.

A table of links of at most ``few_bytes``, by a checked count, is one task's union-find. Larger ones take alternating
large-star and small-star steps: each is a join and a grouped minimum, and nothing is gathered in one
task or at the driver but the number of links and a checksum. Each step's links are written
to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.textops import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for batch in batches:
        for u, v in zip(*(batch.column(c).to_pylist() for c in ("u", "v")), strict=True):
            above.setdefault(u, u)
            above.setdefault(v, v)
            a, b = root(u), root(v)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])


def components(links: DataFrame, *, few_bytes: int = 4 << 20) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long); the root is the least node.

    Self-links and repeated links do no harm. No links, no rows. A link has 16 bytes.
    """
    now = stored(links.select("u", "v").where("u <> v").distinct(), "links")
    if 16 * now.count() <= few_bytes:
        return now.coalesce(1).mapInArrow(_joined, "node long, root long")
    before = None
    while True:
        now = stored(_small_star(_large_star(now)), "links")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
