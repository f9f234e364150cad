"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target comes from its weight, capped at a multiple of its size; what is
cut off is shared again by weight (water filling). Whole epochs come first: each takes
every document of the source. For the rest, documents are ordered by exponential keys,
-ln(u) / weight, with u from a hash of doc_id and the document's quality weight, and taken while their prefix sum stays within
what is left; documents larger than that are passed over. A long document may end this early, so
the same is done with the gap that it leaves, and once more. One last document, the one whose
size is nearest to what is still open, closes it if that brings the source nearer to its target.

Prefix sums do not gather a source in one task: sizes are first summed by fine key
ranges, and only the range that crosses the target is sorted row by row.

Rows: null and empty texts have size 0 and are taken 0 words. A null source is a
source of its own. Repeated rows count one by one; ties in the key go by doc_id and size.
A null or non-finite weight counts as 1, one below ``_LEAST`` as that. An empty table gives an empty
result. With all sizes 0 all targets are 0. Extra columns pass through, but for those named like
``ADDED``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwright.llm.textops import fresh, released, small_batches, stored, utf8, word_bounds

ADDED = ("size", "source_size", "target", "taken")
_OWN = ("_quality", "_key", "_range", "_row", "_extra", "_gap", "_epochs", "_rest", "_source", "_cross", "_before", "_inside", "_run", "_upto", "_s", "_in", "n")
_LEAST = 0.01
_RANGES = 1 << 12
#: Sources whose table is small enough to broadcast (some 100 bytes each).
_BROADCAST_ROWS = 50_000
_ROUNDS = 3


def _measured(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = [len(word_bounds(np.frombuffer(t, np.uint8))[0]) for t in utf8(table.column("text"))]
            yield from table.select(names).append_column("size", pa.array(sizes, pa.int64())).to_batches()

    return run


def targets(sizes: DataFrame, *, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row for each source.

    Weights repeat over the sources in code point order, null last. The windows run over one
    row for each source, not over documents.
    """
    n = F.row_number().over(W.orderBy(F.asc_nulls_last("source")))
    table = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(n - 1, F.lit(len(weights))) + 1).cast("double"))
    table = table.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = W.orderBy("ratio", F.asc_nulls_last("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    table = table.withColumn("all", share * F.sum("source_size").over(every)).withColumn("place", F.row_number().over(order))
    table = table.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
    table = table.withColumn("level", F.min_by("level", F.when(F.col("ratio") >= F.col("level"), F.col("place"))).over(every))
    return table.select("source", "source_size", F.least("cap", F.coalesce("level", "ratio") * F.col("w")).alias("target"))


def _with_sources(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Joins one row for each source. Its table is broadcast only if its checked size is small."""
    right = sources.withColumnRenamed("source", "_source")
    if sources.count() <= _BROADCAST_ROWS:
        right = F.broadcast(right)
    return docs.join(right, docs["source"].eqNullSafe(right["_source"])).drop("_source")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11, weight: str | None = None, keep_text: bool = False) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target`` and ``taken`` to each row of ``docs`` (doc_id, text, source).

    ``taken`` is a whole multiple of ``size``: how many words of the document the mix takes.
    ``weight`` names the column of the documents' quality weights; without it all weigh the same.
    The text is read for its size and kept only with ``keep_text``; other columns always are.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*ADDED)
    # Columns of the caller that are named like this module's own go by other names meanwhile.
    moved = {fresh(docs, f"_kept_{c}"): c for c in docs.columns if c.lower() in _OWN}
    docs = docs.withColumnsRenamed({c: other for other, c in moved.items()})
    weight = next((other for other, c in moved.items() if c == weight), weight)
    names = [c for c in docs.columns if keep_text or c.lower() != "text"]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("size", T.LongType())])
    rows = docs.mapInArrow(released(_measured(names)), schema)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    own = F.lit(1.0) if weight is None else F.coalesce(F.nanvl(F.col(weight).cast("double"), F.lit(1.0)), F.lit(1.0))
    rows = rows.withColumn("_quality", F.when(own == float("inf"), 1.0).otherwise(F.greatest(own, F.lit(_LEAST))))
    rows = rows.withColumn("_key", -F.log(u) / F.col("_quality"))
    rows = rows.withColumn("_range", F.floor(_RANGES * (1 - F.exp(-F.col("_key")))).cast("int")).withColumn("_row", F.monotonically_increasing_id())
    rows = stored(rows, "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights=weights, share=share, most=most)
    plan = plan.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = stored(plan.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size")), "mix-plan")
    slim = rows.select("_row", "source", "doc_id", "size", "_key", "_range").where("size > 0").withColumn("_extra", F.lit(0))
    gaps = plan.select("source", F.col("_rest").alias("_gap"))
    for _ in range(_ROUNDS):
        slim = stored(_filled(slim, gaps), "mix-filled")
        gaps = _gaps(slim, plan)
    spare = _with_sources(slim.where("_extra = 0"), gaps).where("abs(_gap - size) < _gap")
    closing = spare.groupBy("source").agg(F.min_by("_row", F.struct(F.abs(F.col("_gap") - F.col("size")), "_key", "doc_id", "size", "_row")).alias("_row"))
    extra = slim.where("_extra = 1").select("_row").union(closing.select("_row")).withColumn("_extra", F.lit(1))
    out = _with_sources(rows, plan).join(extra, "_row", "left")
    return out.withColumn("taken", (F.col("size") * (F.col("_epochs") + F.coalesce("_extra", F.lit(0)))).cast("long")).select(*names, *ADDED).withColumnsRenamed(moved)


def _filled(slim: DataFrame, gaps: DataFrame) -> DataFrame:
    """Takes (``_extra`` 1) further documents that fit in their source's gap, in key order, while their sum does."""
    state = _with_sources(slim, gaps)
    fits = (F.col("_extra") == 0) & (F.col("size") <= F.col("_gap"))
    # The key range in which each source's prefix sum passes the gap.
    by_range = state.where(fits).groupBy("source", "_range").agg(F.sum("size").alias("n"), F.first("_gap").alias("_gap"))
    by_range = by_range.withColumn("_upto", F.sum("n").over(W.partitionBy("source").orderBy("_range"))).where("_upto > _gap")
    cross = by_range.groupBy("source").agg(F.min("_range").alias("_cross"), F.min_by(F.col("_upto") - F.col("n"), "_range").alias("_before"))
    cross = gaps.select("source").join(cross.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    cross = stored(cross.withColumn("_cross", F.coalesce("_cross", F.lit(_RANGES + 1))), "mix-cross")
    state = _with_sources(state, cross)
    run = F.sum("size").over(W.partitionBy("source").orderBy("_key", "doc_id", "size", "_row").rowsBetween(W.unboundedPreceding, 0))
    inside = state.where(fits & (F.col("_range") == F.col("_cross"))).withColumn("_run", run).where("_before + _run <= _gap").select("_row", F.lit(1).alias("_inside"))
    chosen = fits & ((F.col("_range") < F.col("_cross")) | F.col("_inside").isNotNull())
    return state.join(inside, "_row", "left").withColumn("_extra", F.when(chosen, 1).otherwise(F.col("_extra"))).select(slim.columns)


def _gaps(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """What of each source's fractional part is still open."""
    done = slim.where("_extra = 1").groupBy(F.col("source").alias("_s")).agg(F.sum("size").alias("_in"))
    left = plan.join(done, F.col("source").eqNullSafe(F.col("_s")), "left")
    return stored(left.select("source", (F.col("_rest") - F.coalesce("_in", F.lit(0))).alias("_gap")), "mix-gaps")
