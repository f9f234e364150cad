"""Verification, orphans and synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_status(file_chunks: DataFrame, blobs: DataFrame) -> DataFrame:
    """Each chunk row with ``status``: ok, missing or corrupt. ``blobs`` has hash and content.

    A blob's own hash is computed once, before the join, and its content goes no further.
    """
    actual = blobs.select(F.col("hash").alias("chunk_hash"), F.sha2("content", 256).alias("_actual"))
    status = F.when(F.col("_actual").isNull(), "missing").when(F.col("_actual") != F.col("chunk_hash"), "corrupt").otherwise("ok")
    return file_chunks.join(actual, "chunk_hash", "left").withColumn("status", status).drop("_actual")


def file_status(files: DataFrame, checked: DataFrame, actual: DataFrame | None = None) -> DataFrame:
    """Of each file: chunks, bad chunks, bytes, and whether it is sound (with ``actual`` (id, actual_hash) also its own hash)."""
    by_file = checked.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n_chunks"), F.count_if(F.col("status") != "ok").alias("n_bad"), F.sum("chunk_size").alias("n_bytes"))
    out = files.join(by_file, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_chunks", "n_bad", "n_bytes")})
    good = (F.col("n_bad") == 0) & (F.col("n_bytes") == F.col("size"))
    if actual is not None:
        out = out.join(actual.select("id", "actual_hash"), "id", "left")
        good &= F.coalesce(F.col("actual_hash") == F.col("file_hash"), F.lit(False))
    return out.withColumn("ok", good)


def verify_totals(file_rows: DataFrame) -> DataFrame:
    c = F.col
    return file_rows.agg(
        F.count_if(c("ok")).alias("files_ok"),
        F.count_if(~c("ok")).alias("files_bad"),
        F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks_checked"),
        F.coalesce(F.sum("n_bad"), F.lit(0)).alias("chunks_bad"),
        F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes_checked"),
        F.coalesce(F.bool_and("ok"), F.lit(True)).alias("passed"),
    )


def restored_status(expected: DataFrame, restored: DataFrame) -> DataFrame:
    """(path, status) of expected files (path, file_hash) against restored ones: a missing one is a failure."""
    found = restored.select("path", F.col("file_hash").alias("_found"))
    status = F.when(F.col("_found").isNull(), "missing").when(F.col("_found") != F.col("file_hash"), "corrupt").otherwise("ok")
    return expected.select("path", "file_hash").join(found, "path", "left").select("path", status.alias("status"))


def orphans(chunks: DataFrame, file_chunks: DataFrame) -> DataFrame:
    """Chunks that no file has."""
    return chunks.join(file_chunks.select(F.col("chunk_hash").alias("hash")), "hash", "left_anti")


def referenced(chunks: DataFrame, file_chunks: DataFrame) -> DataFrame:
    return chunks.join(file_chunks.select(F.col("chunk_hash").alias("hash")), "hash", "left_semi")


def reclaimable(chunks: DataFrame, file_chunks: DataFrame) -> DataFrame:
    """What a garbage collection would take away; a dry run."""
    return orphans(chunks, file_chunks).agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))


def existing(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted hashes (hash) that are stored."""
    return wanted.select("hash").distinct().join(chunks.select("hash"), "hash", "left_semi")


def sync_difference(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(id, direction, total_size) of what one side has and the other lacks."""
    a, b = (t.select("id", F.col("total_size").alias(f"_{x}")) for x, t in (("a", local), ("b", remote)))
    both = a.join(b, "id", "full_outer").where("_a is null or _b is null")
    return both.select("id", F.when(F.col("_b").isNull(), "to_remote").otherwise("to_local").alias("direction"), F.coalesce("_a", "_b").alias("total_size"))


def sync_totals(difference: DataFrame) -> DataFrame:
    return difference.groupBy("direction").agg(F.count("*").alias("n"), F.sum("total_size").alias("n_bytes"))


def reassembled(files: DataFrame, file_chunks: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files with ``content``: their chunks joined in order; an empty file has empty content."""
    pieces = file_chunks.join(blobs.select(F.col("hash").alias("chunk_hash"), "content"), "chunk_hash")
    whole = pieces.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("chunk_order", "content"))).alias("_p"))
    body = F.aggregate("_p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["content"]))
    return files.join(whole, "id", "left").withColumn("content", F.coalesce(body, F.lit(b"").cast("binary"))).drop("_p")
