"""Snapshots: lists, statistics, files with their chunk lists, comparison, retention, row changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkwright.functions.globs import matches


def with_totals(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """Adds total_files and total_size, counted from ``files``."""
    totals = files.groupBy("snapshot_id").agg(F.count("*").alias("total_files"), F.sum("size").alias("total_size"))
    out = snapshots.join(totals, snapshots["id"] == totals["snapshot_id"], "left").drop("snapshot_id")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("total_files", "total_size")})


def by_date(snapshots: DataFrame) -> DataFrame:
    """With their place in the order of creation, the newest first."""
    return snapshots.withColumn("place", F.row_number().over(W.orderBy(F.desc("created_at"), "id")))


def by_size(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("place", F.row_number().over(W.orderBy(F.desc("total_size"), F.desc("created_at"), "id")))


def list_totals(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.count("*").alias("n_snapshots"), F.coalesce(F.sum("total_files"), F.lit(0)).alias("total_files"), F.coalesce(F.sum("total_size"), F.lit(0)).alias("total_size"))


def find(table: DataFrame, key: str, value: str) -> DataFrame:
    return table.where(F.col(key) == value)


def statistics(files: DataFrame) -> DataFrame:
    """Of each snapshot: files, bytes, integer mean, the largest file and the smallest that is not empty (ties: first path)."""
    filled = F.col("size") > 0
    out = files.groupBy("snapshot_id").agg(
        F.count("*").alias("n_files"),
        F.sum("size").alias("total_size"),
        F.min(F.struct((-F.col("size")).alias("k"), F.col("path").alias("path"))).alias("_large"),
        F.min(F.when(filled, F.struct(F.col("size").alias("k"), F.col("path").alias("path")))).alias("_small"),
    )
    return out.select(
        "snapshot_id",
        "n_files",
        "total_size",
        F.expr("total_size div n_files").alias("mean_size"),
        (-F.col("_large.k")).alias("max_size"),
        F.col("_large.path").alias("max_path"),
        F.col("_small.k").alias("min_size"),
        F.col("_small.path").alias("min_path"),
    )


def first_files(files: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` files of each snapshot in path order, and how many more there are."""
    place = F.row_number().over(W.partitionBy("snapshot_id").orderBy("path"))
    top = files.withColumn("place", place).where(F.col("place") <= n)
    total = files.groupBy("snapshot_id").agg(F.count("*").alias("_n"))
    return top.join(total, "snapshot_id").select("snapshot_id", "place", "path", "size", F.greatest(F.col("_n") - n, F.lit(0)).alias("more"))


def placed(rows: DataFrame, by: str, *, ranges: int = 256) -> DataFrame:
    """Adds ``place`` in ascending order of ``by``, nulls first, without a sort of all rows in one task.

    The bounds of the ranges come from the 16 * ``ranges`` values of least hash (one job, run now); they decide
    only how even the tasks are. Rows are numbered within their range, after the counts of the ranges before it.
    """
    some = sorted(r[0] for r in rows.where(F.col(by).isNotNull()).select(by).orderBy(F.xxhash64(by), by).limit(16 * ranges).collect())
    bounds = some[16::16]
    below = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(by))) if bounds else F.lit(0)
    dealt = rows.withColumn("_part", below)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(by))
    return dealt.withColumn("_k", within).join(F.broadcast(before), "_part").withColumn("place", (F.col("_before") + F.col("_k")).cast("int")).drop("_part", "_k", "_before")


def files_of(files: DataFrame, snapshot: str) -> DataFrame:
    """A snapshot's files with their place in path order."""
    return placed(files.where(F.col("snapshot_id") == snapshot), "path")


def with_chunk_lists(files: DataFrame, file_chunks: DataFrame) -> DataFrame:
    """Adds the ordered chunk hashes of each file; a file without chunks has an empty list."""
    lists = file_chunks.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("chunk_order", "chunk_hash"))).alias("_c"))
    out = files.join(lists, files["id"] == lists["file_id"], "left").drop("file_id")
    return out.withColumn("chunk_hashes", F.coalesce(F.col("_c.chunk_hash"), F.array().cast("array<string>"))).drop("_c")


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, size_difference): added, deleted, modified or unchanged."""
    a, b = (f.select("path", F.col("size").alias(f"_s{x}"), F.col("file_hash").alias(f"_h{x}")) for x, f in (("a", old), ("b", new)))
    change = F.when(F.col("_ha").isNull(), "added").when(F.col("_hb").isNull(), "deleted").when(F.col("_ha") != F.col("_hb"), "modified").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"), (F.coalesce("_sb", F.lit(0)) - F.coalesce("_sa", F.lit(0))).alias("size_difference"))


def comparison_totals(compared: DataFrame) -> DataFrame:
    return compared.groupBy("change").agg(F.count("*").alias("n_files"), F.sum("size_difference").alias("size_difference"))


def changed_since(files: DataFrame, now: DataFrame) -> DataFrame:
    """Rows of ``now`` (path, size, modified_ms) that an incremental snapshot must read: new, or of other size or time than in ``files``."""
    same = files.select("path", "size", "modified_ms")
    return now.join(same, ["path", "size", "modified_ms"], "left_anti")


def filtered(snapshots: DataFrame, *, name: str | None = None, since: Column | None = None, until: Column | None = None, min_size: int | None = None, max_size: int | None = None) -> DataFrame:
    """Snapshots (with totals) by name glob, dates and sizes; all bounds are inclusive."""
    c = F.col
    if name:
        snapshots = snapshots.where(matches(c("name"), name))
    for bound, ok in ((since, lambda b: c("created_at") >= b), (until, lambda b: c("created_at") <= b), (min_size, lambda b: c("total_size") >= b), (max_size, lambda b: c("total_size") <= b)):
        if bound is not None:
            snapshots = snapshots.where(ok(bound))
    return snapshots


def of_last_days(snapshots: DataFrame, days: int) -> DataFrame:
    """Snapshots of the ``days`` up to the newest one."""
    newest = snapshots.agg(F.max("created_at").alias("_newest"))
    return snapshots.join(newest).where(F.col("created_at") >= F.col("_newest") - F.make_dt_interval(F.lit(days))).drop("_newest")


def retained(snapshots: DataFrame, unit: str = "day", keep: int | None = None, *, first: bool = False) -> DataFrame:
    """Of each day, week or month the last snapshot (or the first); of the latest ``keep`` units."""
    bucket = F.date_trunc(unit, "created_at")
    order = F.asc("created_at") if first else F.desc("created_at")
    out = snapshots.withColumn("bucket", bucket).withColumn("_n", F.row_number().over(W.partitionBy("bucket").orderBy(order, "id"))).where("_n = 1").drop("_n")
    if keep is not None:
        out = out.withColumn("_n", F.row_number().over(W.orderBy(F.desc("bucket")))).where(F.col("_n") <= keep).drop("_n")
    return out


def deletable(snapshots: DataFrame, kept: DataFrame) -> DataFrame:
    return snapshots.join(kept.select("id"), "id", "left_anti")


def delete_snapshot(tables: dict[str, DataFrame], snapshot: str) -> dict[str, DataFrame]:
    """The tables without a snapshot, its files and their chunk rows; chunks stay."""
    files = tables["files"].where(F.col("snapshot_id") != snapshot)
    gone = tables["files"].where(F.col("snapshot_id") == snapshot).select(F.col("id").alias("file_id"))
    return tables | {"snapshots": tables["snapshots"].where(F.col("id") != snapshot), "files": files, "file_chunks": tables["file_chunks"].join(gone, "file_id", "left_anti")}


def delete_files(files: DataFrame, file_chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the files named by ``ids`` (id)."""
    return files.join(ids, "id", "left_anti"), file_chunks.join(ids.withColumnRenamed("id", "file_id"), "file_id", "left_anti")


def update_files(files: DataFrame, file_chunks: DataFrame, new_files: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """With rows of existing files replaced and their chunk lists with them; unknown ids change nothing."""
    known = new_files.join(files.select("id"), "id", "left_semi")
    rest, chunks = delete_files(files, file_chunks, known.select("id"))
    return rest.unionByName(known), chunks.unionByName(new_chunks.join(known.select(F.col("id").alias("file_id")), "file_id", "left_semi"))


def upsert_chunks(chunks: DataFrame, seen: DataFrame) -> DataFrame:
    """Chunks with newly seen ones: first_seen only falls, last_accessed only rises."""
    return chunks.unionByName(seen).groupBy("hash").agg(F.max("size").alias("size"), F.min("first_seen").alias("first_seen"), F.max("last_accessed").alias("last_accessed"))


def missing_parents(files: DataFrame, snapshots: DataFrame, file_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rule, key) of rows whose snapshot, file or chunk does not exist."""
    a = files.join(snapshots.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_anti").select(F.lit("file_without_snapshot").alias("rule"), F.col("id").alias("key"))
    b = file_chunks.join(files.select(F.col("id").alias("file_id")), "file_id", "left_anti").select(F.lit("chunk_row_without_file").alias("rule"), F.col("file_id").alias("key"))
    c = file_chunks.join(chunks.select(F.col("hash").alias("chunk_hash")), "chunk_hash", "left_anti").select(F.lit("chunk_row_without_chunk").alias("rule"), F.col("chunk_hash").alias("key"))
    return a.union(b).union(c)
