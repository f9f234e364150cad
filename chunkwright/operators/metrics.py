"""Statistics: stores, deduplication, scans, transfers, benchmarks and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkwright.functions import scalars as X


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def metadata_stats(snapshots: DataFrame, files: DataFrame, chunks: DataFrame, *, original: DataFrame | None = None) -> DataFrame:
    """One row. With ``original`` (n_bytes) the true deduplication ratio, else the constant 1.0."""
    stored = chunks.agg(F.count("*").alias("total_chunks"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_chunk_size"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_chunk_size"))
    # Joins of one-row totals.
    out = _count(snapshots, "total_snapshots").join(_count(files, "total_files")).join(stored)
    ratio: Column = F.lit(1.0)
    if original is not None:
        out = out.join(original)
        ratio = X.dedup_ratio(F.col("n_bytes"), F.col("total_chunk_size"))
    per_file = X.average(F.col("total_chunks"), F.col("total_files"))
    return out.select("total_snapshots", "total_files", "total_chunks", "total_chunk_size", per_file.alias("avg_chunks_per_file"), "avg_chunk_size", ratio.alias("deduplication_ratio"))


def store_stats(stored: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks and bytes of the store (hash, size), and how many more it holds than metadata know."""
    a = stored.agg(F.count("*").alias("total_chunks"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))
    return a.join(_count(known, "_known")).select("total_chunks", "total_bytes", F.greatest(F.lit(0).cast("long"), F.col("total_chunks") - F.col("_known")).alias("orphaned_chunks"))


def reference_counts(file_chunks: DataFrame) -> DataFrame:
    return file_chunks.groupBy("chunk_hash").agg(F.count("*").alias("reference_count"), F.count_distinct("file_id").alias("n_files"))


def dedup_summary(file_chunks: DataFrame) -> DataFrame:
    """Original and stored bytes and chunks, ratio and saving, from chunk rows. One shuffle, on the hash."""
    by_hash = file_chunks.groupBy("chunk_hash").agg(F.count("*").alias("n"), F.sum("chunk_size").alias("all"), F.max("chunk_size").alias("one"))
    total = by_hash.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(a) for c, a in (("n", "n_chunks"), ("all", "original_bytes"), ("one", "stored_bytes"))), F.count("*").alias("n_distinct"))
    o, s = F.col("original_bytes"), F.col("stored_bytes")
    return total.select("n_chunks", "n_distinct", "original_bytes", "stored_bytes", F.round(X.dedup_ratio(o, s), 6).alias("dedup_ratio"), F.round(X.space_savings(o, s), 6).alias("space_savings"))


def dedup_by_snapshot(files: DataFrame, file_chunks: DataFrame) -> DataFrame:
    """Of each snapshot: chunks per file, ratio and saving within it."""
    rows = file_chunks.join(files.select(F.col("id").alias("file_id"), "snapshot_id"), "file_id")
    by_hash = rows.groupBy("snapshot_id", "chunk_hash").agg(F.count("*").alias("n"), F.sum("chunk_size").alias("all"), F.max("chunk_size").alias("one"))
    out = by_hash.groupBy("snapshot_id").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_distinct"), F.sum("all").alias("original_bytes"), F.sum("one").alias("stored_bytes"))
    out = out.join(files.groupBy("snapshot_id").agg(F.count("*").alias("n_files")), "snapshot_id")
    o, s = F.col("original_bytes"), F.col("stored_bytes")
    return out.select("snapshot_id", "n_files", "n_chunks", "n_distinct", F.round(X.average(F.col("n_chunks"), F.col("n_files")), 6).alias("chunks_per_file"), F.round(X.dedup_ratio(o, s), 6).alias("dedup_ratio"), F.round(X.space_savings(o, s), 6).alias("space_savings"))


def shared_and_unique(files: DataFrame, file_chunks: DataFrame) -> DataFrame:
    """Chunks in one snapshot only, and chunks in several, with their bytes."""
    rows = file_chunks.join(files.select(F.col("id").alias("file_id"), "snapshot_id"), "file_id")
    by_hash = rows.groupBy("chunk_hash").agg(F.count_distinct("snapshot_id").alias("n"), F.max("chunk_size").alias("size"))
    return by_hash.groupBy(F.when(F.col("n") > 1, "shared").otherwise("unique").alias("kind")).agg(F.count("*").alias("n_chunks"), F.sum("size").alias("n_bytes"))


def scan_totals(scan: DataFrame) -> DataFrame:
    """Files, errors and bytes of a scan (size, error)."""
    fine = F.col("error").isNull()
    return scan.agg(F.count_if(fine).alias("n_files"), F.count_if(~fine).alias("n_errors"), F.coalesce(F.sum(F.when(fine, F.col("size"))), F.lit(0)).alias("n_bytes"))


def scan_events(scan: DataFrame) -> DataFrame:
    """A scan as the events that a listener would get: started, one for each file or error, completed with all bytes."""
    files = scan.select(F.when(F.col("error").isNull(), "file").otherwise("error").alias("event"), "path", "size")
    one = scan.agg(F.sum("size").alias("size"))
    none = F.lit(None).cast("string").alias("path")
    started = one.select(F.lit("started").alias("event"), none, F.lit(None).cast("long").alias("size"))
    return started.union(files).union(one.select(F.lit("completed").alias("event"), none, "size"))


def processing_counters(rows: DataFrame) -> DataFrame:
    """Of rows (is_regular, error, size): processed, skipped, failed, bytes and percent of bytes processed."""
    failed, regular = F.col("error").isNotNull(), F.col("is_regular")
    done = regular & ~failed
    out = rows.agg(
        F.count_if(done).alias("processed"), F.count_if(~regular & ~failed).alias("skipped"), F.count_if(failed).alias("failed"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0)).alias("processed_bytes"),
    )
    return out.withColumn("percent", F.round(100 * X.average(F.col("processed_bytes"), F.col("total_bytes")), 6))


def transfer_rates(transfers: DataFrame) -> DataFrame:
    """Progress, rate, expected rest and throughput of transfers (transfer_id, size, bytes, start_ms, update_ms)."""
    done, size, ms = F.col("bytes"), F.col("size"), F.col("update_ms") - F.col("start_ms")
    return transfers.select(
        "transfer_id", F.round(X.progress(done, size), 6).alias("progress"), F.round(X.rate(done, ms), 6).alias("rate"),
        F.round(X.time_left(ms, done, size), 2).alias("time_left_ms"), F.round(X.throughput(done, ms), 6).alias("throughput"),
    )


def last_states(events: DataFrame) -> DataFrame:
    """The last event of each transfer (ties: the highest event_id) and how often it changed."""
    last = F.max(F.struct("ts", "event_id", "state"))
    out = events.groupBy("transfer_id").agg(last.alias("_l"), F.count("*").alias("n_events"), F.sum("bytes").alias("bytes"), F.count_if(F.col("state") == "FAILED").alias("n_failures"))
    return out.select("transfer_id", F.col("_l.state").alias("state"), F.col("_l.event_id").alias("event_id"), "n_events", "bytes", "n_failures")


def network_counters(events: DataFrame) -> DataFrame:
    """Messages, bytes and mean rate by state over the whole uptime."""
    span = events.agg(F.min(F.unix_millis(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("b"))
    out = events.groupBy("state").agg(F.count("*").alias("n_messages"), F.sum("bytes").alias("n_bytes"))
    return out.join(span).select("state", "n_messages", "n_bytes", F.round(X.rate(F.col("n_bytes"), F.col("b") - F.col("a")), 6).alias("rate"))


def daily_counters(events: DataFrame) -> DataFrame:
    day = F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd")
    return events.groupBy(day.alias("day"), "state").agg(F.count("*").alias("n_messages"), F.sum("bytes").alias("n_bytes"))


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """Of benchmark runs (name, throughput, memory): mean values and count by class of name."""
    return runs.groupBy(X.benchmark_class(F.col("name")).alias("class")).agg(F.round(F.avg("throughput"), 6).alias("avg_throughput"), F.round(F.avg("memory"), 6).alias("avg_memory"), F.count("*").alias("n"))


def first_of_name(runs: DataFrame, order: list[str]) -> DataFrame:
    """The first run of each name in a stated order."""
    return runs.withColumn("_n", F.row_number().over(W.partitionBy("name").orderBy(*order))).where("_n = 1").drop("_n")


def with_metric(runs: DataFrame, key: str) -> DataFrame:
    """Runs whose metric map has a key."""
    return runs.where(F.map_contains_key("metrics", key))


def named_like(runs: DataFrame, part: str) -> DataFrame:
    """Runs whose name contains a text, whatever its case."""
    return runs.where(F.lower("name").contains(part.lower()))


def target_assessment(runs: DataFrame, target: float) -> DataFrame:
    """By class: how many runs reach a throughput."""
    out = runs.groupBy(X.benchmark_class(F.col("name")).alias("class")).agg(F.count_if(F.col("throughput") >= target).alias("met"), F.count("*").alias("total"))
    return out.withColumn("percent", F.round(100 * X.average(F.col("met"), F.col("total")), 6))


def efficiency(runs: DataFrame) -> DataFrame:
    """(name, first_ms, later_ms, serial_ms, workers, parallel_ms): incremental and concurrency efficiency, contention."""
    c = F.col
    return runs.select(
        "name",
        F.round(X.average(c("later_ms"), c("first_ms")), 6).alias("incremental_ratio"),
        F.round(X.average(c("serial_ms"), c("workers") * c("parallel_ms")), 6).alias("concurrency_efficiency"),
        F.round(100 * (1 - X.average(c("serial_ms"), c("workers") * c("parallel_ms"))), 6).alias("contention_percent"),
    )


def profiler_summary(samples: DataFrame) -> DataFrame:
    """Of samples (cpu, heap, gc_ms, threads, ts): means, peaks and share of time in collection."""
    ms = F.max(F.unix_millis(F.col("ts").cast("timestamp"))) - F.min(F.unix_millis(F.col("ts").cast("timestamp")))
    out = samples.agg(F.avg("cpu").alias("avg_cpu"), F.max("cpu").alias("peak_cpu"), F.avg("heap").alias("avg_heap"), F.max("heap").alias("peak_heap"), F.max("gc_ms").alias("gc_ms"), F.max("threads").alias("peak_threads"), ms.alias("_ms"))
    return out.select(F.round("avg_cpu", 6).alias("avg_cpu"), "peak_cpu", F.round("avg_heap", 6).alias("avg_heap"), "peak_heap", "gc_ms", F.round(100 * X.average(F.col("gc_ms"), F.col("_ms")), 6).alias("gc_percent"), "peak_threads")
