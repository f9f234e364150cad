"""The registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.functions import scalars as X
from chunkwright.functions.globs import selected
from chunkwright.operators import metrics, model, snapshots, verify
from chunkwright.operators.chunking import chunks_of, file_hashes
from chunkwright.plans import fixtures as T
from chunkwright.sources import fsscan

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(tables: str = "", sql: str | None = None):
    """Registers a function under its name, with SQL over the named fixtures."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = T.sql(tables, sql) if tables else sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Chunks and hashes


@query(
    "",
    f"""WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS h FROM documents),
c AS (SELECT sha256(unhex(substr(h, (i * {2 * T.K} + 1)::BIGINT, {2 * T.K}))) AS hash, least({T.K}, n - i * {T.K}) AS size FROM (SELECT *, unnest(range(0, ceil(n / {T.K}.0)::BIGINT)) AS i FROM d)),
g AS (SELECT hash, count(*) AS n, sum(size) AS a, max(size) AS s FROM c GROUP BY 1),
t AS (SELECT sum(n)::BIGINT AS n_chunks, count(*) AS n_distinct, sum(a)::BIGINT AS original_bytes, sum(s)::BIGINT AS stored_bytes FROM g)
SELECT *, round(original_bytes / stored_bytes, 6) AS dedup_ratio, round((1 - stored_bytes / original_bytes) * 100, 6) AS space_savings FROM t""",
)
def dedup_summary(spark, sf):
    docs = T.read(spark, sf, "documents")
    return metrics.dedup_summary(chunks_of(docs, F.encode("text", "UTF-8"), ["doc_id"], chunk=T.K))


@query("files file_chunks", "SELECT file_id, chunk_order, chunk_size, chunk_hash FROM file_chunks")
def chunk_list(spark, sf):
    return T.file_chunks(spark, sf)


@query("", "SELECT doc_id, octet_length(encode(text))::BIGINT AS size, sha256(text) AS file_hash FROM documents")
def file_hashes_of_documents(spark, sf):
    return file_hashes(T.read(spark, sf, "documents"), F.encode("text", "UTF-8"), ["doc_id"])


@query("m_file_chunks m_files", "SELECT id, size, coalesce((SELECT string_agg(chunk_hash, ',' ORDER BY chunk_order) FROM m_file_chunks c WHERE c.file_id = f.id), '') AS hashes FROM m_files f")
def file_chunk_arrays(spark, sf):
    rows = snapshots.with_chunk_lists(T.m_files(spark, sf), T.m_file_chunks(spark, sf))
    return rows.select("id", "size", F.array_join("chunk_hashes", ",").alias("hashes"))


@query("files file_chunks chunks", "SELECT hash, substr(hash, 1, 2) || '/' || substr(hash, 3) AS path, size FROM chunks")
def chunk_path_layout(spark, sf):
    return T.chunks(spark, sf).select("hash", X.blob_path(F.col("hash")).alias("path"), "size")


# Snapshots

_TOTALS = "totals AS (SELECT s.*, coalesce(n, 0)::BIGINT AS total_files, coalesce(b, 0)::BIGINT AS total_size FROM m_snapshots s LEFT JOIN (SELECT snapshot_id, count(*) AS n, sum(size) AS b FROM m_files GROUP BY 1) f ON f.snapshot_id = s.id)"
T.SQL["totals"] = _TOTALS


def _totals(spark, sf):
    return snapshots.with_totals(T.m_snapshots(spark, sf), T.m_files(spark, sf))


@query("m_file_chunks m_files m_snapshots totals", "SELECT *, row_number() OVER (ORDER BY created_at DESC, id)::INTEGER AS place FROM totals")
def snapshot_list_by_date(spark, sf):
    return snapshots.by_date(_totals(spark, sf))


@query("m_file_chunks m_files m_snapshots totals", "SELECT *, row_number() OVER (ORDER BY total_size DESC, created_at DESC, id)::INTEGER AS place FROM totals")
def snapshot_list_by_size(spark, sf):
    return snapshots.by_size(_totals(spark, sf))


@query("m_file_chunks m_files m_snapshots totals", "SELECT count(*) AS n_snapshots, sum(total_files)::BIGINT AS total_files, sum(total_size)::BIGINT AS total_size FROM totals")
def snapshot_list_totals(spark, sf):
    return snapshots.list_totals(_totals(spark, sf))


@query(
    "m_file_chunks m_files",
    """SELECT snapshot_id, count(*) AS n_files, sum(size)::BIGINT AS total_size, (sum(size) // count(*))::BIGINT AS mean_size,
  max(size) AS max_size, first(path ORDER BY size DESC, path) AS max_path, min(size) FILTER (size > 0) AS min_size, first(path ORDER BY size, path) FILTER (size > 0) AS min_path
  FROM m_files GROUP BY 1""",
)
def snapshot_info(spark, sf):
    return snapshots.statistics(T.m_files(spark, sf))


@query(
    "m_file_chunks m_files",
    """SELECT snapshot_id, place::INTEGER AS place, path, size, greatest(n - 20, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY path) AS place, count(*) OVER (PARTITION BY snapshot_id) AS n FROM m_files) WHERE place <= 20""",
)
def snapshot_top_files(spark, sf):
    return snapshots.first_files(T.m_files(spark, sf), 20)


@query("files", "SELECT id, path, size, row_number() OVER (ORDER BY path)::INTEGER AS place FROM files WHERE snapshot_id = 's1'")
def files_by_path(spark, sf):
    return snapshots.files_of(T.files(spark, sf), "s1").select("id", "path", "size", "place")


@query("snapshots", "SELECT id, name, created_at, description FROM snapshots WHERE id = 's2'")
def snapshot_by_id(spark, sf):
    return snapshots.find(T.snapshots(spark), "id", "s2")


@query("m_file_chunks m_files m_snapshots totals", "SELECT id, name, total_files, total_size FROM totals WHERE regexp_matches(name, '^customer-[^/]*[05]$') AND created_at >= TIMESTAMP '1995-01-01' AND total_size >= 10000 AND total_size <= 60000")
def snapshot_filter(spark, sf):
    since = F.lit("1995-01-01").cast("timestamp_ntz")
    return snapshots.filtered(_totals(spark, sf), name="customer-*[05]", since=since, min_size=10_000, max_size=60_000).select("id", "name", "total_files", "total_size")


@query("m_snapshots", "SELECT id, name, strftime(date_trunc('day', created_at), '%Y-%m-%d') AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('day', created_at) ORDER BY created_at DESC, id) AS n FROM m_snapshots) WHERE n = 1")
def retention_daily(spark, sf):
    return snapshots.retained(T.m_snapshots(spark, sf), "day").select("id", "name", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"))


@query("m_snapshots", "SELECT id, name, strftime(b, '%Y-%m-%d') AS bucket FROM (SELECT *, date_trunc('month', created_at) AS b, row_number() OVER (PARTITION BY date_trunc('month', created_at) ORDER BY created_at, id) AS n FROM m_snapshots) WHERE n = 1 QUALIFY row_number() OVER (ORDER BY b DESC) <= 12")
def retention_first_of_month(spark, sf):
    return snapshots.retained(T.m_snapshots(spark, sf), "month", 12, first=True).select("id", "name", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"))


@query("m_snapshots", "SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('week', created_at) ORDER BY created_at DESC, id) AS n FROM m_snapshots) WHERE n > 1")
def retention_deletable(spark, sf):
    rows = T.m_snapshots(spark, sf)
    return snapshots.deletable(rows, snapshots.retained(rows, "week")).select("id", "name")


_COMPARED = """compared AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.file_hash <> b.file_hash THEN 'modified' ELSE 'unchanged' END AS change,
  (coalesce(b.size, 0) - coalesce(a.size, 0))::BIGINT AS size_difference
  FROM (SELECT * FROM files WHERE snapshot_id = 's1') a FULL JOIN (SELECT * FROM files WHERE snapshot_id = 's2') b ON a.path = b.path)"""
T.SQL["compared"] = _COMPARED


def _compared(spark, sf):
    rows = T.files(spark, sf)
    return snapshots.compare(rows.where("snapshot_id = 's1'"), rows.where("snapshot_id = 's2'"))


@query("files compared", "SELECT * FROM compared")
def snapshot_compare(spark, sf):
    return _compared(spark, sf)


@query("files compared", "SELECT change, count(*) AS n_files, sum(size_difference)::BIGINT AS size_difference FROM compared GROUP BY 1")
def snapshot_compare_totals(spark, sf):
    return snapshots.comparison_totals(_compared(spark, sf))


# Statistics

_STATS = "SELECT (SELECT count(*) FROM m_snapshots) AS total_snapshots, (SELECT count(*) FROM m_files) AS total_files, count(*) AS total_chunks, sum(size)::BIGINT AS total_chunk_size, count(*) / (SELECT count(*) FROM m_files) AS avg_chunks_per_file, avg(size) AS avg_chunk_size"


@query("m_file_chunks m_files m_chunks m_snapshots", _STATS + ", (SELECT sum(chunk_size) FROM m_file_chunks) / sum(size) AS deduplication_ratio FROM m_chunks")
def metadata_stats(spark, sf):
    original = T.m_file_chunks(spark, sf).agg(F.sum("chunk_size").alias("n_bytes"))
    return metrics.metadata_stats(T.m_snapshots(spark, sf), T.m_files(spark, sf), T.m_chunks(spark, sf), original=original)


@query("m_file_chunks m_files m_chunks m_snapshots", _STATS + ", 1.0::DOUBLE AS deduplication_ratio FROM m_chunks")
def stats_compat(spark, sf):
    return metrics.metadata_stats(T.m_snapshots(spark, sf), T.m_files(spark, sf), T.m_chunks(spark, sf))


@query("files file_chunks chunks", "SELECT (SELECT count(*) FROM chunks) AS total_chunks, (SELECT sum(size) FROM chunks)::BIGINT AS total_bytes, greatest(0, (SELECT count(*) FROM chunks) - count(DISTINCT chunk_hash))::BIGINT AS orphaned_chunks FROM file_chunks WHERE file_id LIKE 's2:%'")
def store_stats(spark, sf):
    known = T.file_chunks(spark, sf).where("file_id like 's2:%'").select("chunk_hash").distinct()
    return metrics.store_stats(T.chunks(spark, sf), known)


@query("m_file_chunks", "SELECT chunk_hash, count(*) AS reference_count, count(DISTINCT file_id) AS n_files FROM m_file_chunks GROUP BY 1")
def chunk_refcounts(spark, sf):
    return metrics.reference_counts(T.m_file_chunks(spark, sf))


@query("files file_chunks", "SELECT kind, count(*) AS n_chunks, sum(size)::BIGINT AS n_bytes FROM (SELECT CASE WHEN count(DISTINCT split_part(file_id, ':', 1)) > 1 THEN 'shared' ELSE 'unique' END AS kind, max(chunk_size) AS size FROM file_chunks GROUP BY chunk_hash) GROUP BY 1")
def shared_vs_unique_chunks(spark, sf):
    return metrics.shared_and_unique(T.files(spark, sf), T.file_chunks(spark, sf))


@query(
    "files file_chunks",
    """, g AS (SELECT split_part(file_id, ':', 1) AS snapshot_id, chunk_hash, count(*) AS n, sum(chunk_size) AS a, max(chunk_size) AS s FROM file_chunks GROUP BY 1, 2)
SELECT snapshot_id, n_files, sum(n)::BIGINT AS n_chunks, count(*) AS n_distinct, round(sum(n) / n_files, 6) AS chunks_per_file, round(sum(a) / sum(s), 6) AS dedup_ratio, round((1 - sum(s) / sum(a)) * 100, 6) AS space_savings
FROM g JOIN (SELECT snapshot_id, count(*) AS n_files FROM files GROUP BY 1) USING (snapshot_id) GROUP BY snapshot_id, n_files""",
)
def dedup_by_snapshot(spark, sf):
    return metrics.dedup_by_snapshot(T.files(spark, sf), T.file_chunks(spark, sf))


# Filters of paths and sizes


@query("files", r"SELECT id, path FROM files WHERE (regexp_matches(path, '^.*/src1[^/]*/[^/]*\.txt$') OR regexp_matches(regexp_extract(path, '[^/]*$'), '^.*/src1[^/]*/[^/]*\.txt$')) AND NOT (regexp_matches(path, '^[^/]*7\.txt$') OR regexp_matches(regexp_extract(path, '[^/]*$'), '^[^/]*7\.txt$'))")
def glob_filter(spark, sf):
    return T.files(spark, sf).where(selected(F.col("path"), "**/src1*/*.txt", "*7.txt")).select("id", "path")


@query("files", r"SELECT id, path FROM files WHERE regexp_matches(path, '^/(en|fr)/[^/]*/[^/]*\.txt$') AND NOT regexp_matches(path, '^.*/src2/.*$')")
def restore_filter(spark, sf):
    return T.files(spark, sf).where(selected(F.col("path"), "/{en,fr}/*/*.txt", "**/src2/**", strict=True)).select("id", "path")


@query("files", "SELECT id, path FROM files WHERE regexp_matches(path, '^/de/src[0-9]+/[0-9]+[.]txt$')")
def regex_filter(spark, sf):
    return T.files(spark, sf).where(selected(F.col("path"), "regex:/de/src[0-9]+/[0-9]+[.]txt")).select("id", "path")


@query("files", "SELECT id, size FROM files WHERE size >= 1000 AND size <= 5000")
def size_filter(spark, sf):
    return fsscan.filtered(T.files(spark, sf), min_size=1000, max_size=5000).select("id", "size")


_SCAN = "SELECT replace(replace(path, '/en/', '.en/'), '/de/', 'a/.de/') AS p, id FROM files"


def _hidden_paths(spark, sf):
    path = F.replace(F.replace(F.col("path"), F.lit("/en/"), F.lit(".en/")), F.lit("/de/"), F.lit("a/.de/"))
    return T.files(spark, sf).select("id", path.alias("path"))


@query("files", rf"SELECT id, p AS path FROM ({_SCAN}) WHERE NOT regexp_matches(p, '(^|/)\.')")
def hidden_filter(spark, sf):
    return fsscan.filtered(_hidden_paths(spark, sf))


@query("files", f"SELECT id, p AS path FROM ({_SCAN}) WHERE len(string_split(p, '/')) <= 3")
def depth_filter(spark, sf):
    return fsscan.filtered(_hidden_paths(spark, sf), hidden=True, max_depth=3)


@query("files", "SELECT id, path FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, file_hash ORDER BY path) AS n FROM files) WHERE snapshot_id = 's1' OR n = 1")
def symlink_follow(spark, sf):
    rows = T.files(spark, sf).withColumns({"is_symlink": F.col("snapshot_id") == "s2", "real_path": F.concat("snapshot_id", "file_hash"), "error": F.lit(None).cast("string")})
    return fsscan.with_links(rows, "FOLLOW").select("id", "path")


@query("", "SELECT p_partkey, p_size < p_retailprice * 0.9 AS sparse FROM part")
def sparse_flags(spark, sf):
    return T.read(spark, sf, "part").select("p_partkey", fsscan.is_sparse(F.col("p_size"), F.col("p_retailprice")).alias("sparse"))


# Verification


_STATUS = "status AS (SELECT *, CASE WHEN chunk_hash LIKE '0%' THEN 'missing' WHEN chunk_hash LIKE '1%' THEN 'corrupt' ELSE 'ok' END AS status FROM file_chunks)"
T.SQL["status"] = _STATUS


def _checked(spark, sf):
    return verify.chunk_status(T.file_chunks(spark, sf), T.blobs(spark, sf, faulty=True))


@query("files file_chunks status", "SELECT status, count(*) AS n, sum(chunk_size)::BIGINT AS n_bytes FROM status GROUP BY 1")
def verify_chunks(spark, sf):
    return _checked(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.sum("chunk_size").alias("n_bytes"))


T.SQL["file_status"] = "file_status AS (SELECT id, size, count(file_id) AS n_chunks, count(*) FILTER (status <> 'ok') AS n_bad, coalesce(sum(chunk_size), 0)::BIGINT AS n_bytes FROM files LEFT JOIN status ON file_id = id GROUP BY 1, 2)"


def _file_rows(spark, sf):
    files = T.files(spark, sf)
    actual = files.select("id", F.sha2("body", 256).alias("actual_hash"))
    return verify.file_status(files.drop("body"), _checked(spark, sf), actual)


@query("files file_chunks status file_status", "SELECT id, n_chunks, n_bad, n_bytes, n_bad = 0 AND n_bytes = size AS ok FROM file_status")
def verify_files(spark, sf):
    return _file_rows(spark, sf).select("id", "n_chunks", "n_bad", "n_bytes", "ok")


@query("files file_chunks status file_status", "SELECT count(*) FILTER (n_bad = 0) AS files_ok, count(*) FILTER (n_bad > 0) AS files_bad, sum(n_chunks)::BIGINT AS chunks_checked, sum(n_bad)::BIGINT AS chunks_bad, sum(n_bytes)::BIGINT AS bytes_checked, bool_and(n_bad = 0) AS passed FROM file_status")
def verify_totals(spark, sf):
    return verify.verify_totals(_file_rows(spark, sf))


@query("files", "SELECT a.path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.file_hash <> b.file_hash THEN 'corrupt' ELSE 'ok' END AS status FROM files a LEFT JOIN files b ON a.path = b.path AND b.snapshot_id = 's2' WHERE a.snapshot_id = 's1'")
def restored_status(spark, sf):
    rows = T.files(spark, sf)
    return verify.restored_status(rows.where("snapshot_id = 's1'"), rows.where("snapshot_id = 's2'"))


@query("files", "SELECT id, size, file_hash AS restored_hash, true AS same FROM files")
def restore_reassembly(spark, sf):
    rows = verify.reassembled(T.files(spark, sf).drop("body"), T.file_chunks(spark, sf), T.blobs(spark, sf))
    actual = F.sha2("content", 256)
    return rows.select("id", "size", actual.alias("restored_hash"), (actual == F.col("file_hash")).alias("same"))


# Orphans, synchronisation, changes of rows

T.SQL["rest"] = "rest AS (SELECT * FROM file_chunks WHERE file_id NOT LIKE 's1:%')"


def _without_first(spark, sf):
    tables = {"snapshots": T.snapshots(spark), "files": T.files(spark, sf).drop("body"), "file_chunks": T.file_chunks(spark, sf)}
    return snapshots.delete_snapshot(tables, "s1")


@query("files file_chunks chunks rest", "SELECT hash, size FROM chunks WHERE hash NOT IN (SELECT chunk_hash FROM rest)")
def gc_orphans(spark, sf):
    return verify.orphans(T.chunks(spark, sf), _without_first(spark, sf)["file_chunks"])


@query("files file_chunks chunks rest", "SELECT hash, size FROM chunks WHERE hash IN (SELECT chunk_hash FROM rest)")
def gc_retained(spark, sf):
    return verify.referenced(T.chunks(spark, sf), _without_first(spark, sf)["file_chunks"])


@query("files file_chunks chunks rest", "SELECT count(*) AS n_chunks, coalesce(sum(size), 0)::BIGINT AS n_bytes FROM chunks WHERE hash NOT IN (SELECT chunk_hash FROM rest)")
def gc_dry_run(spark, sf):
    return verify.reclaimable(T.chunks(spark, sf), _without_first(spark, sf)["file_chunks"])


@query("files file_chunks chunks", "SELECT DISTINCT chunk_hash AS hash FROM file_chunks WHERE file_id LIKE 's1:%' AND chunk_hash IN (SELECT chunk_hash FROM file_chunks WHERE file_id LIKE 's2:%')")
def existing_chunks(spark, sf):
    rows = T.file_chunks(spark, sf).select("file_id", F.col("chunk_hash").alias("hash"))
    return verify.existing(rows.where("file_id like 's2:%'"), rows.where("file_id like 's1:%'"))


T.SQL["sides"] = "sides AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'to_remote' ELSE 'to_local' END AS direction, coalesce(a.total_size, b.total_size) AS total_size FROM (SELECT * FROM totals WHERE total_size >= 20000) a FULL JOIN (SELECT * FROM totals WHERE created_at < TIMESTAMP '1996-01-01') b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL)"


def _sides(spark, sf):
    rows = _totals(spark, sf)
    return verify.sync_difference(rows.where("total_size >= 20000"), rows.where("created_at < timestamp_ntz'1996-01-01'"))


@query("m_file_chunks m_files m_snapshots totals sides", "SELECT * FROM sides")
def sync_diff(spark, sf):
    return _sides(spark, sf)


@query("m_file_chunks m_files m_snapshots totals sides", "SELECT direction, count(*) AS n, sum(total_size)::BIGINT AS n_bytes FROM sides GROUP BY 1")
def sync_totals(spark, sf):
    return verify.sync_totals(_sides(spark, sf))


@query(
    "m_chunks m_file_chunks",
    """, seen AS (SELECT l_partkey::VARCHAR AS hash, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1)
SELECT hash, size, least(a, TIMESTAMP '1995-06-01') AS first_seen, greatest(b, TIMESTAMP '1995-06-01') AS last_accessed FROM m_chunks JOIN seen USING (hash)
UNION ALL SELECT hash, size, TIMESTAMP '1995-06-01', TIMESTAMP '1995-06-01' FROM m_chunks WHERE hash NOT IN (SELECT hash FROM seen)""",
)
def upsert_chunks(spark, sf):
    when = F.lit("1995-06-01 00:00:00").cast("timestamp_ntz")
    old = T.m_chunks(spark, sf).select("hash", "size", when.alias("first_seen"), when.alias("last_accessed"))
    items = T.read(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("hash"), F.lit(0).cast("long").alias("size"), F.col("l_shipdate").alias("first_seen"), F.col("l_shipdate").alias("last_accessed"))
    return snapshots.upsert_chunks(old, items)


@query("files file_chunks rest", "SELECT 's2' AS snapshot_id, (SELECT count(*) FROM files WHERE snapshot_id = 's2') AS n_files, count(*) AS n_chunk_rows FROM rest")
def delete_snapshot_cascade(spark, sf):
    left = _without_first(spark, sf)
    n = left["files"].groupBy("snapshot_id").agg(F.count("*").alias("n_files"))
    return n.join(left["file_chunks"].agg(F.count("*").alias("n_chunk_rows")))


@query("m_file_chunks m_files", "SELECT id, snapshot_id, CASE WHEN size > 5000 THEN size + 1 ELSE size END AS size FROM m_files")
def update_file(spark, sf):
    rows = T.m_files(spark, sf)
    new = rows.where("size > 5000").withColumn("size", F.col("size") + 1)
    lists = T.m_file_chunks(spark, sf)
    return snapshots.update_files(rows, lists, new, lists.join(new.select(F.col("id").alias("file_id")), "file_id", "left_semi"))[0].select("id", "snapshot_id", "size")


@query("m_file_chunks m_files", "SELECT file_id, chunk_order, chunk_hash FROM m_file_chunks WHERE file_id NOT IN (SELECT id FROM m_files WHERE size > 5000)")
def delete_file(spark, sf):
    rows = T.m_files(spark, sf)
    return snapshots.delete_files(rows, T.m_file_chunks(spark, sf), rows.where("size > 5000").select("id"))[1].select("file_id", "chunk_order", "chunk_hash")


@query(
    "m_file_chunks m_files m_chunks m_snapshots",
    """SELECT 'file_without_snapshot' AS rule, id AS key FROM m_files WHERE size <= 9000 AND snapshot_id IN (SELECT id FROM m_snapshots WHERE created_at >= TIMESTAMP '1997-01-01')
UNION ALL SELECT 'chunk_row_without_file', file_id FROM m_file_chunks WHERE file_id IN (SELECT id FROM m_files WHERE size > 9000)
UNION ALL SELECT 'chunk_row_without_chunk', chunk_hash FROM m_file_chunks WHERE chunk_hash IN (SELECT hash FROM m_chunks WHERE size > 45)""",
)
def fk_violations(spark, sf):
    files, chunks = T.m_files(spark, sf).where("size <= 9000"), T.m_chunks(spark, sf).where("size <= 45")
    return snapshots.missing_parents(files, T.m_snapshots(spark, sf).where("created_at < timestamp_ntz'1997-01-01'"), T.m_file_chunks(spark, sf), chunks)


@query("m_file_chunks m_files", "SELECT 'hash_filled' AS rule, id AS key FROM m_files WHERE size = 0 UNION ALL SELECT 'snapshot_filled', id FROM m_files WHERE size > 9000")
def row_violations(spark, sf):
    rows = T.m_files(spark, sf).withColumn("file_hash", F.when(F.col("size") > 0, "h")).withColumn("snapshot_id", F.when(F.col("size") > 9000, " ").otherwise(F.col("snapshot_id")))
    return model.violations(rows, "files")


# Column functions


@query(
    "files file_chunks",
    """SELECT file_id, chunk_order, length(h) = 64 AND offset_ >= 0 AND chunk_size > 0 AND offset_ + chunk_size <= size AND length(path) > 0 AND length(path) <= 4096 AS valid, offset_ + chunk_size >= size AS is_last
FROM (SELECT c.*, f.size, f.path, CASE WHEN chunk_hash LIKE 'a%' THEN substr(chunk_hash, 2) ELSE chunk_hash END AS h, chunk_order::BIGINT * 4096 + CASE WHEN chunk_hash LIKE 'b%' THEN 1 ELSE 0 END AS offset_ FROM file_chunks c JOIN files f ON f.id = c.file_id)""",
)
def message_validity(spark, sf):
    c = F.col
    rows = T.file_chunks(spark, sf).join(T.files(spark, sf).select(c("id").alias("file_id"), "size", "path"), "file_id")
    first = F.left("chunk_hash", F.lit(1))
    offset = X.chunk_offset(c("chunk_order"), T.K) + F.when(first == "b", 1).otherwise(0)
    digest = F.when(first == "a", F.substring("chunk_hash", 2, 64)).otherwise(c("chunk_hash"))
    rows = rows.select("file_id", "chunk_order", "chunk_size", "size", "path", offset.alias("offset"), digest.alias("h"))
    return rows.select("file_id", "chunk_order", X.valid_chunk_message(c("h"), c("offset"), c("chunk_size"), c("size"), c("path")).alias("valid"), X.is_last_chunk(c("offset"), c("chunk_size"), c("size")).alias("is_last"))


@query(
    "",
    """SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS fixed
FROM (SELECT o_orderkey, (o_totalprice * o_totalprice / 16)::BIGINT AS b FROM orders)""",
)
def format_sizes(spark, sf):
    size = F.rint(F.col("o_totalprice") * F.col("o_totalprice") / 16).cast("long")
    return T.read(spark, sf, "orders").select("o_orderkey", X.format_size_fixed(size).alias("fixed"))


@query(
    "",
    """SELECT p_partkey, CASE WHEN d > 0 THEN d || 'd ' || h || 'h ' || m || 'm ' || s || 's' WHEN h > 0 THEN h || 'h ' || m || 'm ' || s || 's' WHEN m > 0 THEN m || 'm ' || s || 's' ELSE s || 's' END AS uptime
FROM (SELECT p_partkey, t // 86400 AS d, t // 3600 % 24 AS h, t // 60 % 60 AS m, t % 60 AS s FROM (SELECT p_partkey, p_size * p_size * p_partkey AS t FROM part))""",
)
def format_uptime(spark, sf):
    return T.read(spark, sf, "part").select("p_partkey", X.format_uptime(F.col("p_size") * F.col("p_size") * F.col("p_partkey")).alias("uptime"))


@query("", "SELECT p_partkey, CASE WHEN length(p_name) > 10 THEN substr(p_name, 1, 7) || '...' ELSE coalesce(p_name, '') END AS short FROM part")
def truncate_names(spark, sf):
    return T.read(spark, sf, "part").select("p_partkey", X.truncate(F.col("p_name"), 10).alias("short"))


@query("", "SELECT event_id, (epoch_us(ts) // 1000)::BIGINT AS ms, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def timestamps(spark, sf):
    ts = F.to_utc_timestamp(F.col("ts").cast("string"), "UTC")
    return T.read(spark, sf, "events").select("event_id", X.to_millis(X.from_millis(X.to_millis(ts))).alias("ms"), X.display_date(ts).alias("shown"))


@query("", "SELECT p_partkey, least(1000 * pow(1.5, p_size), 60000) AS backoff_ms, round(p_size * 100.0 / (p_size + 1000), 6) AS loss, CASE WHEN p_retailprice <= 0 THEN 0 ELSE least(100.0, p_size * 100.0 / p_retailprice) END AS progress FROM part")
def backoff_and_loss(spark, sf):
    c = F.col
    return T.read(spark, sf, "part").select("p_partkey", X.backoff_ms(c("p_size")).alias("backoff_ms"), F.round(X.loss_percent(c("p_size")), 6).alias("loss"), X.progress(c("p_size"), c("p_retailprice")).alias("progress"))


@query("files", "SELECT snapshot_id, to_json({'id': snapshot_id, 'n': count(*), 'bytes': sum(size)::BIGINT})::VARCHAR AS status FROM files GROUP BY 1")
def status_json(spark, sf):
    rows = T.files(spark, sf).groupBy("snapshot_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return rows.select("snapshot_id", F.to_json(F.struct(F.col("snapshot_id").alias("id"), "n", "bytes")).alias("status"))


# Transfers, scans, benchmarks, profiles

T.SQL["per_transfer"] = "per_transfer AS (SELECT transfer_id, sum(bytes)::BIGINT AS bytes, max(bytes)::BIGINT * 4 AS size, min((epoch_us(ts) // 1000)) AS start_ms, max((epoch_us(ts) // 1000)) AS update_ms FROM transfers GROUP BY 1)"


@query(
    "transfers per_transfer",
    """SELECT transfer_id, round(CASE WHEN size <= 0 THEN 0 ELSE least(100.0, 100.0 * bytes / size) END, 6) AS progress, round(CASE WHEN ms <= 0 THEN 0 ELSE bytes * 1000.0 / ms END, 6) AS rate,
  round(CASE WHEN bytes <= 0 THEN 0 ELSE ms::DOUBLE / bytes * (size - bytes) END, 2) AS time_left_ms, round(CASE WHEN ms = 0 THEN 0 ELSE bytes / 1048576.0 / (ms / 1000.0) END, 6) AS throughput FROM (SELECT *, update_ms - start_ms AS ms FROM per_transfer)""",
)
def transfer_rates(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = T.transfers(spark, sf).groupBy("transfer_id").agg(F.sum("bytes").alias("bytes"), (F.max("bytes") * 4).alias("size"), F.min(ms).alias("start_ms"), F.max(ms).alias("update_ms"))
    return metrics.transfer_rates(rows)


@query("transfers", "SELECT transfer_id, last(state ORDER BY ts, event_id) AS state, last(event_id ORDER BY ts, event_id) AS event_id, count(*) AS n_events, sum(bytes)::BIGINT AS bytes, count(*) FILTER (state = 'FAILED') AS n_failures FROM transfers GROUP BY 1")
def transfer_last_state(spark, sf):
    return metrics.last_states(T.transfers(spark, sf))


@query("transfers", "SELECT state, count(*) AS n_messages, sum(bytes)::BIGINT AS n_bytes, round(sum(bytes) * 1000.0 / (SELECT max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000)) FROM transfers), 6) AS rate FROM transfers GROUP BY 1")
def transfer_counters(spark, sf):
    return metrics.network_counters(T.transfers(spark, sf))


@query("transfers", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, state, count(*) AS n_messages, sum(bytes)::BIGINT AS n_bytes FROM transfers GROUP BY 1, 2")
def daily_counters(spark, sf):
    return metrics.daily_counters(T.transfers(spark, sf))


_RUNS = """runs AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Throughput small' WHEN '2-HIGH' THEN 'Scalability run' WHEN '3-MEDIUM' THEN 'network tcp' WHEN '4-NOT SPECIFIED' THEN 'Deduplication' ELSE 'misc' END AS name,
  o_orderkey, o_totalprice / 1000 AS throughput, o_custkey::DOUBLE AS memory FROM orders)"""
T.SQL["runs"] = _RUNS
T.SQL["classed"] = "classed AS (SELECT *, CASE WHEN lower(name) LIKE '%throughput%' THEN 'Throughput' WHEN lower(name) LIKE '%scalability%' THEN 'Scalability' WHEN lower(name) LIKE '%network%' THEN 'Network' WHEN lower(name) LIKE '%deduplication%' THEN 'Deduplication' WHEN lower(name) LIKE '%concurrency%' THEN 'Concurrency' ELSE 'Other' END AS class FROM runs)"


def _runs(spark, sf):
    names = {"1-URGENT": "Throughput small", "2-HIGH": "Scalability run", "3-MEDIUM": "network tcp", "4-NOT SPECIFIED": "Deduplication"}
    name = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("o_orderpriority")), F.lit("misc"))
    return T.read(spark, sf, "orders").select("o_orderkey", name.alias("name"), (F.col("o_totalprice") / 1000).alias("throughput"), F.col("o_custkey").cast("double").alias("memory"))


@query("runs classed", "SELECT class, round(avg(throughput), 6) AS avg_throughput, round(avg(memory), 6) AS avg_memory, count(*) AS n FROM classed GROUP BY 1")
def benchmark_summary(spark, sf):
    return metrics.benchmark_summary(_runs(spark, sf))


@query("runs classed", "SELECT class, count(*) FILTER (throughput >= 150) AS met, count(*) AS total, round(100.0 * count(*) FILTER (throughput >= 150) / count(*), 6) AS percent FROM classed GROUP BY 1")
def target_assessment(spark, sf):
    return metrics.target_assessment(_runs(spark, sf), 150)


@query("runs", "SELECT name, o_orderkey, throughput FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o_orderkey) AS n FROM runs) WHERE n = 1")
def benchmark_first_of_name(spark, sf):
    return metrics.first_of_name(_runs(spark, sf), ["o_orderkey"]).select("name", "o_orderkey", "throughput")


@query("runs", "SELECT name, count(*) AS n, max(throughput) AS best FROM runs WHERE throughput >= 100 GROUP BY 1")
def benchmark_with_metric(spark, sf):
    rows = _runs(spark, sf).withColumn("metrics", F.when(F.col("throughput") >= 100, F.create_map(F.lit("throughput"), "throughput")).otherwise(F.create_map(F.lit("memory"), "memory")))
    return metrics.with_metric(rows, "throughput").groupBy("name").agg(F.count("*").alias("n"), F.max("throughput").alias("best"))


@query("", "SELECT p_partkey::VARCHAR AS name, round(p_size / p_retailprice, 6) AS incremental_ratio, round(p_retailprice / (4 * p_size), 6) AS concurrency_efficiency, round(100 * (1 - p_retailprice / (4 * p_size)), 6) AS contention_percent FROM part")
def benchmark_efficiency(spark, sf):
    c = F.col
    return metrics.efficiency(T.read(spark, sf, "part").select(c("p_partkey").cast("string").alias("name"), c("p_retailprice").alias("first_ms"), c("p_size").alias("later_ms"), c("p_retailprice").alias("serial_ms"), F.lit(4).alias("workers"), c("p_size").alias("parallel_ms")))


@query("", "SELECT round(avg(value), 6) AS avg_cpu, max(value) AS peak_cpu, round(avg(user_id), 6) AS avg_heap, max(user_id) AS peak_heap, max(event_id) AS gc_ms, round(100.0 * max(event_id) / (max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000))), 6) AS gc_percent, max(user_id) AS peak_threads FROM events")
def profiler_summary(spark, sf):
    c = F.col
    return metrics.profiler_summary(T.read(spark, sf, "events").select("ts", c("value").alias("cpu"), c("user_id").alias("heap"), c("event_id").alias("gc_ms"), c("user_id").alias("threads")))


@query("m_file_chunks m_files", "SELECT count(*) FILTER (size > 0) AS n_files, count(*) FILTER (size = 0) AS n_errors, coalesce(sum(size) FILTER (size > 0), 0)::BIGINT AS n_bytes FROM m_files")
def scan_totals(spark, sf):
    return metrics.scan_totals(T.m_files(spark, sf).withColumn("error", F.when(F.col("size") == 0, "empty")))


@query("m_file_chunks m_files", "SELECT count(*) FILTER (size > 5000) AS processed, count(*) FILTER (size > 0 AND size <= 5000) AS skipped, count(*) FILTER (size = 0) AS failed, sum(size)::BIGINT AS total_bytes, coalesce(sum(size) FILTER (size > 5000), 0)::BIGINT AS processed_bytes, round(100.0 * coalesce(sum(size) FILTER (size > 5000), 0) / sum(size), 6) AS percent FROM m_files")
def processing_counters(spark, sf):
    rows = T.m_files(spark, sf)
    return metrics.processing_counters(rows.withColumns({"is_regular": F.col("size") > 5000, "error": F.when(F.col("size") == 0, "empty")}))


@query("m_file_chunks m_files", "SELECT 'started' AS event, NULL AS path, NULL::BIGINT AS size UNION ALL SELECT CASE WHEN size = 0 THEN 'error' ELSE 'file' END, path, size FROM m_files UNION ALL SELECT 'completed', NULL, sum(size)::BIGINT FROM m_files")
def scan_events(spark, sf):
    return metrics.scan_events(T.m_files(spark, sf).withColumn("error", F.when(F.col("size") == 0, "empty")))


@query("files", "SELECT b.path, b.size FROM files b LEFT JOIN files a ON a.path = b.path AND a.snapshot_id = 's1' WHERE b.snapshot_id = 's2' AND (a.path IS NULL OR a.size <> b.size OR a.modified_ms <> b.modified_ms)")
def incremental_changes(spark, sf):
    rows = T.files(spark, sf)
    return snapshots.changed_since(rows.where("snapshot_id = 's1'"), rows.where("snapshot_id = 's2'")).select("path", "size")


@query("m_file_chunks m_files m_snapshots totals", "SELECT id FROM totals WHERE NOT (regexp_matches(name, '^customer-[^/]*1$') AND created_at < TIMESTAMP '1996-01-01')")
def batch_delete(spark, sf):
    rows = _totals(spark, sf)
    gone = snapshots.filtered(rows, name="customer-*1").where("created_at < timestamp_ntz'1996-01-01'")
    return snapshots.deletable(rows, gone).select("id")


@query("files file_chunks status", "SELECT status, count(*) AS n FROM status WHERE file_id IN (SELECT id FROM files WHERE regexp_matches(path, '^/fr/.*$')) GROUP BY 1")
def verify_by_pattern(spark, sf):
    wanted = T.files(spark, sf).where(selected(F.col("path"), "/fr/**")).select(F.col("id").alias("file_id"))
    rows = T.file_chunks(spark, sf).join(wanted, "file_id", "left_semi")
    return verify.chunk_status(rows, T.blobs(spark, sf, faulty=True)).groupBy("status").agg(F.count("*").alias("n"))


def stream_source(spark, sf):
    """The transfer events as a stream over the table's file."""
    schema = T.read(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events*.parquet")
    state = F.element_at(F.create_map(*(F.lit(x) for kv in T.STATES.items() for x in kv)), F.col("event_type"))
    return raw.select("event_id", F.col("user_id").alias("transfer_id"), F.col("ts").cast("timestamp").alias("ts"), state.alias("state"), F.floor(F.col("value") * 1024).cast("long").alias("bytes"))


@query("transfers", "SELECT state, count(*) AS n_messages, sum(bytes)::BIGINT AS n_bytes FROM transfers GROUP BY 1")
def stream_counters(spark, sf):
    from chunkwright.streaming import transfers

    return _finished(spark, transfers.running_counters(stream_source(spark, sf)), "complete")


def _finished(spark, stream, mode, keys=()):
    """The rows of a stream over all that is there now: in update mode the last of each key, in append mode all."""
    home = _home(spark, "stream")

    def keep(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/batch={number:08d}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{home}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{home}/batch=*")
    if mode == "append":
        return found
    if mode == "update":
        batch = F.regexp_extract("_metadata.file_path", "batch=([0-9]+)", 1)
        return found.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in found.columns if c not in keys)), batch).alias("_r")).select(*keys, "_r.*")
    last = found.select(F.max(F.regexp_extract("_metadata.file_path", "batch=([0-9]+)", 1)).alias("b")).first().b
    return spark.read.parquet(f"{home}/batch={last}")


@query("files file_chunks chunks", "SELECT hash, size FROM chunks")
def stream_ingest_dedup(spark, sf):
    """Chunks written as a stream's files, ingested twice; the store has each once."""
    from chunkwright.sources.store import Store
    from chunkwright.streaming.ingest import ingest_stream

    home = _home(spark, "ingest")
    rows = T.file_chunks(spark, sf, keep_content=True).select(F.col("chunk_hash").alias("hash"), F.col("chunk_size").cast("long").alias("size"), "content")
    rows.write.parquet(f"{home}/in")
    store = Store(spark, f"{home}/store")
    for k in range(2):
        ingest_stream(spark.readStream.schema(rows.schema).parquet(f"{home}/in"), store, f"{home}/checkpoint-{k}").awaitTermination()
    return store.table("chunks").select("hash", "size")




# Through the store


def _home(spark, name):
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _ranges(spark, sf, size):
    """The files of snapshot s2 as (path, modified_time, chunk_order, content) in ranges of ``size`` bytes."""
    rows = T.files(spark, sf).where("snapshot_id = 's2'").select("path", F.timestamp_millis("modified_ms").alias("modified_time"), F.encode("body", "UTF-8").alias("b"))
    n = F.greatest(F.ceil(F.octet_length("b") / size), F.lit(1)).cast("int")
    rows = rows.withColumn("chunk_order", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select("path", "modified_time", "chunk_order", F.substring(F.col("b"), F.col("chunk_order") * size + 1, F.lit(size)).alias("content"))


def _stored(spark, sf, name="s2"):
    from chunkwright.sources.store import Store

    store = Store(spark, _home(spark, "store"))
    store.ingest(name, _ranges(spark, sf, 2 * T.K), chunk=T.K, range_bytes=2 * T.K)
    return store


@query("files", "SELECT id, snapshot_id, path, size, file_hash FROM files WHERE snapshot_id = 's2'")
def store_ingest_files(spark, sf):
    """Files that come in ranges: sizes and whole-file hashes as recorded by the store."""
    rows = _stored(spark, sf).table("files")
    return rows.select(F.concat(F.lit("s2:"), F.regexp_extract("path", r"([0-9]+)\.txt$", 1)).alias("id"), "snapshot_id", "path", "size", "file_hash")


@query("files file_chunks", "SELECT f.path, chunk_order, chunk_size, chunk_hash FROM file_chunks JOIN files f ON f.id = file_id WHERE file_id LIKE 's2:%'")
def store_ingest_chunk_lists(spark, sf):
    store = _stored(spark, sf)
    rows = store.table("file_chunks").join(store.table("files").select(F.col("id").alias("file_id"), "path"), "file_id")
    return rows.select("path", "chunk_order", "chunk_size", "chunk_hash")


@query("files file_chunks", "SELECT DISTINCT chunk_hash AS hash, chunk_size::BIGINT AS size, true AS sound FROM file_chunks WHERE file_id LIKE 's2:%'")
def store_blobs_sound(spark, sf):
    """Each distinct chunk is stored once, and its content has its hash."""
    return _stored(spark, sf).table("blobs").select("hash", F.octet_length("content").cast("long").alias("size"), (F.sha2("content", 256) == F.col("hash")).alias("sound"))


@query("files file_chunks", "SELECT chunk_hash AS hash, max(chunk_size)::BIGINT AS size FROM file_chunks WHERE file_id LIKE 's2:%' AND chunk_hash NOT LIKE 'a%' GROUP BY 1")
def store_delete_and_collect(spark, sf):
    """The chunk table once no file has chunks whose hash starts with a, and orphans are collected."""
    store = _stored(spark, sf)
    store.commit(replaced={"file_chunks": store.table("file_chunks").where("chunk_hash not like 'a%'")})
    store.collect_garbage()
    return store.table("chunks").select("hash", "size")


@query("files", "SELECT path, size, modified_ms, file_hash FROM files WHERE snapshot_id = 's2'")
def store_incremental_ingest(spark, sf):
    """A second snapshot of the same files, of which only those of one language are read again; the rest is carried over."""
    store = _stored(spark, sf)
    now = store.table("files").select("path", (F.col("size") + F.when(F.col("path").like("/fr/%"), 1).otherwise(0)).alias("size"), "modified_time")
    body = _ranges(spark, sf, 2 * T.K).select("path", "chunk_order", "content")
    store.ingest_changes("again", "s2", now, lambda new: body.join(new.select("path"), "path", "left_semi"), chunk=T.K, range_bytes=2 * T.K)
    rows = store.table("files").where("snapshot_id = 'again'")
    return rows.select("path", "size", F.unix_millis("modified_time").alias("modified_ms"), "file_hash")


@query("files", "SELECT id, path, size, file_hash FROM files WHERE id = 's2:4'")
def file_by_id(spark, sf):
    return snapshots.find(T.files(spark, sf), "id", "s2:4").select("id", "path", "size", "file_hash")


@query(
    "",
    """SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' ELSE regexp_replace(printf('%.1f', b / CASE WHEN b < 1048576 THEN 1024 ELSE 1048576 END), '[.]0$', '') || CASE WHEN b < 1048576 THEN ' KB' ELSE ' MB' END END AS shown
FROM (SELECT o_orderkey, o_custkey * 512 AS b FROM orders WHERE o_custkey * 512 < 1024000)""",
)
def format_sizes_short(spark, sf):
    size = F.col("o_custkey") * 512
    return T.read(spark, sf, "orders").where(size < 1_024_000).select("o_orderkey", X.format_size(size).alias("shown"))


@query("", "SELECT p_partkey, round(p_partkey / (p_size / 1000.0), 6) AS per_second, p_partkey - p_size AS round_trip_ms FROM part")
def operations_and_round_trips(spark, sf):
    c = F.col
    return T.read(spark, sf, "part").select("p_partkey", F.round(X.operations_per_second(c("p_partkey"), c("p_size")), 6).alias("per_second"), X.round_trip(c("p_size"), c("p_partkey")).alias("round_trip_ms"))


@query("files", "SELECT 's1' AS hash, path FROM files WHERE snapshot_id = 's1'")
def index_round_trip(spark, sf):
    """Index lines written to a file and read back."""
    from chunkwright.sources import indexfile

    path = _home(spark, "index")
    indexfile.write_index(T.files(spark, sf).where("snapshot_id = 's1'").select(F.col("snapshot_id").alias("hash"), "path"), path)
    return indexfile.read_index(spark, path)


@query("m_snapshots", "SELECT id, name FROM m_snapshots WHERE created_at >= (SELECT max(created_at) FROM m_snapshots) - INTERVAL 30 DAY")
def snapshots_of_last_days(spark, sf):
    return snapshots.of_last_days(T.m_snapshots(spark, sf), 30).select("id", "name")


@query("runs", "SELECT name, count(*) AS n FROM runs WHERE contains(lower(name), 'run') GROUP BY 1")
def benchmark_name_contains(spark, sf):
    return metrics.named_like(_runs(spark, sf), "RUN").groupBy("name").agg(F.count("*").alias("n"))


# Streams of transfers


@query(
    "transfers",
    """, r AS (SELECT *, row_number() OVER (PARTITION BY transfer_id ORDER BY ts, event_id) AS k FROM transfers),
e AS (SELECT *, min(k) FILTER (state IN ('COMPLETED', 'FAILED', 'CANCELLED')) OVER (PARTITION BY transfer_id) AS stop, min(k) FILTER (state = 'IN_PROGRESS') OVER (PARTITION BY transfer_id) AS begun FROM r),
a AS (SELECT *, state IS NOT NULL AND k <= coalesce(stop, k) AND NOT (state = 'PENDING' AND k > coalesce(begun, k)) AS applied FROM e)
SELECT transfer_id, coalesce(arg_max(state, k) FILTER (applied), 'PENDING') AS state, coalesce(sum(bytes) FILTER (applied), 0)::BIGINT AS bytes, count(*) FILTER (applied) AS n_applied FROM a GROUP BY 1""",
)
def stream_transfer_states(spark, sf):
    """The state machine of each transfer: events that may not follow its state are passed over."""
    from chunkwright.streaming import transfers

    return _finished(spark, transfers.states(stream_source(spark, sf)), "update", ["transfer_id"])


@query("transfers", "SELECT DISTINCT transfer_id, bytes // 1024 AS chunk FROM transfers")
def stream_acknowledged_once(spark, sf):
    """Acknowledgements of a chunk of a transfer, each once."""
    from chunkwright.streaming import transfers

    acks = stream_source(spark, sf).select("transfer_id", F.expr("bytes div 1024").alias("offset"), "ts", (F.col("state") != "FAILED").alias("ok"))
    return _finished(spark, transfers.acknowledged_once(acks).select("transfer_id", F.col("offset").alias("chunk")), "append")


@query("transfers", "SELECT strftime(ts, '%Y-%m-%d') AS day, state, count(*) AS n_messages, sum(bytes)::BIGINT AS n_bytes FROM transfers GROUP BY 1, 2")
def stream_daily_counters(spark, sf):
    """Messages and bytes by window of a day, with a watermark."""
    from chunkwright.streaming import transfers

    counters = transfers.windowed_counters(stream_source(spark, sf))
    return _finished(spark, counters.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "state", "n_messages", "n_bytes"), "update", ["day", "state"])


# More through the store


@query("files", "SELECT path, size, file_hash FROM files WHERE snapshot_id = 's2'")
def store_restore_and_scan(spark, sf):
    """Files restored from the store to a directory, which is then scanned and read in ranges. The shared folder must be a mounted one."""
    from chunkwright.operators.chunking import hash_ranges
    from chunkwright.sources import restore

    store = _stored(spark, sf)
    target = _home(spark, "tree").removeprefix("file:")
    restore.restore(store, "s2", target)
    rows = fsscan.scan(spark, target)
    hashes = hash_ranges(fsscan.contents(rows, target, range_bytes=2 * T.K).withColumnRenamed("path", "file_id"))
    return rows.join(hashes.withColumnRenamed("file_id", "path"), "path").select(F.concat(F.lit("/"), "path").alias("path"), "size", "file_hash")


@query("files file_chunks", "SELECT DISTINCT chunk_hash AS hash, chunk_hash LIKE 'a%' AS touched FROM file_chunks WHERE file_id LIKE 's2:%'")
def store_touch(spark, sf):
    store = _stored(spark, sf)
    store.touch(store.table("chunks").where("hash like 'a%'").select("hash"))
    return store.table("chunks").select("hash", (F.col("last_accessed") > F.col("first_seen")).alias("touched"))


@query("files file_chunks", "SELECT chunk_hash AS hash, max(chunk_size)::BIGINT AS size FROM file_chunks WHERE file_id LIKE 's2:%' GROUP BY 1")
def store_repair(spark, sf):
    """Chunk rows that were lost come back from their blobs."""
    store = _stored(spark, sf)
    store.commit(replaced={"chunks": store.table("chunks").where("hash not like 'a%'")})
    store.repair()
    return store.table("chunks").select("hash", "size")


@query("files file_chunks", "SELECT chunk_hash AS hash, max(chunk_size)::BIGINT AS size, true AS sound FROM file_chunks WHERE file_id LIKE 's2:%' GROUP BY 1 ORDER BY 1 LIMIT 1")
def store_chunk_by_hash(spark, sf):
    store = _stored(spark, sf)
    least = store.table("chunks").agg(F.min("hash")).first()[0]
    return store.get(least).select("hash", F.octet_length("content").cast("long").alias("size"), "sound")


@query("files file_chunks", "SELECT chunk_hash AS hash, max(chunk_size)::BIGINT AS size FROM file_chunks WHERE file_id LIKE 's2:%' GROUP BY 1 ORDER BY 1 OFFSET 1")
def store_delete_chunk(spark, sf):
    store = _stored(spark, sf)
    store.delete_chunk(store.table("chunks").agg(F.min("hash")).first()[0])
    return store.table("blobs").select("hash", F.octet_length("content").cast("long").alias("size"))
