"""The driver's tables seen as snapshot tables, and the same as SQL.

``documents`` make two snapshots: the first lacks one source, the second another, and German texts
have changed in the second. ``orders``, ``lineitem`` and ``part`` make metadata at scale; ``events`` make transfers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkwright.operators.chunking import chunks_of

K = 4096
STATES = {"signup": "PENDING", "view": "IN_PROGRESS", "click": "IN_PROGRESS", "purchase": "COMPLETED", "error": "FAILED"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession) -> DataFrame:
    rows = [("s1", "s1", 1704067200000, "first"), ("s2", "s2", 1704153600000, None)]
    return spark.createDataFrame(rows, "id string, name string, created_ms long, description string").select("id", "name", F.timestamp_millis("created_ms").alias("created_at"), "description")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, snapshot_id, path, size, modified_ms, file_hash, body)."""
    docs = read(spark, sf_dir, "documents")

    def snapshot(name: str, without: str, body) -> DataFrame:
        path = F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return docs.where(F.col("source") != without).select(
            F.concat(F.lit(f"{name}:"), F.col("doc_id").cast("string")).alias("id"),
            F.lit(name).alias("snapshot_id"),
            path.alias("path"),
            F.octet_length(body).cast("long").alias("size"),
            (F.lit(1704067200000) + F.col("doc_id") * 60000).alias("modified_ms"),
            F.sha2(body, 256).alias("file_hash"),
            body.alias("body"),
        )

    return snapshot("s1", "src3", F.col("text")).union(snapshot("s2", "src7", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))))


def file_chunks(spark: SparkSession, sf_dir: str, *, keep_content: bool = False) -> DataFrame:
    """(file_id, chunk_order, chunk_size, chunk_hash) of ``files``."""
    return chunks_of(files(spark, sf_dir).withColumnRenamed("id", "file_id"), F.encode("body", "UTF-8"), ["file_id"], chunk=K, keep_content=keep_content)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_chunks(spark, sf_dir).groupBy(F.col("chunk_hash").alias("hash")).agg(F.max("chunk_size").cast("long").alias("size"))


def blobs(spark: SparkSession, sf_dir: str, *, faulty: bool = False) -> DataFrame:
    """(hash, content). With ``faulty``, hashes that start with 0 are missing and those that start with 1 are corrupt."""
    rows = file_chunks(spark, sf_dir, keep_content=True).select(F.col("chunk_hash").alias("hash"), "content").dropDuplicates(["hash"])
    if faulty:
        broken = F.when(F.left("hash", F.lit(1)) == "1", F.concat("content", F.lit(b"?"))).otherwise(F.col("content"))
        rows = rows.where(F.left("hash", F.lit(1)) != "0").withColumn("content", broken)
    return rows


def m_file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    rows = read(spark, sf_dir, "lineitem").withColumn("chunk_order", F.row_number().over(order) - 1)
    return rows.select(F.col("l_orderkey").cast("string").alias("file_id"), F.col("l_partkey").cast("string").alias("chunk_hash"), "chunk_order", (F.col("l_quantity") * 64).cast("long").alias("chunk_size"))


def m_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = m_file_chunks(spark, sf_dir).groupBy(F.col("file_id").alias("id")).agg(F.sum("chunk_size").alias("size"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("snapshot_id"), F.concat(F.lit("/"), "o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"), "o_orderdate")
    return rows.join(sizes, "id", "left").withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))


def m_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("hash"), F.col("p_size").cast("long").alias("size"))


def m_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.min("o_orderdate").alias("created_at"))
    return rows.withColumn("name", F.concat(F.lit("customer-"), "id"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, transfer_id, ts, state, bytes)."""
    state = F.element_at(F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv)), F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("transfer_id"), "ts", state.alias("state"), F.floor(F.col("value") * 1024).cast("long").alias("bytes"))


SQL = {
    "snapshots": "snapshots AS (SELECT * FROM (VALUES ('s1', 's1', TIMESTAMP '2024-01-01 00:00:00', 'first'), ('s2', 's2', TIMESTAMP '2024-01-02 00:00:00', NULL)) t(id, name, created_at, description))",
    "files": """files AS (
  SELECT snapshot_id || ':' || doc_id AS id, snapshot_id, '/' || lang || '/' || source || '/' || doc_id || '.txt' AS path,
    octet_length(encode(body))::BIGINT AS size, 1704067200000 + doc_id * 60000 AS modified_ms, sha256(body) AS file_hash, body
  FROM (SELECT 's1' AS snapshot_id, doc_id, lang, source, text AS body FROM documents WHERE source <> 'src3'
    UNION ALL SELECT 's2', doc_id, lang, source, CASE WHEN lang = 'de' THEN text || '!' ELSE text END FROM documents WHERE source <> 'src7'))""",
    "file_chunks": f"""cut AS (SELECT id, size, hex(encode(body)) AS h, unnest(range(0, ceil(size / {K}.0)::BIGINT)) AS i FROM files),
file_chunks AS (SELECT id AS file_id, i::INTEGER AS chunk_order, least({K}, size - i * {K})::INTEGER AS chunk_size,
  sha256(unhex(substr(h, (i * {2 * K} + 1)::BIGINT, {2 * K}))) AS chunk_hash FROM cut)""",
    "chunks": "chunks AS (SELECT chunk_hash AS hash, max(chunk_size)::BIGINT AS size FROM file_chunks GROUP BY 1)",
    "m_file_chunks": """m_file_chunks AS (SELECT l_orderkey::VARCHAR AS file_id, l_partkey::VARCHAR AS chunk_hash, (l_quantity * 64)::BIGINT AS chunk_size,
  (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) - 1)::INTEGER AS chunk_order
  FROM lineitem)""",
    "m_files": """m_files AS (SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS snapshot_id, '/' || o_orderpriority || '/' || o_orderkey AS path, o_orderdate, coalesce(s.size, 0)::BIGINT AS size
  FROM orders LEFT JOIN (SELECT file_id, sum(chunk_size) AS size FROM m_file_chunks GROUP BY 1) s ON s.file_id = o_orderkey::VARCHAR)""",
    "m_chunks": "m_chunks AS (SELECT p_partkey::VARCHAR AS hash, p_size::BIGINT AS size FROM part)",
    "m_snapshots": "m_snapshots AS (SELECT o_custkey::VARCHAR AS id, min(o_orderdate) AS created_at, 'customer-' || o_custkey AS name FROM orders GROUP BY o_custkey)",
    "transfers": """transfers AS (SELECT event_id, user_id AS transfer_id, ts, floor(value * 1024)::BIGINT AS bytes,
  CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'IN_PROGRESS' WHEN 'click' THEN 'IN_PROGRESS' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END AS state FROM events)""",
}


def sql(names: str, body: str) -> str:
    """A query over fixtures named in the order in which they need each other."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
