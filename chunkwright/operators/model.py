"""Table schemas and row checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "snapshots": "id string, name string, created_at timestamp, description string",
    "files": "id string, snapshot_id string, path string, size long, modified_time timestamp, file_hash string",
    "file_chunks": "file_id string, chunk_hash string, chunk_order int, chunk_size int",
    "chunks": "hash string, size long, first_seen timestamp, last_accessed timestamp",
    "blobs": "hash string, content binary",
}
VERSION = 2


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[table])


def fits(df: DataFrame, table: str) -> bool:
    """Same column names and types, in any order."""
    return {(f.name, f.dataType) for f in df.schema} == {(f.name, f.dataType) for f in schema(table)}




def rules(table: str) -> tuple[str, dict[str, Column]]:
    c = F.col

    def filled(name: str) -> Column:
        return F.coalesce(F.trim(c(name)) != "", F.lit(False))

    def counted(name: str) -> Column:
        return F.coalesce(c(name) >= 0, F.lit(False))

    return {
        "snapshots": ("id", {"id_filled": filled("id"), "name_filled": filled("name")}),
        "files": ("id", {"id_filled": filled("id"), "snapshot_filled": filled("snapshot_id"), "path_filled": filled("path"), "size_counted": counted("size"), "hash_filled": filled("file_hash")}),
        "file_chunks": ("file_id", {"hash_filled": filled("chunk_hash"), "order_counted": counted("chunk_order"), "size_counted": counted("chunk_size")}),
        "chunks": ("hash", {"hash_filled": filled("hash"), "size_counted": counted("size")}),
    }[table]


def violations(df: DataFrame, table: str) -> DataFrame:
    """(rule, key) of each row that breaks a rule; one pass over the table."""
    key, checks = rules(table)
    broken = F.filter(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks.items())), lambda x: x.isNotNull())
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))
