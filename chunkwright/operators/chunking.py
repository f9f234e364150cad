"""Fixed-size chunking and hashing of bodies, wholly within generated code."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.functions import scalars as X

CHUNK = 65_536
Chunker = Callable[[DataFrame], DataFrame]


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def chunks_of(files: DataFrame, content: Column, keys: list[str], *, chunk: int = CHUNK, digest: Callable[[Column], Column] = sha256, keep_content: bool = False) -> DataFrame:
    """One row for each chunk: ``keys``, chunk_order, chunk_size, chunk_hash (and content).

    An empty body has no chunks. Chunks are exact byte slices; the last one may be shorter.
    """
    body = files.select(*keys, content.alias("_body"))
    n = X.chunk_count(F.octet_length("_body"), chunk)
    at = body.where(F.octet_length("_body") > 0).select("*", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("chunk_order"))
    piece = F.substring(F.col("_body"), F.col("chunk_order") * chunk + 1, F.lit(chunk))
    at = at.select(*keys, "chunk_order", piece.alias("content"))
    out = at.select(*keys, "chunk_order", F.octet_length("content").cast("int").alias("chunk_size"), digest(F.col("content")).alias("chunk_hash"), "content")
    return out if keep_content else out.drop("content")


def fixed_size(chunk: int = CHUNK) -> Chunker:
    """A chunker gives each row with a ``_body`` one row a piece: its number ``k`` from 0 and its bytes ``content``, in order and
    without gaps. An empty or null body gives one row whose content is null. This one cuts pieces of ``chunk`` bytes."""

    def cut(rows: DataFrame) -> DataFrame:
        empty = F.coalesce(F.octet_length("_body"), F.lit(0)) == 0
        n = F.when(empty, 1).otherwise(X.chunk_count(F.octet_length("_body"), chunk)).cast("int")
        piece = F.when(~empty, F.substring(F.col("_body"), F.col("k") * chunk + 1, F.lit(chunk)))
        return rows.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("content", piece)

    return cut


def file_hashes(files: DataFrame, content: Column, keys: list[str], *, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    return files.select(*keys, F.octet_length(content).cast("long").alias("size"), digest(content).alias("file_hash"))


def hash_ranges(ranges: DataFrame) -> DataFrame:
    """(file_id, file_hash) of files too large for one row, from their ranges (file_id, chunk_order, content).

    A hash over a whole file is sequential, so a file's ranges are streamed in order through one
    task, a range at a time.
    """
    import hashlib

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        now, state = None, None
        for batch in batches:
            done = []
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                if state is None or file_id != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = file_id, hashlib.sha256()
                state.update(content)
            if done:
                yield pd.DataFrame(done, columns=["file_id", "file_hash"])
        if state is not None:
            yield pd.DataFrame([(now, state.hexdigest())], columns=["file_id", "file_hash"])

    ordered = ranges.select("file_id", "chunk_order", "content").repartition("file_id").sortWithinPartitions("file_id", "chunk_order")
    return ordered.mapInPandas(run, "file_id string, file_hash string")
