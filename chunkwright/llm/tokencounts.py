"""Token counts kept by delta-maintained rollups.

A batch of signed changes (+1 inserts a document's count, -1 takes one away; a revision is
both) is summed by source, language and tokenizer version and committed under its
batch id. Totals are the sums of the compacted base and of the batches after it, so no document is read
again. A batch is written aside, as one file, and then renamed to its place, whose name is a hash of
the id; a batch id that is there already, or in the base, is left as it is, so that replayed or
repeated batches change nothing. ``compact`` sums what is there into a new base, which keeps the ids of
its batches. Any number of writers may commit; one at a time compacts.

Rows: a null or empty text has no tokens but counts as a document. Null sources and languages
are groups of their own. Repeated rows count one by one. An empty batch is committed as such.
Groups whose documents and tokens are all taken away again vanish from the totals. Any string is a
batch id.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwright.llm.textops import small_batches, utf8, word_bounds

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Fixed value: how the public byte-level vocabularies split a text into pieces.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Rollup:
    """Committed batches of signed counts in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path
        return place(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    @staticmethod
    def _file(batch: str) -> str:
        return f"batch-{hashlib.sha256(batch.encode()).hexdigest()}.parquet"

    def _state(self) -> tuple[str | None, list[str]]:
        """The latest base and the files of batches, of which some may be in the base already."""
        fs, place = self._fs()
        names = sorted(s.getPath().getName() for s in fs.listStatus(place(self.path))) if fs.exists(place(self.path)) else []
        return max((n for n in names if n.startswith("base-")), default=None), [n for n in names if n.startswith("batch-")]

    def _in_base(self, base: str | None, files: list[str]) -> set[str]:
        if not base or not files:
            return set()
        return {r.file for r in self.spark.read.schema("file string").parquet(f"{self.path}/{base}/files").where(F.col("file").isin(files)).collect()}

    def committed(self, batch: str) -> bool:
        base, files = self._state()
        return self._file(batch) in files or bool(self._in_base(base, [self._file(batch)]))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds ``changes`` (sign, source, lang, tokenizer, n_tokens); False if the batch is there already."""
        if self.committed(batch):
            return False
        fs, place = self._fs()
        aside = f"{self.path}/_new-{uuid.uuid4().hex}"
        summed = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        summed.coalesce(1).write.parquet(aside)
        part = next(s.getPath() for s in fs.listStatus(place(aside)) if s.getPath().getName().startswith("part-"))
        done = not self.committed(batch) and fs.rename(part, place(f"{self.path}/{self._file(batch)}"))
        fs.delete(place(aside), True)
        return done

    def totals(self) -> DataFrame:
        base, files = self._state()
        gone = self._in_base(base, files)
        paths = [f"{self.path}/{n}" for n in files if n not in gone] + ([f"{self.path}/{base}/totals"] if base else [])
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Sums the base and all batches into a new base; then their own files go."""
        fs, place = self._fs()
        base, files = self._state()
        number = int(base.removeprefix("base-")) if base else 0
        aside = f"{self.path}/_new-{uuid.uuid4().hex}"
        self.totals().coalesce(1).write.parquet(f"{aside}/totals")
        names = self.spark.createDataFrame([(n,) for n in files], "file string")
        if base:
            names = names.union(self.spark.read.schema("file string").parquet(f"{self.path}/{base}/files"))
        names.distinct().coalesce(1).write.parquet(f"{aside}/files")
        if not fs.rename(place(aside), place(f"{self.path}/base-{number + 1:08d}")):
            raise RuntimeError("another compaction has been faster")
        for n in [*files, base] if base else files:
            fs.delete(place(f"{self.path}/{n}"), True)


_ENCODINGS: dict[tuple[bytes, str], object] = {}


def _encoding(vocabulary: bytes, pieces: str):
    import tiktoken

    key = (vocabulary, pieces)
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        _ENCODINGS[key] = tiktoken.Encoding("counts", pat_str=pieces, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def count_tokens(docs: DataFrame, vocabulary: str | None, *, pieces: str = PIECES, words: str | None = None) -> DataFrame:
    """Adds ``n_tokens`` to the columns of ``docs`` but text.

    ``vocabulary`` is the path of a public byte-level vocabulary (token and rank a line); the driver
    reads it, so executors need no file. None counts runs without white space. ``words`` names a
    column for these too, counted in the same pass.
    """
    small_batches(docs.sparkSession)
    added = ["n_tokens", words] if words else ["n_tokens"]
    docs = docs.drop(*added)
    names = [c for c in docs.columns if c.lower() != "text"]
    raw = None
    if vocabulary:
        with open(vocabulary, "rb") as f:
            raw = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(raw, pieces).encode_ordinary if raw else None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            counts = [len(encode(t)) if t else 0 for t in table.column("text").to_pylist()] if encode else []
            runs = [len(word_bounds(np.frombuffer(t, np.uint8))[0]) for t in utf8(table.column("text"))] if words or not encode else []
            out = table.select(names).append_column("n_tokens", pa.array(counts if encode else runs, pa.int64()))
            yield from (out.append_column(words, pa.array(runs, pa.int64())) if words else out).to_batches()

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in added)]))


def changes(docs: DataFrame, tokenizer: str, sign: int = 1, count: str = "n_tokens") -> DataFrame:
    """Signed changes from counted documents (source, lang, ``count``)."""
    return docs.select(F.lit(sign).alias("sign"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(count).alias("n_tokens"))
