"""Vectorised byte-level text helpers shared by the operators of this subpackage.

Words are hashed with a polynomial hash over the UTF-8 bytes, taken for a whole
Arrow batch at once from prefix sums modulo 2**64, then scrambled. Two different
words share a 64-bit hash with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA5A5A5A5F00DBEEF)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        _POW, _INV = _powers(_R, size), _powers(_RINV, size)
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes hashed by one pass. A longer text is cut at white space into passes of its own.
PASS_BYTES = (1 << 20) - 4096


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no ASCII white space."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SPACE[buf], out=inside[1:-1].view(bool))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans of ``buf``."""
    if not len(start):
        return np.empty(0, np.uint64)
    power, inverse = _tables(len(buf) + 1)
    pre = np.empty(len(buf) + 1, np.uint64)
    pre[0] = 0
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=pre[1:])
    h = (pre[end] - pre[start]) * inverse[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def hashed_words(texts: list[bytes], table: bytes = ASCII_LOWER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first, last, word hashes, offsets) for runs of texts of bounded size.

    ``texts[first:last]`` own the hashes; those of text ``first + i`` are
    ``hashes[offsets[i]:offsets[i + 1]]``. Words are the maximal runs outside
    ``\\x20\\x09-\\x0D`` once the bytes are translated by ``table``, which lower-cases A-Z.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < PASS_BYTES):
            size += len(texts[last]) + 1
            last += 1
        if size > PASS_BYTES:
            h = np.concatenate([_hashes(piece, [len(piece)], table)[0] for piece in _pieces(texts[first].translate(table))])
            yield first, last, h, np.array([0, len(h)])
        else:
            ends = np.cumsum([len(t) + 1 for t in texts[first:last]])
            yield first, last, *_hashes(b" ".join(texts[first:last]), ends, table)
        first = last


def _hashes(raw: bytes, ends, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(raw.translate(table), np.uint8)
    start, end = word_bounds(buf)
    return hash_spans(buf, start, end), np.concatenate(([0], np.searchsorted(start, ends)))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut at white space; only a single longer word makes a longer piece."""
    at = 0
    while at < len(text):
        to = min(at + PASS_BYTES, len(text))
        if to < len(text):
            cut = max(text.rfind(c, at, to) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
            if cut <= at:
                cut = min((k for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (k := text.find(c, to)) >= 0), default=len(text))
            to = cut
        yield text[at:to]
        at = to


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bounds the bytes of Arrow batches, so that whole texts fit in a worker's memory.

    A session setting, and one that no result depends on: plans read it when they run, so it stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m")) > size:
        spark.conf.set(key, str(size))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share.

    ``spark.checkpoint.dir`` names it. Where that is unset, a folder under the warehouse is used if
    all runs on this machine (tests); on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df, name: str):
    """Writes ``df`` as Parquet in the shared folder and reads it again: cuts the lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(table, most: int = 250_000):
    """The table (of a few bytes a row), to be broadcast in a join if a count shows that it has at most ``most`` rows."""
    return F.broadcast(table) if table.count() <= most else table


def bounded(table, key, most: int):
    """At most ``most`` rows of a stored table, those with the least values of ``key`` (a column of distinct hashes)."""
    if table.count() <= most:
        return table
    edge = table.select(key.alias("k")).orderBy("k").limit(most).agg({"k": "max"}).first()[0]
    return table.where(key <= edge)


def fresh(df, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def trim() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)


def released(run):
    """A step over Arrow batches that gives freed memory back to the system when its task ends.

    Spark uses a Python worker again for later stages, so what an allocator keeps adds up.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return own


def tidy(spark: SparkSession) -> None:
    """Lets the driver notice now which shuffles no query needs any more, so that their files go.

    What the first collection lets go of may be all that holds a shuffle, so there is a second one.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def relieved(spark: SparkSession) -> None:
    """Has the executors give back heap that earlier steps have grown and no longer need.

    Their heaps only shrink when all garbage is collected, so what each step needs at most would add up with
    what the Python workers of the next one hold.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).collect()
