"""Column functions: sizes, rates, progress, paths and names. All built from Spark's own functions.

Every ratio is 0 where its denominator is 0, so nothing raises in ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1024
HASH_LENGTH, PATH_LENGTH = 64, 4096


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.when(b == 0, F.lit(1.0)).otherwise(b.cast("double")))


def chunk_count(size: Column, chunk: int) -> Column:
    """Chunks of a file: 0 for an empty one."""
    return F.floor((size + F.lit(chunk - 1)) / F.lit(chunk)).cast("long")


def chunk_offset(index: Column, chunk: int) -> Column:
    return index.cast("long") * chunk


def is_last_chunk(offset: Column, size: Column, total: Column) -> Column:
    return offset + size >= total


def _scaled(size: Column, form) -> Column:
    value = size.cast("double")
    return (
        F.when(size < KIB, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < KIB**2, F.concat(form(value / KIB), F.lit(" KB")))
        .when(size < KIB**3, F.concat(form(value / KIB**2), F.lit(" MB")))
        .otherwise(F.concat(form(value / KIB**3), F.lit(" GB")))
    )


def format_size(size: Column) -> Column:
    """``512 B``, ``1.5 KB``, ``1,000 MB``: one decimal at most."""
    return _scaled(size, lambda v: F.call_function("format_number", v, F.lit("#,##0.#")))


def format_size_fixed(size: Column) -> Column:
    """Like ``format_size`` with exactly one decimal, ties to the even digit, and no group marks."""
    return _scaled(size, lambda v: F.bround(v.cast("decimal(38,18)"), 1).cast("string"))


def truncate(text: Column, n: int) -> Column:
    """At most ``n`` characters, the last three dots where text was cut; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 3)), F.lit("..."))).otherwise(text)


def format_uptime(seconds: Column) -> Column:
    """``1d 2h 3m 4s``; leading zero units are left out."""
    s = seconds.cast("long")
    d, h, m = (F.floor(s / k).cast("long") for k in (86_400, 3600, 60))
    parts = {"d": d, "h": h % 24, "m": m % 60, "s": s % 60}
    text = {k: F.concat(v.cast("string"), F.lit(k)) for k, v in parts.items()}
    return (
        F.when(d > 0, F.concat_ws(" ", *text.values()))
        .when(h > 0, F.concat_ws(" ", text["h"], text["m"], text["s"]))
        .when(m > 0, F.concat_ws(" ", text["m"], text["s"]))
        .otherwise(text["s"])
    )


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def to_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def display_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def megabytes(size: Column) -> Column:
    return size / F.lit(float(KIB**2))


def throughput(size: Column, ms: Column) -> Column:
    """MB/s."""
    return _ratio(megabytes(size), ms / F.lit(1000.0))


def operations_per_second(n: Column, ms: Column) -> Column:
    return _ratio(n, ms / F.lit(1000.0))


def progress(done: Column, size: Column) -> Column:
    """Percent, 100 at most; 0 for an empty file."""
    return F.when(size <= 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), 100.0 * done / F.greatest(size, F.lit(1))))


def rate(done: Column, elapsed_ms: Column) -> Column:
    """Bytes a second."""
    return F.when(elapsed_ms <= 0, F.lit(0.0)).otherwise(done * 1000.0 / F.greatest(elapsed_ms, F.lit(1)))


def time_left(elapsed_ms: Column, done: Column, total: Column) -> Column:
    return F.when(done <= 0, F.lit(0.0)).otherwise(elapsed_ms.cast("double") / F.greatest(done, F.lit(1)) * (total - done))


def round_trip(sent_ms: Column, received_ms: Column) -> Column:
    return received_ms - sent_ms


def backoff_ms(attempt: Column) -> Column:
    """1000 * 1.5 ** attempt, 60000 at most."""
    return F.least(1000 * F.pow(F.lit(1.5), attempt), F.lit(60_000.0))


def loss_percent(lost: Column) -> Column:
    return lost * 100.0 / (lost + 1000)


def dedup_ratio(original: Column, stored: Column) -> Column:
    return _ratio(original, stored)


def space_savings(original: Column, stored: Column) -> Column:
    """Percent of the original bytes that need no place."""
    return F.when(original == 0, F.lit(0.0)).otherwise((1 - _ratio(stored, original)) * 100)


def average(total: Column, n: Column) -> Column:
    return _ratio(total, n)


def blob_path(digest: Column) -> Column:
    """Two-level place of a chunk: ``ab/cdef...``."""
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, HASH_LENGTH))


def benchmark_class(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit("Other")
    for word in reversed(("Throughput", "Scalability", "Network", "Deduplication", "Concurrency")):
        out = F.when(low.contains(word.lower()), word).otherwise(out)
    return out


def valid_chunk_message(digest: Column, offset: Column, size: Column, total: Column, path: Column) -> Column:
    """A message that a receiver may store: hash of 64 hex digits, bounds inside the file, a path of usable length."""
    return (
        F.coalesce(digest.rlike("^[0-9a-f]{64}$"), F.lit(False))
        & (offset >= 0)
        & (size > 0)
        & (offset + size <= total)
        & F.coalesce((F.length(path) > 0) & (F.length(path) <= PATH_LENGTH), F.lit(False))
    )
