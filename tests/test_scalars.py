import hashlib

import pytest
from pyspark.sql import functions as F

from chunkwright.functions import scalars as X
from chunkwright.functions.globs import glob_to_regex, selected
from chunkwright.operators import model
from chunkwright.operators.chunking import chunks_of, file_hashes, hash_ranges


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("size", "text"),
    [(0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (1024**2, "1 MB"), (1000 * 1024**2, "1,000 MB"), (3 * 1024**3 // 2, "1.5 GB")],
)
def test_format_size(spark, size, text):
    assert one(spark, X.format_size(F.lit(size)))[0] == text


def test_format_size_fixed_ties(spark):
    """One decimal of exact ties as SQL's printf has it: the even digit."""
    sizes = {268544: "262.2 KB", 268800: "262.5 KB", 321126400: "306.2 MB", 6710886400: "6.2 GB", 1024: "1.0 KB", 1792: "1.8 KB", 1023: "1023 B", 10**15: "931322.6 GB"}
    assert {n: one(spark, X.format_size_fixed(F.lit(n)))[0] for n in sizes} == sizes


@pytest.mark.parametrize(("s", "text"), [(0, "0s"), (59, "59s"), (61, "1m 1s"), (3600, "1h 0m 0s"), (93784, "1d 2h 3m 4s")])
def test_uptime(spark, s, text):
    assert one(spark, X.format_uptime(F.lit(s)))[0] == text


def test_zero_denominators(spark):
    zero = F.lit(0)
    row = one(spark, X.throughput(F.lit(5), zero), X.dedup_ratio(F.lit(5), zero), X.space_savings(zero, zero), X.progress(F.lit(5), zero), X.rate(F.lit(5), zero), X.time_left(F.lit(5), zero, F.lit(9)), X.average(F.lit(1), zero))
    assert list(row) == [0.0] * 7


def test_values(spark):
    row = one(spark, X.progress(F.lit(300), F.lit(200)), X.time_left(F.lit(10), F.lit(5), F.lit(15)), X.backoff_ms(F.lit(2)), X.backoff_ms(F.lit(40)), X.throughput(F.lit(1024**2), F.lit(500)), X.truncate(F.lit("abcdefghijk"), 10), X.truncate(F.lit(None).cast("string"), 10))
    assert list(row) == [100.0, 20.0, 2250.0, 60000.0, 2.0, "abcdefg...", ""]


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [
        ("*.txt", "a.txt", True), ("*.txt", "d/a.txt", False), ("**/*.txt", "d/e/a.txt", True), ("src_*.java", "src_a.java", True), ("a?c", "abc", True), ("a?c", "a/c", False),
        ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("{a,b}.c", "b.c", True), ("a+b(1).txt", "a+b(1).txt", True), ("[a-c]x", "bx", True),
    ],
)
def test_globs(spark, glob, path, hit):
    assert one(spark, F.lit(path).rlike(glob_to_regex(glob)))[0] is hit


def test_selected_by_path_or_name(spark):
    rows = spark.createDataFrame([("d/file1.txt",), ("file3.txt",), ("test12.txt",), ("x.tmp",)], "path string")
    c = F.col("path")
    assert rows.where(selected(c, "*.txt")).count() == 3
    assert rows.where(selected(c, "*.txt", strict=True)).count() == 2
    assert rows.where(selected(c, None, "*.tmp")).count() == 3
    assert rows.where(selected(c, "*.txt", "file3.*")).count() == 2
    assert rows.where(selected(c, r"regex:test[0-9]+\.txt")).count() == 1


@pytest.mark.parametrize(("size", "chunk", "n"), [(0, 65536, 0), (10, 65536, 1), (102_400, 65536, 2), (32_768, 16_384, 2), (65_536, 65_536, 1)])
def test_chunks(spark, size, chunk, n):
    body = bytes(i * 7 % 251 for i in range(size))
    rows = chunks_of(spark.createDataFrame([("f", bytearray(body))], "id string, body binary"), F.col("body"), ["id"], chunk=chunk, keep_content=True).orderBy("chunk_order").collect()
    assert len(rows) == n
    assert b"".join(r.content for r in rows) == body
    assert [r.chunk_hash for r in rows] == [hashlib.sha256(body[k * chunk : (k + 1) * chunk]).hexdigest() for k in range(n)]


def test_known_hashes(spark):
    rows = spark.createDataFrame([(0, bytearray(b"")), (1, bytearray(b"abc"))], "i int, body binary")
    got = {r.i: r.file_hash for r in file_hashes(rows, F.col("body"), ["i"]).collect()}
    assert got == {0: "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", 1: "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}


def test_hash_of_ranges(spark):
    rows = spark.createDataFrame([("a", 1, bytearray(b"c")), ("a", 0, bytearray(b"ab")), ("b", 0, bytearray(b""))], "file_id string, chunk_order int, content binary")
    assert dict(hash_ranges(rows).collect()) == {"a": hashlib.sha256(b"abc").hexdigest(), "b": hashlib.sha256(b"").hexdigest()}


def test_row_checks(spark):
    rows = spark.createDataFrame([("a", 1, None), (" ", -1, None), (None, 2, None)], "hash string, size long, x string")
    assert sorted(map(tuple, model.violations(rows, "chunks").collect()), key=str) == sorted([("hash_filled", " "), ("size_counted", " "), ("hash_filled", None)], key=str)
    assert model.fits(spark.createDataFrame([], model.schema("files")), "files")
    assert not model.fits(rows, "chunks")


def test_message_validity(spark):
    def valid(h, offset, size, total, path):
        return one(spark, X.valid_chunk_message(F.lit(h), F.lit(offset), F.lit(size), F.lit(total), F.lit(path)))[0]

    assert valid("a" * 64, 0, 5, 5, "x")
    assert not valid("a" * 63, 0, 5, 5, "x")
    assert not valid("a" * 64, 1, 5, 5, "x")
    assert not valid("a" * 64, 0, 5, 5, "x" * 4097)
