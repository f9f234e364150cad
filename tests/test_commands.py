import hashlib

import pytest
from pyspark.sql import functions as F

from chunkwright import commands
from chunkwright.operators import snapshots
from chunkwright.sources import fsscan
from chunkwright.sources.memory import MemoryStore
from chunkwright.sources.store import Store


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"one two " * 30)
    (root / "b.bin").write_bytes(bytes(range(256)) * 600)
    (root / "sub" / "c.txt").write_bytes(b"")
    (root / "sub" / "deep" / "d.txt").write_bytes(b"one two " * 30)
    return root


@pytest.fixture(params=["folder", "memory"])
def store(request, spark, tmp_path):
    return Store(spark, str(tmp_path / "store")) if request.param == "folder" else MemoryStore(spark)


def content(root):
    return {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in root.rglob("*") if p.is_file()}


def test_commands(store, tree, tmp_path):
    run = commands.run
    assert {r.path: r.file_hash for r in run(store, "hash", source=str(tree)).collect()} == content(tree)
    assert run(store, "backup", source=str(tree), name="one").first().total_files == 4
    (tree / "b.bin").write_bytes(b"changed!" * 31)
    (tree / "e.txt").write_bytes(b"new")
    assert run(store, "backup", source=str(tree), name="two", base="one").first().total_files == 5
    assert {r.change: r.n_files for r in run(store, "compare", old="one", new="two").collect()} == {"added": 1, "modified": 1, "unchanged": 3}
    assert [r.id for r in run(store, "snapshots").collect()] == ["two", "one"]
    assert run(store, "dedup").first().dedup_ratio > 1
    assert run(store, "verify", name="two").count() == run(store, "verify").count() == 1
    assert {r.status for r in run(store, "restore", name="two", target=str(tmp_path / "out")).collect()} == {"written"}
    assert content(tmp_path / "out") == content(tree)
    assert [r.id for r in run(store, "delete", name="one").collect()] == ["two"]
    assert run(store, "gc", dry_run="true").first().n_chunks == 2
    assert run(store, "gc").first().n_chunks == 2
    assert run(store, "gc").first().n_chunks == 0


def test_wrong_commands(store):
    for name, arguments in (("nothing", {}), ("info", {}), ("info", {"name": "x", "other": "y"}), ("info", {"name": "x"}), ("restore", {"name": "x", "target": "y"})):
        with pytest.raises(ValueError):
            commands.run(store, name, **arguments)
    with pytest.raises(ValueError):
        commands.register("gc")(commands.collect)
    assert commands.main(["store"]) == 2


def test_memory_store_is_bounded(spark):
    store = MemoryStore(spark, max_bytes=2000)
    rows = spark.createDataFrame([("x", bytearray(100))], "path string, content binary").withColumn("modified_time", F.timestamp_millis(F.lit(0)))
    store.ingest("one", rows)
    with pytest.raises(MemoryError):
        store.ingest("two", rows.withColumn("content", F.lit(b"y" * 3000)))
    assert [r.id for r in store.table("snapshots").collect()] == ["one"]
    assert store.problems() == []
    assert store.version() > 0


def test_own_chunker(spark, store):
    def lines(rows):
        """A chunk for each line."""
        pieces = F.split(F.col("_body").cast("string"), "(?<=\n)")
        return rows.select("*", F.posexplode_outer(pieces).alias("k", "_piece")).withColumn("content", F.when(F.col("_piece") != "", F.col("_piece").cast("binary"))).where("k is null or content is not null or k = 0")

    rows = spark.createDataFrame([("x", bytearray(b"a\nbb\na\n")), ("empty", bytearray(b""))], "path string, content binary").withColumn("modified_time", F.timestamp_millis(F.lit(0)))
    store.ingest("one", rows, chunker=lines)
    got = store.table("file_chunks").orderBy("chunk_order").collect()
    assert [(r.file_id, r.chunk_size) for r in got] == [("one:x", 2), ("one:x", 3), ("one:x", 2)]
    assert store.table("chunks").count() == 2
    assert {r.path: r.size for r in store.table("files").collect()} == {"x": 7, "empty": 0}
    with pytest.raises(ValueError):
        store.ingest("two", rows, chunker=lines, range_bytes=65536)


def test_visitor(spark, tree):
    def paths(visit):
        return sorted(r.path for r in fsscan.scan(spark, str(tree), visit=visit).collect())

    assert paths(lambda path, directory: fsscan.CONTINUE) == sorted(content(tree))
    assert paths(lambda path, directory: fsscan.SKIP if path.endswith(".bin") else fsscan.CONTINUE) == ["a.txt", "sub/c.txt", "sub/deep/d.txt"]
    assert paths(lambda path, directory: fsscan.SKIP if path == "sub/deep" else fsscan.CONTINUE) == ["a.txt", "b.bin", "sub/c.txt"]
    assert paths(lambda path, directory: fsscan.STOP if path == "b.bin" else fsscan.CONTINUE) == ["a.txt"]


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_places(spark, ranges):
    names = [f"/{k * 7919 % 1000:03d}/é{k}" for k in range(1000)]
    rows = spark.createDataFrame([(n, k) for k, n in enumerate([*names, None])], "path string, k long").repartition(5)
    got = sorted(snapshots.placed(rows, "path", ranges=ranges).collect(), key=lambda r: r.place)
    assert [r.path for r in got] == [None, *sorted(names)]
    assert [r.place for r in got] == list(range(1, 1002))
    assert snapshots.placed(rows.limit(0), "path").count() == 0
