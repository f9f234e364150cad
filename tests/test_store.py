import os

import pytest
from pyspark.sql import functions as F

from chunkwright.operators import snapshots
from chunkwright.sources import fsscan, indexfile, reports, restore
from chunkwright.sources.store import Store


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "level1" / "level2").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"hello" * 30)
    (root / "empty").write_bytes(b"")
    (root / ".hidden").write_bytes(b"h")
    (root / "_under.txt").write_bytes(b"u")
    (root / "level1" / "b b.txt").write_bytes(b"hello" * 30)
    (root / "level1" / "level2" / "имя.bin").write_bytes(bytes(range(256)))
    (root / "link").symlink_to(root / "a.txt")
    (root / "link2").symlink_to(root / "a.txt")
    (root / "loop").symlink_to(root)
    (root / "broken").symlink_to(root / "nowhere")
    return root


def ingest(spark, store, name, root):
    rows = fsscan.scan(spark, str(root))
    body = fsscan.contents(rows, str(root)).select("path", "content")
    store.ingest(name, rows.select("path", F.timestamp_millis("modified_ms").alias("modified_time")).join(body, "path"), chunk=64)


def test_scan(spark, tree):
    skip = {r.path: r for r in fsscan.scan(spark, str(tree)).collect()}
    assert set(skip) == {"a.txt", "empty", ".hidden", "_under.txt", "level1/b b.txt", "level1/level2/имя.bin"}
    assert skip["empty"].size == 0
    record = {r.path: r for r in fsscan.scan(spark, str(tree), links="RECORD").collect()}
    assert record["link"].link_target == str(tree / "a.txt")
    assert record["broken"].error
    follow = fsscan.scan(spark, str(tree), links="FOLLOW").collect()
    assert [r.path for r in follow if r.path.startswith("link")] == ["link"]
    assert any(r.path == "loop" and "cycle" in (r.error or "") for r in follow)
    assert {r.path for r in fsscan.scan(spark, str(tree), max_depth=1).collect()} == {"a.txt", "empty", ".hidden", "_under.txt"}
    assert fsscan.filtered(fsscan.scan(spark, str(tree)), include="*.txt").count() == 3


def test_empty_directory(spark, tmp_path):
    assert fsscan.scan(spark, str(tmp_path)).count() == 0


def test_ingest_restore_and_collect(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest(spark, store, "one", tree)
    n = store.table("chunks").count()
    assert store.table("files").count() == 6
    assert n == store.table("blobs").count() < store.table("file_chunks").count()
    with pytest.raises(ValueError):
        ingest(spark, store, "one", tree)
    with pytest.raises(ValueError):
        store.ingest(" ", store.table("files"))
    (tree / "new").write_bytes(b"only here")
    ingest(spark, store, "two", tree)
    assert store.table("chunks").count() == n + 1
    out = tmp_path / "out"
    status = restore.restore(store, "two", str(out))
    assert restore.totals(status).first().written == 7
    for path in ("a.txt", "empty", "level1/level2/имя.bin"):
        assert (out / path).read_bytes() == (tree / path).read_bytes()
    assert abs(os.stat(out / "a.txt").st_mtime - os.stat(tree / "a.txt").st_mtime) < 0.01
    (out / "a.txt").write_bytes(b"mine")
    assert {r.status for r in restore.restore(store, "two", str(out)).collect()} == {"skipped"}
    restore.restore(store, "two", str(out), backup=True, include="a.txt").collect()
    assert (out / "a.txt.backup").read_bytes() == b"mine"
    assert (out / "a.txt").read_bytes() == (tree / "a.txt").read_bytes()
    assert store.delete_snapshot("two")
    assert not store.delete_snapshot("two")
    assert store.collect_garbage() == 1
    assert store.collect_garbage() == 0
    assert store.table("chunks").count() == n == store.table("blobs").count()
    assert store.table("file_chunks").join(store.table("files").select(F.col("id").alias("file_id")), "file_id", "left_anti").isEmpty()


def test_corrupt_and_missing_chunks(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest(spark, store, "one", tree)
    bad = store.table("file_chunks").where("file_id = 'one:a.txt'").first().chunk_hash
    store.commit(replaced={"blobs": store.table("blobs").withColumn("content", F.when(F.col("hash") == bad, F.lit(b"x")).otherwise(F.col("content")))})
    got = {r.path: r.status for r in restore.restore(store, "one", str(tmp_path / "out")).collect()}
    assert got["a.txt"] == got["level1/b b.txt"] == "failed: corrupt chunk"
    assert got["_under.txt"] == "written"
    assert not (tmp_path / "out" / "a.txt").exists()
    assert not store.get(bad).first().sound
    assert store.delete_chunk(bad)
    assert not store.delete_chunk(bad)
    got = {r.path: r.status for r in restore.restore(store, "one", str(tmp_path / "out2")).collect()}
    assert got["a.txt"] == "failed: missing chunk"


def test_repair_and_touch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("h1", 1, bytearray(b"a")), ("h1", 1, bytearray(b"a")), ("h2", 1, bytearray(b"b"))], "hash string, size long, content binary")
    store.put(rows)
    store.put(rows)
    assert store.table("chunks").count() == 2
    before = store.table("chunks").where("hash = 'h1'").first()
    store.touch(spark.createDataFrame([("h1",)], "hash string"))
    after = store.table("chunks").where("hash = 'h1'").first()
    assert after.first_seen == before.first_seen
    assert after.last_accessed > before.last_accessed
    store.commit(replaced={"chunks": store.table("chunks").where("hash = 'h1'")})
    store.repair()
    assert store.has("h2")


def test_index_files(spark, tmp_path):
    (tmp_path / "index").write_text("aa|x/y\nbroken\n  bb|p|q  \n|z\n\n")
    rows = indexfile.read_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, rows.collect())) == [("aa", "x/y"), ("bb", "p|q")]
    indexfile.write_index(rows, str(tmp_path / "out"))
    assert indexfile.read_index(spark, str(tmp_path / "out")).count() == 2
    kept, gone = indexfile.retain(rows, spark.createDataFrame([("aa",)], "hash string"))
    assert (kept.count(), gone.count()) == (1, 1)


def test_upsert_keeps_first_seen(spark):
    old = spark.sql("select 'a' hash, 5L size, timestamp'2024-01-02' first_seen, timestamp'2024-01-02' last_accessed")
    new = spark.sql("select 'a' hash, 5L size, timestamp'2024-01-05' first_seen, timestamp'2024-01-05' last_accessed")
    row = snapshots.upsert_chunks(old, new).first()
    assert (row.first_seen.day, row.last_accessed.day) == (2, 5)


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, None), ("b", None, "x")], "name string, n long, note string")
    reports.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    reports.write_json(rows, str(tmp_path / "json"))
    assert {r.n for r in spark.read.json(str(tmp_path / "json")).collect()} == {1, None}
    reports.write_text(rows, str(tmp_path / "text"), 4)
    assert {r.value for r in spark.read.text(str(tmp_path / "text")).collect()} == {"a    1    -", "b    -    x"}


def test_files_in_ranges(spark, tmp_path):
    root = tmp_path / "big"
    root.mkdir()
    (root / "large").write_bytes(bytes(range(256)) * 1200 + b"end")
    (root / "exact").write_bytes(b"x" * 100_000)
    (root / "none").write_bytes(b"")
    store = Store(spark, str(tmp_path / "store"))
    rows = fsscan.scan(spark, str(root)).withColumn("modified_time", F.timestamp_millis("modified_ms"))

    def read(some):
        wanted = rows.join(some.select("path"), "path", "left_semi")
        return fsscan.contents(wanted, str(root), range_bytes=100_000)

    bodies = read(rows).join(rows.select("path", "modified_time"), "path")
    store.ingest("one", bodies, chunk=10_000, range_bytes=100_000)
    files = {r.path: r for r in store.table("files").collect()}
    assert {p: r["size"] for p, r in files.items()} == {"large": 307_203, "exact": 100_000, "none": 0}
    assert [r.chunk_order for r in store.table("file_chunks").where("file_id = 'one:large'").orderBy("chunk_order").collect()] == list(range(31))
    done = restore.restore(store, "one", str(tmp_path / "out"))
    assert {r.status for r in done.collect()} == {r.status for r in done.collect()} == {"written"}
    for name in files:
        assert (tmp_path / "out" / name).read_bytes() == (root / name).read_bytes()
    with pytest.raises(ValueError, match="more than once"):
        store.ingest("twice", bodies.union(bodies), chunk=10_000, range_bytes=100_000)
    with pytest.raises(ValueError, match="multiple"):
        store.ingest("odd", bodies, chunk=10_000, range_bytes=15_000)
    (root / "exact").write_bytes(b"y" * 5)
    os.utime(root / "exact", (1, 1))
    seen = []
    later = fsscan.scan(spark, str(root)).select("path", "size", F.timestamp_millis("modified_ms").alias("modified_time"))
    store.ingest_changes("two", "one", later, lambda new: seen.append({r.path for r in new.collect()}) or read(new), chunk=10_000, range_bytes=100_000)
    assert seen == [{"exact"}]
    restore.restore(store, "two", str(tmp_path / "out2"))
    for name in files:
        assert (tmp_path / "out2" / name).read_bytes() == (root / name).read_bytes()


def test_garbage_frees_bytes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rng = __import__("random").Random(1)
    bodies = spark.createDataFrame([(f"f{k}", bytearray(rng.randbytes(50_000))) for k in range(6)], "path string, content binary").withColumn("modified_time", F.current_timestamp())
    store.ingest("keep", bodies.where("path = 'f0'"), chunk=10_000)
    store.ingest("drop", bodies, chunk=10_000)

    def size():
        return sum(p.stat().st_size for p in (tmp_path / "store").rglob("*") if p.is_file())

    before = size()
    store.delete_snapshot("drop")
    assert store.collect_garbage() == 25
    assert size() < before / 3
    assert store.table("blobs").count() == 5
    assert not store.problems() and store.version() == 2 and not store.migrate()


def test_restore_outside_of_the_target(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("../evil", bytearray(b"a")), ("fine", bytearray(b"b"))], "path string, content binary").withColumn("modified_time", F.current_timestamp())
    store.ingest("one", rows)
    got = {r.path: r.status for r in restore.restore(store, "one", str(tmp_path / "out")).collect()}
    assert got == {"../evil": "failed: path leaves the target", "fine": "written"}


def test_pruned_scan(spark, tree):
    (tree / ".git").mkdir()
    (tree / ".git" / "x").write_bytes(b"1")
    assert any(r.path == ".git/x" for r in fsscan.scan(spark, str(tree)).collect())
    assert not any(r.path == ".git/x" for r in fsscan.scan(spark, str(tree), hidden=False).collect())
    assert {r.path for r in fsscan.scan(spark, str(tree), prune="^level1/level2$").collect()} == {"a.txt", "empty", ".hidden", ".git/x", "_under.txt", "level1/b b.txt"}
