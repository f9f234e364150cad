"""The content-addressed store: five Parquet tables under versioned folders and one manifest.

A change writes new folders for the tables it touches and then one new manifest, which names
the folder of each table and the version of their schema. Readers use the latest manifest, so they see all
of a change or nothing of it, and a job that dies leaves no trace in what readers see. One writer at a time.
``vacuum`` takes away the folders that no kept manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.operators import model, snapshots, verify
from chunkwright.operators.chunking import CHUNK, Chunker, fixed_size, hash_ranges, sha256


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # Manifests

    def _fs(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path
        return place(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _numbers(self) -> list[int]:
        fs, place = self._fs()
        home = place(f"{self.path}/manifests")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(home) if s.getPath().getName().endswith(".json")) if fs.exists(home) else []

    def _read(self, number: int) -> dict:
        """A manifest; one without a schema version is of version 1."""
        fs, place = self._fs()
        stream = fs.open(place(f"{self.path}/manifests/{number:08d}.json"))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return found if "version" in found else {"version": 1, "tables": found}

    def _manifest(self) -> tuple[int, dict[str, list[str]]]:
        numbers = self._numbers()
        if not numbers:
            return 0, {t: [] for t in model.SCHEMAS}
        found = self._read(numbers[-1])
        if found["version"] > model.VERSION:
            raise ValueError(f"the store has schema version {found['version']}; this library knows {model.VERSION}")
        return numbers[-1], found["tables"]

    def version(self) -> int:
        """The schema version of the latest manifest; 0 for a new store."""
        numbers = self._numbers()
        return self._read(numbers[-1])["version"] if numbers else 0

    def migrate(self) -> bool:
        """Brings an older store to the present schema: rows stay, columns that are new are null. False if there was nothing to do."""
        if self.version() in (0, model.VERSION):
            return False
        self.commit()
        return True

    def problems(self) -> list[str]:
        """Tables whose folders do not have the columns and types of the schema."""
        return [t for t, folders in self._manifest()[1].items() if folders and not model.fits(self.spark.read.parquet(*(f"{self.path}/{f}" for f in folders)), t)]

    def _publish(self, number: int, tables: dict[str, list[str]]) -> None:
        fs, place = self._fs()
        aside = place(f"{self.path}/manifests/.new-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": model.VERSION, "tables": tables}).encode()))
        out.close()
        if not fs.rename(aside, place(f"{self.path}/manifests/{number + 1:08d}.json")):
            fs.delete(aside, False)
            raise RuntimeError("another writer has published a version; try again")

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all manifests but the last ``keep``, and the folders that none of these names; how many folders. No reader may use older versions."""
        fs, place = self._fs()
        numbers = self._numbers()
        named = {f for n in numbers[-keep:] for folders in self._read(n)["tables"].values() for f in folders}
        for n in numbers[:-keep]:
            fs.delete(place(f"{self.path}/manifests/{n:08d}.json"), False)
        found = [f"{t}/{s.getPath().getName()}" for t in [*model.SCHEMAS, "_staged"] if fs.exists(place(f"{self.path}/{t}")) for s in fs.listStatus(place(f"{self.path}/{t}"))]
        gone = [f for f in found if f not in named]
        for f in gone:
            fs.delete(place(f"{self.path}/{f}"), True)
        return len(gone)

    def table(self, name: str) -> DataFrame:
        folders = self._manifest()[1].get(name, [])
        if not folders:
            return self.spark.createDataFrame([], model.schema(name))
        return self.spark.read.schema(model.schema(name)).parquet(*(f"{self.path}/{f}" for f in folders))

    def tables(self) -> dict[str, DataFrame]:
        return {t: self.table(t) for t in model.SCHEMAS}

    def commit(self, appended: dict[str, DataFrame] | None = None, replaced: dict[str, DataFrame] | None = None) -> None:
        """Publishes rows added to tables and tables written anew, all at once."""
        number, now = self._manifest()
        for kind, changes in (("a", appended or {}), ("r", replaced or {})):
            for name, df in changes.items():
                folder = f"{name}/{number + 1:08d}-{uuid.uuid4().hex[:8]}"
                fields = model.schema(name)
                df.select(*(F.col(f.name).cast(f.dataType) for f in fields)).write.parquet(f"{self.path}/{folder}")
                now[name] = [*now.get(name, []), folder] if kind == "a" else [folder]
        self._publish(number, now)

    def _stage(self, rows: DataFrame, home: str = "_staged") -> tuple[DataFrame, str | None]:
        """The rows written aside, and the folder where they are."""
        aside = f"{self.path}/{home}/{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        return self.spark.read.schema(rows.schema).parquet(aside), aside

    # Content

    def put(self, chunks: DataFrame) -> None:
        """Stores chunks (hash, size, content) that are not there yet, once each; those that are there are touched."""
        self.commit(appended=self._new_content(chunks))
        self.touch(chunks.select("hash"))

    def _new_content(self, chunks: DataFrame) -> dict[str, DataFrame]:
        new = chunks.join(self.table("chunks").select("hash"), "hash", "left_anti").dropDuplicates(["hash"])
        now = F.current_timestamp()
        return {"blobs": new.select("hash", "content"), "chunks": new.select("hash", "size", now.alias("first_seen"), now.alias("last_accessed"))}

    def get(self, digest: str) -> DataFrame:
        """(hash, content, sound) of one chunk; no row if it is not there."""
        return self.table("blobs").where(F.col("hash") == digest).withColumn("sound", F.sha2("content", 256) == F.col("hash"))

    def has(self, digest: str) -> bool:
        return not self.table("chunks").where(F.col("hash") == digest).isEmpty()

    def repair(self) -> None:
        """Adds chunk rows for blobs that have none."""
        lost = self.table("blobs").join(self.table("chunks").select("hash"), "hash", "left_anti")
        now = F.current_timestamp()
        self.commit(appended={"chunks": lost.select("hash", F.octet_length("content").cast("long").alias("size"), now.alias("first_seen"), now.alias("last_accessed"))})

    def touch(self, hashes: DataFrame) -> None:
        """Sets last_accessed of stored chunks (hash)."""
        seen = self.table("chunks").join(hashes.select("hash").distinct(), "hash", "left_semi").withColumn("last_accessed", F.current_timestamp())
        self.commit(replaced={"chunks": snapshots.upsert_chunks(self.table("chunks"), seen)})

    def delete_chunk(self, digest: str) -> bool:
        """True if it was there."""
        if not self.has(digest):
            return False
        self.commit(replaced={t: self.table(t).where(F.col("hash") != digest) for t in ("chunks", "blobs")})
        return True

    def collect_garbage(self, *, vacuum: bool = True) -> int:
        """Takes away chunks that no file has, and with ``vacuum`` their bytes; how many chunks."""
        chunks, used = self.table("chunks"), self.table("file_chunks")
        n = verify.orphans(chunks, used).count()
        if n:
            self.commit(replaced={"chunks": verify.referenced(chunks, used), "blobs": verify.referenced(self.table("blobs"), used)})
            if vacuum:
                self.vacuum()
        return n

    # Snapshots

    def ingest(self, name: str, bodies: DataFrame, content: Column | str = "content", *, chunk: int = CHUNK, description: str | None = None, digest: Callable[[Column], Column] = sha256, chunker: Chunker | None = None, range_bytes: int | None = None, base: str | None = None) -> None:
        """A new snapshot of ``bodies`` (path, modified_time, content). Name and snapshot id are the same.

        With ``range_bytes``, a multiple of ``chunk``, a file may come in ranges of that size, numbered by
        ``chunk_order``, so that no row holds a large file; the file's hash is then streamed over its chunks in
        order. ``base`` names an earlier snapshot whose unchanged files (``carry`` true in ``bodies``, content null) keep
        their hashes and chunk lists without being read. The source is read once: chunks are written aside,
        and every table comes from there. Another ``chunker`` than that of fixed sizes needs whole files.
        """
        if not name or not name.strip():
            raise ValueError("a snapshot needs a name")
        if not snapshots.find(self.table("snapshots"), "name", name).isEmpty():
            raise ValueError(f"snapshot {name!r} exists")
        if chunker is not None and range_bytes is not None:
            raise ValueError("a chunker of your own needs whole files, not ranges")
        if range_bytes is not None and (range_bytes <= 0 or range_bytes % chunk):
            raise ValueError("a range must be a multiple of the chunk size")
        body = F.col(content) if isinstance(content, str) else content
        number = F.col("chunk_order").cast("long") if "chunk_order" in bodies.columns else F.lit(0).cast("long")
        carry = F.coalesce(F.col("carry"), F.lit(False)) if "carry" in bodies.columns else F.lit(False)
        rows = bodies.select(F.concat_ws(":", F.lit(name), "path").alias("id"), "path", "modified_time", number.alias("_range"), carry.alias("carry"), body.alias("_body"))
        rows = rows.withColumn("whole_hash", F.when(~F.col("carry"), digest(F.coalesce("_body", F.lit(b"").cast("binary"))))).transform(chunker or fixed_size(chunk))
        first = (F.col("_range") * ((range_bytes or chunk) // chunk)).cast("int")
        rows = rows.select("id", "path", "modified_time", "carry", "whole_hash", "_range", (first + F.col("k")).alias("chunk_order"), "content")
        rows = rows.withColumns({"chunk_size": F.octet_length("content").cast("int"), "chunk_hash": F.when(F.col("content").isNotNull(), digest(F.col("content")))})
        staged, aside = self._stage(rows)
        try:
            if not staged.groupBy("id", "chunk_order").count().where("count > 1").isEmpty():
                raise ValueError("a path, or a range of one, comes more than once")
            self._ingest_staged(name, staged, description, base)
        finally:
            if aside:
                fs, place = self._fs()
                fs.delete(place(aside), True)

    def _ingest_staged(self, name: str, staged: DataFrame, description: str | None, base: str | None) -> None:
        by_file = staged.where("not carry").groupBy("id", "path").agg(F.max("modified_time").alias("modified_time"), F.coalesce(F.sum("chunk_size"), F.lit(0)).cast("long").alias("size"), F.max("_range").alias("_ranges"), F.max("whole_hash").alias("whole_hash"))
        long = staged.join(by_file.where("_ranges > 0").select("id"), "id", "left_semi").where("content is not null")
        hashes = hash_ranges(long.select(F.col("id").alias("file_id"), "chunk_order", "content")).withColumnRenamed("file_id", "id")
        files = by_file.join(hashes, "id", "left").select("id", F.lit(name).alias("snapshot_id"), "path", "size", "modified_time", F.when(F.col("_ranges") > 0, F.col("file_hash")).otherwise(F.col("whole_hash")).alias("file_hash"))
        pieces = staged.where("content is not null")
        lists = pieces.select(F.col("id").alias("file_id"), "chunk_hash", "chunk_order", "chunk_size")
        if base is not None:
            kept = staged.where("carry").select("path", "id").join(snapshots.find(self.table("files"), "snapshot_id", base).withColumnRenamed("id", "old"), "path")
            files = files.unionByName(kept.select("id", F.lit(name).alias("snapshot_id"), "path", "size", "modified_time", "file_hash"))
            lists = lists.unionByName(self.table("file_chunks").join(kept.select(F.col("old").alias("file_id"), "id"), "file_id").select(F.col("id").alias("file_id"), "chunk_hash", "chunk_order", "chunk_size"))
        # Of each new hash one place; only the places meet the content.
        places = pieces.groupBy(F.col("chunk_hash").alias("hash")).agg(F.min(F.struct("id", "chunk_order")).alias("at"), F.max("chunk_size").cast("long").alias("size"))
        places = places.join(self.table("chunks").select("hash"), "hash", "left_anti").select("hash", "size", "at.id", "at.chunk_order")
        blobs = pieces.join(places.select("id", "chunk_order", "hash"), ["id", "chunk_order"]).select("hash", "content")
        now = F.current_timestamp()
        chunks = places.select("hash", "size", now.alias("first_seen"), now.alias("last_accessed"))
        one = self.spark.range(1).select(F.lit(name).alias("id"), F.lit(name).alias("name"), now.alias("created_at"), F.lit(description).cast("string").alias("description"))
        self.commit(appended={"snapshots": one, "files": files, "file_chunks": lists, "blobs": blobs, "chunks": chunks})

    def ingest_changes(self, name: str, base: str, scan: DataFrame, read: Callable[[DataFrame], DataFrame], **options) -> None:
        """An incremental snapshot: of ``scan`` (path, size, modified_time) only files that ``base`` lacks, or has with another size or time, are read.

        ``read`` gives (path, content), and chunk_order if ``range_bytes`` is an option, for the rows that it gets.
        """
        old = snapshots.find(self.table("files"), "snapshot_id", base).select("path", "size", "modified_time")
        same = scan.join(old, ["path", "size", "modified_time"], "left_semi")
        new = scan.join(old, ["path", "size", "modified_time"], "left_anti")
        found = read(new).join(new.select("path", "modified_time"), "path").withColumn("carry", F.lit(False))
        kept = same.select("path", "modified_time", F.lit(True).alias("carry"), F.lit(None).cast("binary").alias("content"))
        self.ingest(name, found.unionByName(kept, allowMissingColumns=True).withColumn("chunk_order", F.coalesce("chunk_order", F.lit(0))) if "chunk_order" in found.columns else found.unionByName(kept), base=base, **options)

    def delete_snapshot(self, name: str) -> bool:
        if snapshots.find(self.table("snapshots"), "id", name).isEmpty():
            return False
        kept = snapshots.delete_snapshot(self.tables(), name)
        self.commit(replaced={t: kept[t] for t in ("snapshots", "files", "file_chunks")})
        return True

    def delete_files(self, ids: DataFrame) -> None:
        files, chunks = snapshots.delete_files(self.table("files"), self.table("file_chunks"), ids)
        self.commit(replaced={"files": files, "file_chunks": chunks})
