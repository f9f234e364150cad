"""Restores a snapshot's files to a directory that all tasks can write."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.functions.globs import selected
from chunkwright.sources.store import Store

STATUS = "path string, status string, n_bytes long"


def restore(store: Store, snapshot: str, target: str, *, overwrite: bool = False, backup: bool = False, preserve: bool = True, check: bool = True, include: str | None = None, exclude: str | None = None, strict: bool = False) -> DataFrame:
    """(path, status, n_bytes) of each file: written, skipped, or failed with the reason.

    A file's chunks come in order from rows sorted within its partition and are written one by one to a
    file beside the target, under the attempt's own name, which takes its place only when its hash is right.
    The files are written once, now; the rows returned are what was written then, however often they are
    read. A path that leaves the target is a failure of that file.
    """
    files = store.table("files").where(F.col("snapshot_id") == snapshot).where(selected(F.col("path"), include, exclude, strict=strict))
    lists = store.table("file_chunks").withColumnRenamed("file_id", "id")
    blobs = store.table("blobs").withColumnRenamed("hash", "chunk_hash")
    rows = files.join(lists, "id", "left").join(blobs, "chunk_hash", "left")
    rows = rows.select("id", "path", "file_hash", F.unix_millis("modified_time").alias("modified_ms"), "chunk_order", "chunk_hash", "content")
    ordered = rows.repartition("id").sortWithinPartitions("id", "chunk_order")

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pandas as pd

        def close(now: dict) -> tuple[str, str, int]:
            if now["out"]:
                now["out"].close()
            full, aside = now["full"], now["aside"]
            if not now["error"] and check and now["hash"].hexdigest() != now["want"]:
                now["error"] = "failed: file hash"
            if now["error"]:
                if aside:
                    os.unlink(aside)
                return now["path"], now["error"], 0
            if os.path.lexists(full):
                if backup:
                    shutil.move(full, f"{full}.backup")
                elif not overwrite:
                    os.unlink(aside)
                    return now["path"], "skipped", 0
            os.replace(aside, full)
            if preserve and now["ms"] is not None:
                os.utime(full, (now["ms"] / 1000,) * 2)
            return now["path"], "written", now["n"]

        def begin(row) -> dict:
            full = os.path.normpath(os.path.join(target, row.path.lstrip("/")))
            if not full.startswith(os.path.normpath(target) + os.sep):
                return {"id": row.id, "path": row.path, "full": full, "aside": None, "out": None, "hash": hashlib.sha256(), "want": None, "error": "failed: path leaves the target", "n": 0, "ms": None}
            os.makedirs(os.path.dirname(full), exist_ok=True)
            aside = f"{full}.{uuid.uuid4().hex}.restoring"
            ms = None if pd.isna(row.modified_ms) else float(row.modified_ms)
            return {"id": row.id, "path": row.path, "full": full, "aside": aside, "out": open(aside, "wb"), "hash": hashlib.sha256(), "want": row.file_hash, "error": None, "n": 0, "ms": ms}  # noqa: SIM115

        now, done = None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if now is None or row.id != now["id"]:
                    if now is not None:
                        done.append(close(now))
                    now = begin(row)
                if row.chunk_hash is None or now["out"] is None:
                    continue
                if row.content is None:
                    now["error"] = "failed: missing chunk"
                elif check and hashlib.sha256(row.content).hexdigest() != row.chunk_hash:
                    now["error"] = "failed: corrupt chunk"
                else:
                    now["out"].write(row.content)
                    now["hash"].update(row.content)
                    now["n"] += len(row.content)
            if len(done) > 1000:
                yield pd.DataFrame(done, columns=["path", "status", "n_bytes"])
                done = []
        if now is not None:
            done.append(close(now))
        yield pd.DataFrame(done, columns=["path", "status", "n_bytes"])

    return store._stage(ordered.mapInPandas(run, STATUS), "_restored")[0]


def totals(status: DataFrame) -> DataFrame:
    failed = F.col("status").startswith("failed")
    return status.agg(F.count_if(F.col("status") == "written").alias("written"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(failed).alias("failed"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))
