"""Commands over a store, by name: ``python -m chunkwright.commands STORE COMMAND [key=value ...]``.

A command is a function of a store and text arguments that returns a DataFrame to show. ``register`` adds one.
"""

from __future__ import annotations

import inspect
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.operators import metrics, snapshots, verify
from chunkwright.sources import fsscan
from chunkwright.sources import restore as restoring
from chunkwright.sources.store import Store

Command = Callable[..., DataFrame]
COMMANDS: dict[str, Command] = {}
RANGE = 64 << 20


def register(name: str) -> Callable[[Command], Command]:
    def add(f: Command) -> Command:
        if name in COMMANDS:
            raise ValueError(f"a command named {name!r} exists")
        COMMANDS[name] = f
        return f

    return add


def run(store: Store, name: str, /, **arguments: str) -> DataFrame:
    """Raises ValueError for an unknown command, and for arguments that it lacks or does not know."""
    if name not in COMMANDS:
        raise ValueError(f"unknown command {name!r}; there are {', '.join(sorted(COMMANDS))}")
    try:
        bound = inspect.signature(COMMANDS[name]).bind(store, **arguments)
    except TypeError as e:
        raise ValueError(f"{name}: {e}") from None
    return COMMANDS[name](*bound.args, **bound.kwargs)


def _known(store: Store, snapshot: str) -> None:
    if snapshots.find(store.table("snapshots"), "id", snapshot).isEmpty():
        raise ValueError(f"no snapshot {snapshot!r}")


@register("hash")
def hash_files(store: Store, source: str) -> DataFrame:
    """Path, size and SHA-256 of the files below a directory."""
    from chunkwright.operators.chunking import hash_ranges

    rows = fsscan.scan(store.spark, source)
    hashes = hash_ranges(fsscan.contents(rows, source, range_bytes=RANGE).withColumnRenamed("path", "file_id"))
    return rows.join(hashes.withColumnRenamed("file_id", "path"), "path").select("path", "size", "file_hash")


@register("backup")
def backup(store: Store, source: str, name: str, base: str | None = None, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """A new snapshot of a directory; with ``base`` only files that changed since that snapshot are read."""
    rows = fsscan.filtered(fsscan.scan(store.spark, source), include=include, exclude=exclude, hidden=True)
    rows = rows.where("is_regular and error is null").withColumn("modified_time", F.timestamp_millis("modified_ms"))
    if base is None:
        body = fsscan.contents(rows, source, range_bytes=RANGE)
        store.ingest(name, rows.select("path", "modified_time").join(body, "path"), range_bytes=RANGE)
    else:
        _known(store, base)
        store.ingest_changes(name, base, rows, lambda new: fsscan.contents(new, source, range_bytes=RANGE), range_bytes=RANGE)
    return info(store, name)


@register("restore")
def restore(store: Store, name: str, target: str, include: str | None = None, exclude: str | None = None, overwrite: str = "false") -> DataFrame:
    _known(store, name)
    return restoring.restore(store, name, target, include=include, exclude=exclude, overwrite=overwrite.lower() == "true")


@register("verify")
def check(store: Store, name: str | None = None) -> DataFrame:
    """Files by state, of one snapshot or of all."""
    files = store.table("files")
    if name is not None:
        _known(store, name)
        files = files.where(F.col("snapshot_id") == name)
    lists = store.table("file_chunks").join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return verify.verify_totals(verify.file_status(files, verify.chunk_status(lists, store.table("blobs"))))


@register("snapshots")
def listed(store: Store) -> DataFrame:
    return snapshots.by_date(snapshots.with_totals(store.table("snapshots"), store.table("files")))


@register("info")
def info(store: Store, name: str) -> DataFrame:
    _known(store, name)
    return snapshots.with_totals(snapshots.find(store.table("snapshots"), "id", name), store.table("files").where(F.col("snapshot_id") == name))


@register("compare")
def compare(store: Store, old: str, new: str) -> DataFrame:
    for name in (old, new):
        _known(store, name)
    files = store.table("files")
    return snapshots.comparison_totals(snapshots.compare(files.where(F.col("snapshot_id") == old), files.where(F.col("snapshot_id") == new)))


@register("delete")
def delete(store: Store, name: str) -> DataFrame:
    _known(store, name)
    store.delete_snapshot(name)
    return listed(store)


@register("gc")
def collect(store: Store, dry_run: str = "false") -> DataFrame:
    """How many chunks no file has; they go, unless it is a dry run."""
    if dry_run.lower() == "true":
        n = verify.orphans(store.table("chunks"), store.table("file_chunks")).count()
    else:
        n = store.collect_garbage()
    return store.spark.range(1).select(F.lit(n).cast("long").alias("n_chunks"))


@register("dedup")
def dedup(store: Store) -> DataFrame:
    return metrics.dedup_summary(store.table("file_chunks"))


def main(arguments: list[str]) -> int:
    if len(arguments) < 2 or any("=" not in a for a in arguments[2:]):
        print(__doc__.strip(), "Commands: " + ", ".join(sorted(COMMANDS)), sep="\n\n", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    try:
        run(Store(spark, arguments[0]), arguments[1], **dict(a.split("=", 1) for a in arguments[2:])).show(1000, truncate=False)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
