"""A directory tree as a table: the ``fsscan`` data source.

Spark's own file source leaves out hidden and empty files and follows links silently, so the
tree is walked here. Top-level entries are dealt to tasks. Hidden directories, and those that ``prune`` matches, are not
entered if so asked. A directory that cannot be read, or whose
real path is its own ancestor, gives a row with ``error`` and the scan goes on.
"""

from __future__ import annotations

import base64
import os
import pickle
import re
import stat
from collections.abc import Callable, Iterator

from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chunkwright.functions.globs import selected

#: What a visitor may answer: enter a directory or give a row, leave out this entry or subtree, end the scan before it.
CONTINUE, SKIP, STOP = "continue", "skip", "stop"
SCHEMA = (
    "path string, size long, modified_ms long, is_regular boolean, is_symlink boolean, link_target string, real_path string, "
    "allocated long, depth int, error string"
)


class _Entry(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = os.path.abspath(options["path"])
        self.follow = options.get("followlinks", "false").lower() == "true"
        self.depth = int(options.get("maxdepth", str(1 << 30)))
        self.tasks = int(options.get("tasks", "32"))
        self.hidden = options.get("hidden", "true").lower() == "true"
        self.prune = re.compile(options["prune"]) if options.get("prune") else None
        self.visit = pickle.loads(base64.b64decode(options["visit"])) if options.get("visit") else lambda path, directory: CONTINUE

    def enters(self, rel: str) -> bool:
        """False for a directory whose whole subtree is skipped."""
        return (self.hidden or not os.path.basename(rel).startswith(".")) and not (self.prune and self.prune.search(rel))

    def partitions(self) -> list[_Entry]:
        names = sorted(os.listdir(self.root))
        return [_Entry(names[k :: self.tasks]) for k in range(min(self.tasks, len(names)))] or [_Entry([])]

    def read(self, partition: _Entry) -> Iterator[tuple]:
        work = [(name, 1, (os.path.realpath(self.root),)) for name in reversed(partition.names)]
        while work:
            rel, depth, above = work.pop()
            full = os.path.join(self.root, rel)
            try:
                own = os.lstat(full)
                link = stat.S_ISLNK(own.st_mode)
                to = os.stat(full) if link else own
                real = os.path.realpath(full)
                if stat.S_ISDIR(to.st_mode) and (not link or self.follow):
                    answer = self.visit(rel, True)
                    if answer == STOP:
                        return
                    if answer == SKIP or not self.enters(rel):
                        continue
                    if real in above:
                        raise OSError(f"cycle: {real}")
                    if depth < self.depth:
                        work += [(os.path.join(rel, n), depth + 1, (*above, real)) for n in sorted(os.listdir(full), reverse=True)]
                    continue
                answer = self.visit(rel, False)
                if answer == STOP:
                    return
                if answer == SKIP:
                    continue
                yield (rel, to.st_size, to.st_mtime_ns // 1_000_000, stat.S_ISREG(to.st_mode), link, os.readlink(full) if link else None, real, to.st_blocks * 512, depth, None)
            except OSError as e:
                yield (rel, None, None, False, os.path.islink(full), None, None, None, depth, str(e))


class FsScan(DataSource):
    """``spark.read.format("fsscan").option("path", root)``; options followLinks, maxDepth, tasks, hidden, prune (a regular expression over directories' paths)."""

    @classmethod
    def name(cls) -> str:
        return "fsscan"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def scan(spark: SparkSession, root: str, *, links: str = "SKIP", max_depth: int | None = None, tasks: int = 32, hidden: bool = True, prune: str | None = None, visit: Callable[[str, bool], str] | None = None) -> DataFrame:
    """All entries but directories. ``links``: SKIP, RECORD, or FOLLOW (each real file behind links once).

    ``visit`` answers CONTINUE, SKIP or STOP for each path (and whether it is a directory), in path order within a directory; as STOP ends
    the whole scan, one task then walks the tree. Without STOP, ``prune`` does the same in many tasks.
    """
    spark.dataSource.register(FsScan)
    reader = spark.read.format("fsscan").option("path", root).option("tasks", 1 if visit else tasks).option("followLinks", links == "FOLLOW")
    reader = reader.option("hidden", hidden)
    if prune is not None:
        reader = reader.option("prune", prune)
    if visit is not None:
        reader = reader.option("visit", base64.b64encode(CloudPickleSerializer().dumps(visit)).decode())
    if max_depth is not None:
        reader = reader.option("maxDepth", max_depth)
    return with_links(reader.load(), links)


def with_links(rows: DataFrame, links: str) -> DataFrame:
    if links == "SKIP":
        return rows.where("not is_symlink")
    if links == "FOLLOW":
        first = F.row_number().over(W.partitionBy("is_symlink", "real_path").orderBy("path"))
        return rows.withColumn("_n", F.when(F.col("is_symlink") & F.col("error").isNull(), first).otherwise(1)).where("_n = 1").drop("_n")
    return rows


def is_hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def is_sparse(allocated: Column, size: Column) -> Column:
    return allocated < size * 0.9


def filtered(rows: DataFrame, *, include: str | None = None, exclude: str | None = None, min_size: int = 0, max_size: int = 0, hidden: bool = False, max_depth: int | None = None) -> DataFrame:
    """Scan filters; rows with an error stay. Size bounds are inclusive and active above 0."""
    keep = selected(F.col("path"), include, exclude)
    if not hidden:
        keep = ~is_hidden(F.col("path")) & keep
    if min_size > 0:
        keep &= F.col("size") >= min_size
    if max_size > 0:
        keep &= F.col("size") <= max_size
    if max_depth is not None:
        keep &= F.size(F.split("path", "/")) <= max_depth
    return rows.where(F.col("error").isNotNull() | keep) if "error" in rows.columns else rows.where(keep)


def contents(rows: DataFrame, root: str, *, range_bytes: int = 64 << 20) -> DataFrame:
    """(path, chunk_order, content) of regular files in ranges, so that no row holds a large file. An empty file has one empty range."""
    n = F.greatest(F.ceil(F.col("size") / range_bytes), F.lit(1)).cast("int")
    ranges = rows.where("is_regular and error is null").select("path", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_order"))

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, k in zip(batch["path"], batch["chunk_order"], strict=True):
                with open(os.path.join(root, path), "rb") as f:
                    f.seek(int(k) * range_bytes)
                    yield pd.DataFrame({"path": [path], "chunk_order": [k], "content": [f.read(range_bytes)]})

    return ranges.repartition(F.xxhash64("path", "chunk_order")).mapInPandas(run, "path string, chunk_order int, content binary")
