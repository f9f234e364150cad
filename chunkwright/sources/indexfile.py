"""Chunk index files: ``hash|relative path`` a line."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(hash, path); lines without both parts are left out."""
    parts = F.split(F.trim("value"), r"\|", 2)
    return spark.read.text(path).select(parts.alias("p")).where("size(p) = 2 and p[0] <> ''").select(F.col("p")[0].alias("hash"), F.col("p")[1].alias("path"))


def write_index(index: DataFrame, path: str) -> None:
    """Written aside first, so that the old index stays until the new one is whole."""
    spark = index.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    index.select(F.concat_ws("|", "hash", "path").alias("value")).write.text(aside)
    fs.delete(place(path), True)
    if not fs.rename(place(aside), place(path)):
        raise RuntimeError(f"{path} is there again: another writer has been faster")


def retain(index: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries whose hash is in ``hashes``, and the others."""
    return index.join(hashes.select("hash"), "hash", "left_semi"), index.join(hashes.select("hash"), "hash", "left_anti")
