"""Report sinks: any result as CSV, JSON lines or aligned text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, width: int = 24) -> None:
    """One line a row, columns padded to ``width``."""
    cells = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), width, " ") for c in df.columns]
    df.select(F.rtrim(F.concat_ws(" ", *cells)).alias("value")).write.mode("overwrite").text(path)
