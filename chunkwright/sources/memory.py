"""A store whose tables are in the driver's memory: for tests and small sessions.

It has the operations of ``Store``; nothing is written to a folder, and all is gone with the session.
A change that would take the tables beyond ``max_bytes`` is refused, and the store stays as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkwright.operators import model
from chunkwright.sources.store import Store


class MemoryStore(Store):
    def __init__(self, spark: SparkSession, *, max_bytes: int = 256 << 20) -> None:
        super().__init__(spark, "memory")
        self.max_bytes = max_bytes
        self._now = {t: self._held(spark.createDataFrame([], model.schema(t)), t) for t in model.SCHEMAS}

    def _held(self, df: DataFrame, table: str):
        return df.select(*(df[f.name].cast(f.dataType) for f in model.schema(table))).toArrow()

    def version(self) -> int:
        return model.VERSION

    def migrate(self) -> bool:
        return False

    def problems(self) -> list[str]:
        return [t for t in model.SCHEMAS if not model.fits(self.table(t), t)]

    def vacuum(self, keep: int = 1) -> int:
        return 0

    def table(self, name: str) -> DataFrame:
        return self.spark.createDataFrame(self._now[name], model.schema(name))

    def commit(self, appended: dict[str, DataFrame] | None = None, replaced: dict[str, DataFrame] | None = None) -> None:
        new = {t: self._held(df, t) for t, df in (replaced or {}).items()}
        new |= {t: self._held(self.table(t).unionByName(df.select(*model.schema(t).names)), t) for t, df in (appended or {}).items()}
        size = sum(held.nbytes for held in (self._now | new).values())
        if size > self.max_bytes:
            raise MemoryError(f"the tables would have {size} bytes, more than {self.max_bytes}")
        self._now |= new

    def _stage(self, rows: DataFrame, home: str = "_staged") -> tuple[DataFrame, str | None]:
        return self.spark.createDataFrame(rows.toArrow(), rows.schema), None
