"""Versioned tables: state/<table>/v=<n>/, the current version named by a pointer written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, table: str) -> str:
        return f"{self.root}/{table}/_current"

    def current(self, table: str) -> int:
        """0 if the table was never written. Pointers are tiny tables, one a version."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._pointer(table))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return 0
        return self._pointers(table).agg(F.max("version")).first()[0] or 0

    def _pointers(self, table: str) -> DataFrame:
        return self.spark.read.schema("version long, increment boolean").json(self._pointer(table))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        n = self.current(table) if version is None else version
        if not n:
            raise LookupError(f"{table} has no version yet")
        added = self._pointers(table).filter(F.col("increment") & (F.col("version") <= n)).select("version").distinct()
        versions = sorted({r.version for r in added.collect()}) or [n]  # an appended table is all its increments
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/v={v}" for v in versions]).drop("v")

    def write(self, table: str, df: DataFrame, version: int | None = None, increment: bool = False) -> int:
        """Writes a version, whole or as an increment to those before, then the pointer. A version
        that a failed run left half written is written again; readers never see it."""
        n = self.current(table) + 1 if version is None else version
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/v={n}")
        self.spark.createDataFrame([(n, increment)], "version long, increment boolean").coalesce(1).write.mode("append").json(self._pointer(table))
        return n
