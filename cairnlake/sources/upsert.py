"""Keyed tables kept by upserts: buckets by key hash, of which a change rewrites only those it touches.

root/table/b=<bucket>-<version>/ holds a bucket; root/table/_manifest/<version>/ lists the current
version of every bucket and is written last. Readers take the newest whole manifest, so a run that
fails half way leaves what it wrote unseen, and is simply run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tasks that may write one bucket.
SPREAD = 32


class Upserts:
    def __init__(self, spark: SparkSession, root: str, key: Sequence[str], buckets: int = 64, deal: Sequence[str] | None = None):
        """deal: the columns of the key that rows are dealt to buckets by; all of them, if not given."""
        self.spark, self.root, self.key, self.buckets, self.deal = spark, root.rstrip("/"), list(key), buckets, list(deal or key)

    def version(self) -> int:
        """The number of the newest whole manifest, 0 if there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))), default=0)

    def _versions(self) -> dict[int, int]:
        """bucket -> version by that manifest; at most as many rows as buckets."""
        n = self.version()
        rows = self.spark.read.schema("bucket int, version int").json(f"{self.root}/_manifest/{n}").collect() if n else []
        return {r.bucket: r.version for r in rows}

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.deal), F.lit(self.buckets)).cast("int")

    def read(self, schema: str) -> DataFrame:
        """All current rows; an unwritten table is empty."""
        return self._of(self._versions(), schema)

    def _of(self, versions: dict[int, int], schema: str) -> DataFrame:
        paths = [f"{self.root}/v{v}/b={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def apply(self, changes: DataFrame, order: str, deleted: str = "deleted") -> int:
        """Per key the change of the greatest `order` counts: it replaces the row, or takes it away if
        `deleted`. changes have the table's columns and these two, order being one of the table's
        or not. Returns the number of buckets that were rewritten."""
        kept = [c for c in changes.columns if c != deleted]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.select(*kept).schema)
        last = changes.withColumn("_n", F.row_number().over(Window.partitionBy(*self.key).orderBy(F.col(order).desc()))).filter("_n = 1").drop("_n").withColumn("_b", self._bucket())
        touched = sorted(r._b for r in changes.select(self._bucket().alias("_b")).distinct().collect())  # no more than buckets
        if not touched:
            return 0
        versions = self._versions()
        old = self._of({b: v for b, v in versions.items() if b in set(touched)}, schema)
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.key]
        newer = last.select(*self.key, F.col(order).alias("_at"), F.lit(True).alias("_new")).alias("n")
        stay = old.alias("o").join(newer, same, "left").filter(F.col("_new").isNull() | (F.col(f"o.{order}") > F.col("_at"))).select("o.*").withColumn("_b", self._bucket())
        fresh = last.join(old.select(*self.key, F.col(order).alias("_was")), self.key, "left").filter(F.col("_was").isNull() | (F.col(order) >= F.col("_was"))).filter(f"NOT coalesce({deleted}, false)").select(*kept, "_b")
        version = self.version() + 1
        # a large bucket is written by several tasks; adaptive execution merges those of small ones
        stay.unionByName(fresh).repartition("_b", F.pmod(F.hash(*self.key), F.lit(SPREAD))).withColumn("b", F.col("_b")).drop("_b").write.mode("overwrite").partitionBy("b").parquet(f"{self.root}/v{version}")
        written = {r.b for r in self.spark.read.parquet(f"{self.root}/v{version}").select("b").distinct().collect()} if self._any(version) else set()
        now = {b: v for b, v in versions.items() if b not in touched} | {b: version for b in touched if b in written}
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").json(f"{self.root}/_manifest/{version}")
        return len(touched)

    def _any(self, version: int) -> bool:
        """Whether a version has any bucket: one that only deletes may leave none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v{version}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(path) and any(s.getPath().getName().startswith("b=") for s in fs.listStatus(path))
