"""Object scans and contract catalogues as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_objects(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """An inventory of the files below a path: locator, size_bytes, content_hash, modified_at."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("locator"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("modified_at"))


CONTRACT = "kind string, ref string, version string, hash string, status string"


def load_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) entries of a JSON-lines contract catalogue: bad ones lack a field, aren't
    ACTIVE or RETIRED, have no SHA-256 or share kind and ref with another."""
    rows = spark.read.schema(CONTRACT).json(path)
    fine = F.lit(True)
    for c in ("kind", "ref", "version"):
        fine = fine & F.coalesce(F.trim(c) != "", F.lit(False))
    fine = fine & F.coalesce(F.col("hash").rlike("^(sha256:)?[0-9a-f]{64}$"), F.lit(False)) & F.coalesce(F.col("status").isin("ACTIVE", "RETIRED"), F.lit(False))
    again = rows.groupBy("kind", "ref").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(again, ["kind", "ref"], "left").withColumn("_ok", fine & (F.coalesce("_n", F.lit(1)) == 1)).drop("_n")
    return rows.filter("_ok").drop("_ok"), rows.filter("NOT _ok").drop("_ok")
