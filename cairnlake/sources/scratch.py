"""Tables written between the steps of one job."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="cairnlake-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; a folder of our
    own only where that is unset and one machine does all, as in tests."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{_own_dir()}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and a lost
    executor costs no more than the read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt to two tasks a core, for work that costs more than an exchange: a file is read by
    no more tasks than it has row groups."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
