"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these ASCII blanks.
BLANK = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@functools.cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="cairnlake-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; a
    folder of our own only where that is unset and one machine does all, as in local tests."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{_own_dir()}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and
    a lost executor costs no more than the read."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remembered(name: str, key: Any, make: Callable[[], Any]) -> Any:
    """make(), once in this worker process for the name and key: tasks that follow each other
    share it. Only the last key of a name stays."""
    memory = sys.modules.setdefault("_cairnlake_memory", types.ModuleType("_cairnlake_memory")).__dict__
    if name not in memory or memory[name][0] != key:
        memory[name] = (key, make())
    return memory[name][1]


def release() -> None:
    """Gives free memory of a Python worker back to the system: workers are kept between tasks, and
    several of them share an executor's room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z become a-z; no other letter changes."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text, null counting as empty (long)."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{BLANK}+", "")
    parts = F.split(body, rf"{BLANK}+")
    return (F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)).cast("long")
