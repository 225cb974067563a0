"""Keyset pages: no offset, one row more than asked to see whether there is a next page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.hashing import decode_cursor, encode_cursor

MOST_ROWS = 100


def page_size(n: int, most: int = MOST_ROWS) -> int:
    if not 1 <= n <= most:
        raise ValueError(f"a page has 1 to {most} rows")
    return n


def page(df: DataFrame, key: str, size: int, cursor: str | None = None, descending: bool = False) -> DataFrame:
    """Rows behind the cursor in key order, one more than size."""
    if cursor is not None:
        at = F.lit(decode_cursor(cursor)).cast(df.schema[key].dataType)
        df = df.filter(F.col(key) < at if descending else F.col(key) > at)
    return df.orderBy(F.col(key).desc() if descending else F.col(key).asc()).limit(page_size(size) + 1)


def next_cursor(paged: DataFrame, key: str, size: int) -> DataFrame:
    """One row: rows on the page, truncated, next_cursor (null on the last page)."""
    rows = paged.agg(F.sort_array(F.collect_list(F.col(key).cast("string"))).alias("keys"))  # size + 1 at most
    more = F.size("keys") > size
    return rows.select(F.least(F.size("keys"), F.lit(size)).cast("long").alias("n_rows"), more.alias("truncated"), F.when(more, encode_cursor(F.col("keys")[size - 1])).alias("next_cursor"))
