"""Requests: routing, fingerprints, retry guards and budgets, over a log of calls.

A budget's entries follow one another: the first request behind the end of one starts the next, so
where an entry starts depends on all before it. Time is cut into blocks of a few entries' length. What
a block makes of the entry that it begins with is a step function of that entry's end; the functions
are found block by block, wherever the blocks lie, and only they pass through one task a key. Then
every block knows how it begins, entries are told apart, and each is a fold of its own.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ceilings of one budget entry, and how long it lasts.
GRAPH_CEILINGS = {"graph_calls": 20, "calls": 30, "nodes": 2000, "edges": 4000, "bytes": 2 << 20, "millis": 20_000}
SPATIAL_CEILINGS = {"calls": 30, "rows": 2000, "bytes": 2 << 20, "millis": 15_000, "radius_m": 100_000, "area_km2": 5000}
ENTRY_SECONDS = 900
#: Lengths of an entry in a block of time; the end of an entry before all others.
BLOCK_ENTRIES, NEVER = 4, -(1 << 62)

ROUTES = {
    "RECURSIVE_HIERARCHY": ("PASS", None),
    "ANALYTICAL_COMPOSITE": ("REJECT", None),
    "CROSS_DOMAIN_RELATIONSHIP": ("REDIRECT", "related_search"),
    "SPATIAL": ("REDIRECT", "nearby"),
    "EXPLORATORY_ONE_HOP": ("REDIRECT", "neighbors"),
}


def route(purpose: Column) -> Column:
    """struct(decision, use, retryable) of a traversal request's purpose; others are rejected."""
    decision, use = F.lit("REJECT"), F.lit(None).cast("string")
    for name, (d, u) in ROUTES.items():
        decision = F.when(purpose == name, d).otherwise(decision)
        use = F.when(purpose == name, F.lit(u).cast("string")).otherwise(use)
    return F.struct(decision.alias("decision"), use.alias("use"), (decision == "REDIRECT").alias("retryable"))


def fingerprint(capability: Column, purpose: Column, start: Column, relations: Column) -> Column:
    """SHA-256 of capability, purpose, start and the distinct sorted trimmed relations, by line."""
    clean = F.array_sort(F.array_distinct(F.transform(relations, lambda r: F.trim(r))))
    return F.sha2(F.concat_ws("\n", capability, purpose, start, F.array_join(clean, "\n")), 256)


def retry_guard(log: DataFrame, threshold: int = 3, seconds: int = ENTRY_SECONDS) -> DataFrame:
    """log(key, at, request_id) with attempt and state OPEN or STALLED. A pause of `seconds` or
    more since the key's last attempt starts anew; from the threshold on it stays STALLED."""
    w = Window.partitionBy("key").orderBy("at", "request_id")
    gap = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lag("at").over(w).cast("timestamp"))
    rows = log.withColumn("_new", F.coalesce((gap >= seconds * 1_000_000).cast("int"), F.lit(1)))
    rows = rows.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    attempt = F.row_number().over(Window.partitionBy("key", "session").orderBy("at", "request_id"))
    return rows.withColumn("attempt", F.least(attempt, F.lit(threshold)).cast("long")).withColumn("state", F.when(attempt >= threshold, "STALLED").otherwise("OPEN")).drop("_new")


def _exits(t: list[int], begin: int, length: int) -> tuple[list[int], list[int]]:
    """How entries leave a block from `begin` with requests at times t, ascending: where the block
    begins with an entry that lasts until u, its last one lasts until exits[i] for the first
    upto[i] >= u, and until u if there is none. u is below begin + length."""
    n = len(t)
    last, follows = list(t), n  # by the request an entry starts with: the last start that comes of it
    for i in range(n - 1, -1, -1):
        while follows and t[follows - 1] >= t[i] + length:
            follows -= 1
        if follows < n:
            last[i] = last[follows]
    asked = range(min(n, bisect.bisect_left(t, begin + length) + 1))
    ends = [i for i in asked if i + 1 == len(asked) or last[i] != last[i + 1]]  # equal exits in a row are one step
    return [t[i] for i in ends], [last[i] + length for i in ends]


def _starts(t: list[int], until: int, length: int) -> list[int]:
    """When the entries started that hold requests of a block, the one it begins with first."""
    out = [until - length] if t[0] < until else []
    while (i := bisect.bisect_left(t, until)) < len(t):
        out.append(t[i])
        until = t[i] + length
    return out


def _longs(lists: list) -> pa.Array:
    return pa.array(lists, pa.list_(pa.int64()))


def _steps(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_exits(t, k * BLOCK_ENTRIES * length, length) for k, t in zip(b["block"].to_pylist(), b["times"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["key"], b["block"], *(_longs([m[i] for m in made]) for i in (0, 1))], ["key", "block", "upto", "exits"])

    return run


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks by key and time, until when the entry lasts that each begins with."""
    key, until = object(), NEVER
    for b in batches:
        out = []
        for k, upto, exits in zip(b["key"].to_pylist(), b["upto"].to_pylist(), b["exits"].to_pylist(), strict=True):
            if k != key:
                key, until = k, NEVER
            out.append(until)
            i = bisect.bisect_left(upto, until)
            until = exits[i] if i < len(exits) else until
        yield pa.RecordBatch.from_arrays([b["key"], b["block"], pa.array(out, pa.int64())], ["key", "block", "until"])


def _parted(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_starts(t, u, length) for t, u in zip(b["times"].to_pylist(), b["until"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["key"], b["block"], _longs(made)], ["key", "block", "starts"])

    return run


def entries(log: DataFrame, seconds: int = ENTRY_SECONDS) -> DataFrame:
    """log(key, at, ...) with t, its time in microseconds, and entry, the time at which its budget entry started. Requests
    without a time have no entry; a null key is a key. No key's log is one array or one window: a
    task holds a block of BLOCK_ENTRIES entries' length, or one key's steps one after another."""
    length = seconds * 1_000_000
    key = f"key {log.schema['key'].dataType.simpleString()}"
    span = length * BLOCK_ENTRIES
    rows = log.withColumn("t", F.unix_micros(F.col("at").cast("timestamp"))).withColumn("block", F.expr(f"(t - pmod(t, {span}L)) div {span}L"))
    blocks = rows.filter("t IS NOT NULL").groupBy("key", "block").agg(F.array_sort(F.collect_set("t")).alias("times"))
    steps = blocks.mapInArrow(_steps(length), f"{key}, block long, upto array<long>, exits array<long>")
    begins = steps.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_carried, f"{key}, block long, until long")
    same = lambda a, b: a["key"].eqNullSafe(b["key"]) & (a["block"] == b["block"])
    starts = blocks.join(begins, same(blocks, begins)).select(blocks["key"], blocks["block"], "times", "until").mapInArrow(_parted(length), f"{key}, block long, starts array<long>")
    out = rows.join(starts, same(rows, starts), "left").withColumn("entry", F.array_max(F.filter("starts", lambda s: s <= F.col("t"))))
    return out.select(*(rows[c] for c in log.columns), "t", "entry")


def admit(log: DataFrame, amounts: Mapping[str, str], ceilings: Mapping[str, int], seconds: int = ENTRY_SECONDS) -> DataFrame:
    """Per key: requests, accepted, rejected, and the sum of each accepted amount.

    log: key, at, request_id and the amount columns; amounts maps a ceiling's name to its column.
    A request that would pass a ceiling is rejected and adds nothing; so is one without a time. An
    entry's first request is accepted untested and fixes its end; behind it the next request
    starts a new entry. An entry's requests, those of `seconds`, are folded in order of (at,
    request_id).
    """
    names = list(amounts)
    one = F.struct("t", "request_id", *[F.col(amounts[n]).cast("double").alias(n) for n in names])
    calls = entries(log, seconds).groupBy("key", "entry").agg(F.sort_array(F.collect_list(one)).alias("r"))
    zero = F.struct(F.lit(0).cast("long").alias("accepted"), *[F.lit(0.0).alias(n) for n in names])

    def step(s: Column, x: Column) -> Column:
        fits = F.lit(True)
        for n in names:
            fits = fits & (s[n] + x[n] <= float(ceilings[n]))
        ok = F.coalesce((s["accepted"] == 0) | fits, F.lit(False))
        return F.struct(F.when(ok, s["accepted"] + 1).otherwise(s["accepted"]).alias("accepted"), *[F.when(ok, s[n] + x[n]).otherwise(s[n]).alias(n) for n in names])

    timed = F.when(F.col("entry").isNotNull(), F.aggregate("r", zero, step)).otherwise(zero)
    out = calls.select("key", F.size("r").cast("long").alias("n"), timed.alias("s")).groupBy("key").agg(F.sum("n").alias("requests"), F.sum("s.accepted").alias("accepted"), *[F.sum(f"s.{n}").alias(f"sum_{n}") for n in names])
    return out.select("key", "requests", "accepted", (F.col("requests") - F.col("accepted")).alias("rejected"), *[f"sum_{n}" for n in names])
