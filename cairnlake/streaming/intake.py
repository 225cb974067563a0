"""Streaming forms of the batch operators: intake by micro-batch, activity windows, late data."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnlake.operators.intake import classify, contract_violations
from cairnlake.operators.serve import parked
from cairnlake.sources.state import Versions

ENVELOPE = "handoff_id string, ingestion_run_id string, ingestion_id string, source_id string, type_code string, source_object_id string, lineage_id string, content_hash string, operation string, mode string, acquired_at string, canonical_payload string, base_revision_ref string, base_content_hash string, event_sequence string"


def take_batch(state: Versions, batch: DataFrame, version: int) -> None:
    """Accepts a batch of envelopes: violations and decisions are written under the batch's
    version, and new handoffs join the accepted ones as that version's increment. A batch that is
    retried writes the same version again."""
    checked = batch.withColumn("violations", contract_violations(batch.columns))
    good = checked.filter(F.size("violations") == 0).withColumn("payload", F.col("canonical_payload")).withColumn("arrival", F.struct("acquired_at", "content_hash", "payload"))
    before = state.current("accepted")
    before = before - 1 if before >= version else before  # a retry
    accepted = state.read("accepted", before) if before else None
    decided = classify(good.select("handoff_id", "content_hash", "payload", "arrival"), accepted).drop("arrival")
    state.write("receipts", decided, version)
    state.write("rejected", checked.filter(F.size("violations") > 0), version)
    fresh = state.read("receipts", version).filter("decision = 'NEW'").select("handoff_id", "content_hash", "payload")
    state.write("accepted", fresh, version, increment=True)


def intake_stream(spark: SparkSession, incoming: str, state_root: str, checkpoint: str) -> StreamingQuery:
    """Reads JSON envelopes that arrive in a folder, until none is left."""
    state = Versions(spark, state_root)
    rows = spark.readStream.schema(ENVELOPE).json(incoming)
    return rows.writeStream.foreachBatch(lambda df, n: take_batch(state, df, n + 1)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_activity(events: DataFrame, width: str = "1 hour", lateness: str | None = None) -> DataFrame:
    """Counts and sums per type and window; with a lateness, for a stream, a watermark."""
    if lateness:
        events = events.withWatermark("ts", lateness)
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.col("value").cast("decimal(20,6)")).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n_events", F.round(F.col("total").cast("double"), 3).alias("total"))


GUARD_STATE, GUARD_OUT = "last long, attempt long, session long", "key string, at timestamp, request_id long, session long, attempt long, state string"


def guard_stream(log: DataFrame, threshold: int = 3, seconds: int = 900, lateness: str = "1 minute") -> DataFrame:
    """admission.retry_guard() for a stream log(key, at, request_id): each key's attempts are
    state that goes after `seconds` without one. Rows that come later than the watermark allows
    are counted when they come."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, attempt, session = state.get if state.exists else (None, 0, 0)
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "request_id"], kind="stable")
        out = []
        for at, request in zip(rows["at"], rows["request_id"], strict=True):
            now = at.value // 1000
            if last is None or now - last >= seconds * 1_000_000:
                attempt, session = 0, session + 1
            last, attempt = now, min(attempt + 1, threshold)
            out.append((key[0], at, request, session, attempt, "STALLED" if attempt >= threshold else "OPEN"))
        state.update((last, attempt, session))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "at", "request_id", "session", "attempt", "state"])

    return log.withWatermark("at", lateness).groupBy("key").applyInPandasWithState(step, GUARD_OUT, GUARD_STATE, "append", GroupStateTimeout.EventTimeTimeout)


class _Budget(StatefulProcessor):
    """One key's budget entry, and its requests that the watermark hasn't passed yet."""

    def __init__(self, names: tuple[str, ...], ceilings: tuple[float, ...], seconds: int):
        self.names, self.ceilings, self.length = names, ceilings, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        amounts = "".join(f", {n} double" for n in self.names)
        self.handle = handle
        self.entry = handle.getValueState("entry", f"until long{amounts}")
        self.waiting = handle.getListState("waiting", f"t long, request_id long{amounts}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            t = part["at"].astype("datetime64[us]").astype("int64")
            first = int(t.min()) if first is None else min(first, int(t.min()))
            self.waiting.appendList(list(zip(t.tolist(), part["request_id"].tolist(), *(part[n].astype("float64").tolist() for n in self.names), strict=True)))
        self.handle.registerTimer(max(-(-first // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in rows if r[0] <= now * 1000]
        rest = rows[len(ready) :]
        until, *used = self.entry.get() if self.entry.exists() else (None, *(0.0 for _ in self.names))
        out = []
        for t, request, *amounts in ready:
            fresh = until is None or t >= until
            sums = amounts if fresh else [u + a for u, a in zip(used, amounts, strict=True)]
            admitted = fresh or all(s <= c for s, c in zip(sums, self.ceilings, strict=True))
            if fresh:
                until = t + self.length
            if admitted:
                used = sums
            out.append((key[0], pd.Timestamp(t, unit="us"), request, admitted))
        self.waiting.clear()
        if until is None or until <= now * 1000 and not rest:
            self.entry.clear()  # whatever comes starts anew
        else:
            self.entry.update((until, *used))
        if rest:
            self.waiting.put(rest)
        if rest or until is not None and until > now * 1000:
            self.handle.registerTimer(max(-(-(rest[0][0] if rest else until) // 1000), now + 1))
        yield pd.DataFrame(out, columns=["key", "at", "request_id", "admitted"])

    def close(self) -> None:
        pass


def budget_stream(log: DataFrame, amounts: Mapping[str, str], ceilings: Mapping[str, float], seconds: int = 900, lateness: str = "1 minute") -> DataFrame:
    """admission.admit() for a stream log(key, at, request_id, amounts): key, at, request_id, admitted.

    Requests may come in any order within the lateness: they wait in the key's state until the
    watermark has passed them and are then decided in order of (at, request_id), so the outcome is
    the batch's. An entry goes from the state when its time is over; later arrivals than the
    watermark allows are left out, as are requests without a time. The session needs a state store of RocksDB
    (spark.sql.streaming.stateStore.providerClass).
    """
    names = tuple(amounts)
    rows = log.filter("at IS NOT NULL").select(F.col("key").cast("string").alias("key"), "at", F.col("request_id").cast("long").alias("request_id"), *[F.col(amounts[n]).cast("double").alias(n) for n in names])
    step = _Budget(names, tuple(float(ceilings[n]) for n in names), seconds)
    return rows.withWatermark("at", lateness).groupBy("key").transformWithStateInPandas(step, "key string, at timestamp, request_id long, admitted boolean", "append", "eventTime")


def release_parked(state: Versions, batch: DataFrame, now: datetime, version: int) -> None:
    """Observations whose validity begins later wait; each tick writes what became due, the
    batch's own and the waiting ones', and keeps the rest for the next."""
    before = state.current("parked")
    before = before - 1 if before >= version else before  # a retry
    rows = batch if not before else batch.unionByName(state.read("parked", before))
    marked = parked(rows, F.lit(now))
    state.write("released", marked.filter("state <> 'PARKED'").drop("state"), version)
    state.write("parked", marked.filter("state = 'PARKED'").drop("state"), version)
