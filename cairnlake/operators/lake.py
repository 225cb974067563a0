"""The lake catalogue: lifecycle, deletion, reconciliation, compaction, shadow rebuilds, replay."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.sources.scratch import stored

#: Allowed transitions of a catalogue entry (fixed values).
TRANSITIONS = {
    "STAGED": ("DURABLE", "FAILED"),
    "DURABLE": ("VERIFIED", "QUARANTINED"),
    "VERIFIED": ("COMPACTED", "COLD", "DELETION_PENDING", "QUARANTINED"),
    "COMPACTED": ("COLD", "DELETION_PENDING", "QUARANTINED"),
    "COLD": ("VERIFIED", "DELETION_PENDING", "QUARANTINED"),
    "QUARANTINED": ("VERIFIED", "DELETION_PENDING"),
    "DELETION_PENDING": ("DELETED", "VERIFIED"),
}
IDENTITY = ("tenant_id", "source_id", "type_code", "tier", "content_hash", "media_type", "size_bytes", "retention_class", "label", "created_at")
#: Entries that a task packs, about.
PACKED_ENTRIES = 50_000
MOST_INPUTS, MOST_BYTES = 100, 64 << 20


def lake_key(tenant: Column, tier: Column, content: Column) -> Column:
    """Content-addressed locator."""
    return F.concat_ws("/", F.lit("lake"), tenant, F.lower(tier), F.sha2(content, 256))


def store_objects(incoming: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """New catalogue rows for incoming(tenant_id, source_id, type_code, tier, content): one per
    (tenant, tier, hash, source, type), without those the catalogue has."""
    keys = ["tenant_id", "tier", "content_hash", "source_id", "type_code"]
    rows = incoming.withColumn("content_hash", F.sha2("content", 256)).withColumn("locator", lake_key(F.col("tenant_id"), F.col("tier"), F.col("content"))).withColumn("size_bytes", F.octet_length("content").cast("long"))
    rows = rows.groupBy(*keys).agg(F.min("locator").alias("locator"), F.min("size_bytes").alias("size_bytes"))
    return rows if catalogue is None else rows.join(catalogue.select(*keys), keys, "left_anti")


def write_checks(writes: DataFrame, most_bytes: int = 50 * 1_000_000) -> DataFrame:
    """writes(content_base64, zone, declared_hash) with problem: BASE64, TOO_LARGE, ZONE, HASH or null."""
    raw = F.try_to_binary("content_base64", F.lit("base64"))
    problem = F.when(raw.isNull(), "BASE64").when(F.octet_length(raw) > most_bytes, "TOO_LARGE").when(~F.coalesce(F.col("zone").isin("RAW", "NORMALIZED", "CURATED"), F.lit(False)), "ZONE").when(~F.coalesce(F.col("declared_hash") == F.sha2(raw, 256), F.lit(False)), "HASH")
    return writes.withColumn("problem", problem)


def transition_problems(before: DataFrame, after: DataFrame, transitions: Mapping[str, Sequence[str]] = TRANSITIONS) -> DataFrame:
    """(lake_id, problem) of changes the guard refuses: VANISHED, IDENTITY, STATUS, VERSION. A row
    of which nothing changed is no change."""
    a = before.select("lake_id", F.struct(*[c for c in before.columns if c != "lake_id"]).alias("a"))
    b = after.select("lake_id", F.struct(*[c for c in after.columns if c != "lake_id"]).alias("b"))
    rows = a.join(b, "lake_id", "left")
    same = F.lit(True)
    for c in IDENTITY:
        if c in before.columns:
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    allowed = F.lit(False)
    for x, ys in transitions.items():
        allowed = allowed | ((F.col("a.status") == x) & F.col("b.status").isin(*ys))
    untouched = F.lit(True)
    for c in set(before.columns) & set(after.columns) - {"lake_id"}:
        untouched = untouched & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    problem = F.when(F.col("b").isNull(), "VANISHED").when(~same, "IDENTITY").when(untouched, F.lit(None)).when((F.col("a.status") != F.col("b.status")) & ~allowed, "STATUS").when(F.col("b.version") != F.col("a.version") + 1, "VERSION")
    return rows.select("lake_id", problem.alias("problem")).filter("problem IS NOT NULL")


def deletion_blocks(now: Column) -> Column:
    """Why a catalogue row may not be deleted, sorted; empty if it may."""
    tests = {
        "EXPORT": F.coalesce(F.col("open_exports"), F.lit(0)) > 0,
        "LEGAL_HOLD": F.coalesce(F.col("legal_hold"), F.lit(False)) | (F.col("retention_class") == "LEGAL_HOLD"),
        "LINEAGE": F.coalesce(F.col("lineage_refs"), F.lit(0)) > 0,
        "REPLAY": F.coalesce(F.col("replay_needed"), F.lit(False)),
        "RETENTION": F.col("retain_until").isNull() | (F.col("retain_until") > now),
    }
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), k) for k, t in tests.items()]), lambda x: x.isNotNull())


def purge_due(catalogue: DataFrame, now: Column, most: int) -> DataFrame:
    """Rows to delete now, oldest first, with the locator to delete: the previous one if any."""
    due = catalogue.filter((F.col("status") == "DELETION_PENDING") & (F.col("purge_after") <= now))
    return due.orderBy("purge_after", "lake_id").limit(most).withColumn("delete_locator", F.coalesce("previous_locator", "locator"))


def reconcile(catalogue: DataFrame, inventory: DataFrame) -> DataFrame:
    """Findings of a catalogue(lake_id, locator, content_hash, status) against an inventory(locator,
    content_hash): MISSING_OBJECT and CHECKSUM_MISMATCH (CRITICAL), ORPHAN_STORAGE (HIGH).
    Deleted and compacted entries aren't looked for."""
    own = catalogue.filter("status NOT IN ('DELETED', 'COMPACTED')").select("lake_id", F.col("locator"), F.col("content_hash").alias("a"))
    held = catalogue.filter("status = 'COMPACTED'").select("locator")
    there = inventory.select("locator", F.col("content_hash").alias("b"), F.lit(True).alias("_there"))
    rows = own.join(there, "locator", "full_outer")
    finding = F.when(F.col("_there").isNull(), "MISSING_OBJECT").when(F.col("lake_id").isNull(), "ORPHAN_STORAGE").when(~F.col("a").eqNullSafe(F.col("b")), "CHECKSUM_MISMATCH")
    rows = rows.withColumn("finding", finding).filter("finding IS NOT NULL")
    orphans = rows.filter("finding = 'ORPHAN_STORAGE'").join(held, "locator", "left_anti")
    rows = rows.filter("finding <> 'ORPHAN_STORAGE'").unionByName(orphans)
    return rows.select("lake_id", "locator", "finding", F.when(F.col("finding") == "ORPHAN_STORAGE", "HIGH").otherwise("CRITICAL").alias("severity"))


def compaction_plan(catalogue: DataFrame, boundary: Sequence[str] = ("tenant_id", "tier", "retention_class", "label"), most_inputs: int = MOST_INPUTS, most_bytes: int = MOST_BYTES, packed: int = PACKED_ENTRIES) -> DataFrame:
    """VERIFIED entries with bin_id, position (from 1) and logical_offset in their bin, or with the
    reason why they are in none: TOO_LARGE (over most_bytes alone) or SINGLE_INPUT.

    In id order an entry joins its boundary's open bin if that stays within most_bytes and
    most_inputs, and else opens the next; a bin of one entry isn't packed. The order is cut into
    blocks of about `packed` entries. Where a block's first new bin begins decides the rest of it,
    and that is among its first most_inputs entries, so each block tells for each of these how its
    last bin ends; only that passes through one task a boundary, then the blocks are packed apart.
    """
    own = list(boundary)
    named = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in own])
    rows = catalogue.filter(F.col("status") == "VERIFIED").select("lake_id", named.alias("_k"), F.col("size_bytes").cast("long").alias("size_bytes"))
    fits = rows.filter(F.col("size_bytes") <= most_bytes)
    blocks = max(1, math.ceil(fits.count() / packed))
    fits = stored(fits.repartitionByRange(blocks, "_k", "lake_id").withColumn("_block", F.spark_partition_id()), "blocks")

    def ends(block: pd.DataFrame) -> pd.DataFrame:
        sizes = block.sort_values("lake_id", kind="stable")["size_bytes"].to_numpy()
        n, sums = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
        after = np.minimum(np.searchsorted(sums, sums[:-1] + most_bytes, side="right") - 1, np.arange(n) + most_inputs)
        last, opened = np.arange(n), np.ones(n, "int64")
        for i in range(n - 1, -1, -1):
            if after[i] < n:
                last[i], opened[i] = last[after[i]], opened[after[i]] + 1
        head = min(most_inputs, n)
        lists = [x.tolist() for x in (sizes[:head], opened[:head], sums[n] - sums[last[:head]], n - last[:head])]
        return pd.DataFrame([(block["_k"].iloc[0], block["_block"].iloc[0], n, *lists)], columns=["_k", "_block", "n", "sizes", "opened", "held", "inputs"])

    def carry(found: pd.DataFrame) -> pd.DataFrame:
        out, no, held, inputs = [], 0, 0, 0
        for b in found.sort_values("_block").itertuples(index=False):
            out.append((b[0], b[1], no, held, inputs))
            for i, size in enumerate(b.sizes):
                if not inputs or held + size > most_bytes or inputs == most_inputs:
                    no, held, inputs = no + (inputs > 0) + b.opened[i] - 1, b.held[i], b.inputs[i]
                    break
                held, inputs = held + size, inputs + 1
        return pd.DataFrame(out, columns=["_k", "_block", "_no", "_held", "_inputs"])

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("lake_id", kind="stable")
        no, held, n = (int(block[c].iloc[0]) for c in ("_no", "_held", "_inputs"))
        bins, positions, offsets = [], [], []
        for size in block["size_bytes"]:
            if n and (held + size > most_bytes or n == most_inputs):
                held, n, no = 0, 0, no + 1
            bins.append(no), positions.append(n + 1), offsets.append(held)
            held, n = held + size, n + 1
        return block[["lake_id", "_k"]].assign(bin_no=bins, position=positions, logical_offset=offsets)

    at = fits.groupBy("_k", "_block").applyInPandas(ends, "_k string, _block int, n long, sizes array<long>, opened array<long>, held array<long>, inputs array<long>")
    start = at.groupBy("_k").applyInPandas(carry, "_k string, _block int, _no long, _held long, _inputs long")
    done = fits.join(start, ["_k", "_block"]).groupBy("_k", "_block").applyInPandas(pack, "lake_id string, _k string, bin_no long, position long, logical_offset long")
    inputs = F.count(F.lit(1)).over(Window.partitionBy("_k", "bin_no"))
    done = done.withColumn("reason", F.when(inputs < 2, "SINGLE_INPUT"))
    in_bin = lambda c: F.when(F.col("reason").isNull(), c)
    bin_id = F.md5(F.concat_ws("|", "_k", F.lit("0"), F.col("bin_no").cast("string")))
    out = done.select("lake_id", in_bin(bin_id).alias("bin_id"), in_bin(F.col("position")).alias("position"), in_bin(F.col("logical_offset")).alias("logical_offset"), "reason")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("bin_id", "string"), ("position", "long"), ("logical_offset", "long"))]
    rest = rows.filter(F.coalesce(F.col("size_bytes") > most_bytes, F.lit(True)))
    return out.unionByName(rest.select("lake_id", *none, F.when(F.col("size_bytes") > most_bytes, "TOO_LARGE").alias("reason")))


def snapshot_digest(catalogue: DataFrame, ranges: int = 256) -> DataFrame:
    """Per tenant the SHA-256 of its ranges' digests, and n entries. A range holds the entries whose
    SHA-256 of the id begins alike, its digest is that of their id:hash:size in id order, joined
    by |; no array holds more than a range's entries or `ranges` digests of a tenant."""
    one = F.concat_ws(":", "lake_id", "content_hash", F.col("size_bytes").cast("string"))
    at = (F.conv(F.substring(F.sha2("lake_id", 256), 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int")
    part = catalogue.groupBy("tenant_id", at.alias("_at")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(one)), "|"), 256).alias("_d"), F.count(F.lit(1)).alias("_n"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("_at", "_d"))), lambda x: F.concat_ws(":", x["_at"].cast("string"), x["_d"]))
    return part.groupBy("tenant_id").agg(F.sha2(F.array_join(lines, "|"), 256).alias("digest"), F.sum("_n").alias("n"))


def shadow_status(plan: DataFrame, copied: DataFrame, current: DataFrame) -> DataFrame:
    """Per planned object: COPY_FAILED, DRIFTED (the current locator or hash moved since) or READY."""
    rows = plan.join(copied.select("lake_id", F.col("content_hash").alias("_c")), "lake_id", "left").join(current.select("lake_id", F.col("locator").alias("_l"), F.col("content_hash").alias("_h")), "lake_id", "left")
    status = F.when(~F.coalesce(F.col("_c") == F.col("content_hash"), F.lit(False)), "COPY_FAILED").when(~(F.col("_l").eqNullSafe(F.col("locator")) & F.col("_h").eqNullSafe(F.col("content_hash"))), "DRIFTED").otherwise("READY")
    return rows.select(*plan.columns, status.alias("shadow_status"))


def backoff_seconds(failures: Column, base: int = 60, most: int = 3600) -> Column:
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(failures, F.lit(30)))).cast("long")


def reference_gate(jobs: DataFrame, known: DataFrame, most_attempts: int = 5) -> DataFrame:
    """jobs(job_id, ref, ref_hash, attempts, failed_at) with gate: PASS, PAUSE (with next_at) or
    QUARANTINE; known: ref, ref_hash."""
    rows = jobs.join(known.select("ref", F.col("ref_hash").alias("_k")), "ref", "left")
    drift = F.col("_k").isNotNull() & (F.col("_k") != F.col("ref_hash"))
    gate = F.when(drift, "QUARANTINE").when(F.col("_k").isNotNull(), "PASS").when(F.col("attempts") >= most_attempts, "QUARANTINE").otherwise("PAUSE")
    wait = backoff_seconds(F.col("attempts"))
    return rows.select(*jobs.columns, gate.alias("gate"), F.when(gate == "PAUSE", wait).alias("wait_s"))


def missing_references(refs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Per plan: refs(plan_id, kind, ref) not in catalogue(kind, ref) as sorted SHA-256 of
    kind and ref, and the baseline hash of all sorted references."""
    seen = catalogue.select("kind", "ref").distinct().withColumn("_ok", F.lit(True))
    rows = refs.select("plan_id", "kind", "ref").distinct().join(seen, ["kind", "ref"], "left")
    line = F.concat_ws("\n", "kind", "ref")
    agg = rows.groupBy("plan_id").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("_ok").isNull(), F.sha2(line, 256)))), ",").alias("missing"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("baseline_hash"), F.count(F.lit(1)).alias("n_refs"))
    return agg.withColumn("replay_status", F.when(F.col("missing") == "", "READY").otherwise("BLOCKED"))


def replayed(handoffs: DataFrame, plan_id: str) -> DataFrame:
    """Handoffs appended again under the plan's id."""
    return handoffs.withColumn("handoff_id", F.concat(F.lit(f"replay-{plan_id}-"), F.col("handoff_id"))).withColumn("replay_of", F.lit(plan_id))


def catalogue_duplicates(entries: DataFrame) -> DataFrame:
    """(kind, ref) that a contract catalogue holds more than once."""
    return entries.groupBy("kind", "ref").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


#: Failures after which a quarantined job may be tried again (fixed values).
RECOVERABLE_STATES = ("VERIFIED", "COMPACTED", "COLD")


def recovery_review(jobs: DataFrame, technical: Sequence[str]) -> DataFrame:
    """jobs with eligible and check: NOT_ELIGIBLE, or READY, MISSING, CONTRACT_INVALID.

    jobs: state, intake_state, failure_code, claimed_by, lease_until, effect_present,
    decision_present, approved_new, lake_state, contract_valid, baseline_hash. A job may be
    retried if it is quarantined for a technical code, unclaimed, without canonical effect, with
    no decision but an approved new identity, and its raw object is there.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    ok = (F.col("state") == "QUARANTINED") & (F.col("intake_state") == "DURABLE") & F.col("failure_code").isin(*technical) & F.col("claimed_by").isNull() & F.col("lease_until").isNull()
    ok = F.coalesce(ok & ~yes("effect_present") & (~yes("decision_present") | yes("approved_new")) & F.col("lake_state").isin(*RECOVERABLE_STATES), F.lit(False))
    check = F.when(~ok, "NOT_ELIGIBLE").when(~yes("contract_valid"), "CONTRACT_INVALID").when(F.col("baseline_hash").isNull(), "MISSING").otherwise("READY")
    return jobs.withColumn("eligible", ok).withColumn("check", check)
