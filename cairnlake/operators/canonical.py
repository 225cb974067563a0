"""Canonical state: which value wins, immutable revisions, deltas, bitemporal intervals.

contributions: object_id, property, source_id, value, observed_at, created_at,
contribution_id (and for linked rules record_id, revision, authority_rank, valid_from,
valid_to, deleted). All steps are windows and aggregates per object and property.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.text import decimal_text, nfc_trim

#: Rank of sources that the authority order doesn't name.
UNRANKED = 10_000
#: Registered source systems that a running winner can tell apart.
MOST_SOURCES = 256


def latest_per_source(contributions: DataFrame) -> DataFrame:
    """Each source's latest contribution per object and property."""
    w = Window.partitionBy("object_id", "property", "source_id").orderBy(F.col("observed_at").desc_nulls_last(), F.col("created_at").desc(), "contribution_id")
    return contributions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def authority_rank(source: Column, order: Sequence[str]) -> Column:
    """Place in the current rule's order."""
    rank = F.lit(UNRANKED)
    for i, s in enumerate(order):
        rank = F.when(source == s, i).otherwise(rank)
    return rank


def property_winners(contributions: DataFrame, order: Sequence[str], decisions: DataFrame | None = None) -> DataFrame:
    """(object_id, property, status, value, source_id, n_values): SELECTED, CONFLICT (value null)
    or HUMAN_SELECTED.

    Of each source's latest contribution those of the best rank compete; several different
    values conflict unless a decision(object_id, property, evidence_hash, value) was made on
    exactly this evidence; equal values are credited to the first source.
    """
    latest = latest_per_source(contributions).withColumn("_r", authority_rank(F.col("source_id"), order))
    best = F.min("_r").over(Window.partitionBy("object_id", "property"))
    top = latest.withColumn("_b", best).filter("_r = _b")
    hashed = F.sha2(F.col("value").cast("string"), 256)
    out = top.groupBy("object_id", "property").agg(
        F.count_distinct(hashed).alias("n_values"),
        F.min(F.struct("source_id", "value")).alias("first"),
        F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "source_id", hashed))), "|"), 256).alias("evidence_hash"),
    )
    if decisions is not None:
        made = decisions.select("object_id", "property", "evidence_hash", F.col("value").alias("chosen"), F.lit(True).alias("_d"))
        out = out.join(made, ["object_id", "property", "evidence_hash"], "left")
    else:
        out = out.withColumn("chosen", F.lit(None)).withColumn("_d", F.lit(None).cast("boolean"))
    one = F.col("n_values") == 1
    status = F.when(F.col("_d"), "HUMAN_SELECTED").when(one, "SELECTED").otherwise("CONFLICT")
    return out.select("object_id", "property", status.alias("status"), F.when(F.col("_d"), F.col("chosen")).when(one, F.col("first.value")).alias("value"), F.when(one, F.col("first.source_id")).alias("source_id"), F.col("n_values").cast("long").alias("n_values"), "evidence_hash")


def linked_value(value: Column, datatype: str, normaliser: str = "EXACT_TYPED") -> Column:
    """Canonical text of a linked value; null if it isn't of the datatype."""
    v = value.cast("string")
    if datatype == "string":
        out = nfc_trim(v) if normaliser == "NFC_TRIM" else v
        return F.when(F.trim(out) != "", out)
    if datatype == "number":
        return decimal_text(v)
    if datatype == "integer":
        return F.when(decimal_text(v).rlike(r"^-?\d+$"), decimal_text(v))
    if datatype == "boolean":
        return F.when(F.lower(v).isin("true", "false"), F.lower(v))
    raise ValueError(datatype)


def linked_eligible(rows: DataFrame, now: Column) -> DataFrame:
    """Future rows go before a record's newest revision is chosen, expired ones after, so that
    an expired newest revision doesn't bring back an older one."""
    rows = rows.filter(F.col("valid_from").isNull() | (F.col("valid_from") <= now))
    newest = F.max("revision").over(Window.partitionBy("object_id", "property", "source_id", "record_id"))
    rows = rows.withColumn("_m", newest).filter(F.col("revision").eqNullSafe(F.col("_m"))).drop("_m")
    return rows.filter(F.col("valid_to").isNull() | (F.col("valid_to") > now))


def reconcile_linked(rows: DataFrame, now: Column, datatype: str = "string", multi: bool = False, normaliser: str = "EXACT_TYPED") -> DataFrame:
    """(object_id, property, status, value, members, n_contributions), a row per object and
    property of the input: NO_VALID_CONTRIBUTION, CONFLICT, DELETED or RECONCILED.

    SINGLE keeps the best authority rank and wants one value; MULTI keeps all members, ordered
    by their hash. A deletion beside a value conflicts.
    """
    keys = ["object_id", "property"]
    good = linked_eligible(rows, now).withColumn("norm", linked_value(F.col("value"), datatype, normaliser))
    good = good.filter(F.col("deleted") | F.col("norm").isNotNull())
    if not multi:
        good = good.withColumn("_b", F.min("authority_rank").over(Window.partitionBy(*keys))).filter("authority_rank = _b")
    member = F.when(~F.col("deleted"), F.struct(F.sha2(F.concat(F.lit(f"{datatype}|"), F.col("norm")), 256).alias("h"), F.col("norm").alias("v")))
    agg = good.groupBy(*keys).agg(F.sort_array(F.collect_set(member)).alias("m"), F.max("deleted").alias("del"), F.count(F.lit(1)).alias("n"))
    out = rows.select(*keys).distinct().join(agg, keys, "left")
    size = F.coalesce(F.size("m"), F.lit(0))
    clash = (F.col("del") & (size > 0)) | (F.lit(not multi) & (size > 1))
    status = F.when(F.col("n").isNull(), "NO_VALID_CONTRIBUTION").when(clash, "CONFLICT").when(F.col("del"), "DELETED").otherwise("RECONCILED")
    value = F.when(status == "RECONCILED", F.array_join("m.v", "|") if multi else F.col("m")[0]["v"])
    return out.select(*keys, status.alias("status"), value.alias("value"), F.when(status == "RECONCILED", size).otherwise(0).cast("long").alias("members"), F.coalesce("n", F.lit(0)).cast("long").alias("n_contributions"))


# --- revisions ---


def running_winners(contributions: DataFrame, order: Sequence[str]) -> DataFrame:
    """The property winner as of each contribution: (object_id, property, seq, value, changed).

    contributions also have seq, a total order of arrival per object. The best source of the order
    that has said anything decides by its latest value; without one, the latest values of all other
    sources must agree. As long as they don't, the previous winner stays. Sources are registered
    systems, so they are few: one running window serves them all, a column each.
    """
    found = {r.source_id for r in contributions.select("source_id").distinct().limit(MOST_SOURCES + 1).collect()}
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    others = sorted(s for s in found if s is not None and s not in order)
    key = Window.partitionBy("object_id", "property").orderBy("seq")
    run = key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = contributions
    for i, s in enumerate((*order, *others)):
        mine = F.when(F.col("source_id") == s, F.struct(F.struct("observed_at", "seq").alias("at"), F.col("value")))
        rows = rows.withColumn(f"_s{i}", F.max(mine).over(run)["value"])
    ranked = [F.col(f"_s{i}") for i in range(len(order))]
    rest = F.array_distinct(F.array_compact(F.array(*[F.col(f"_s{i}") for i in range(len(order), len(order) + len(others))]))) if others else None
    rows = rows.withColumn("_w", F.coalesce(*ranked, *([F.when(F.size(rest) == 1, rest[0])] if others else []), F.lit(None)))
    rows = rows.withColumn("winner", F.last("_w", ignorenulls=True).over(run))
    rows = rows.withColumn("_p", F.lag("winner").over(key))
    return rows.select("object_id", "property", "seq", "observed_at", F.col("winner").alias("value"), (~F.col("winner").eqNullSafe(F.col("_p"))).alias("changed"))


def revision_chain(changes: DataFrame, interval: int = 4) -> DataFrame:
    """Revisions from (object_id, property, seq, value) change rows: revision_no, is_checkpoint,
    delta (the changed properties as a sorted text property=value). Revision numbers are dense
    per object; the first and every interval-th after it are checkpoints."""
    step = changes.groupBy("object_id", "seq").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "property", F.col("value").cast("string")))), "|").alias("delta"))
    no = F.row_number().over(Window.partitionBy("object_id").orderBy("seq"))
    return step.withColumn("revision_no", no.cast("long")).withColumn("is_checkpoint", (no - 1) % interval == 0)


def delta(before: Column, after: Column) -> Column:
    """struct(set, remove) between two maps of properties."""
    fresh = F.map_filter(after, lambda k, v: ~before[k].eqNullSafe(v) | ~F.map_contains_key(before, k))
    return F.struct(fresh.alias("set"), F.array_sort(F.array_except(F.map_keys(before), F.map_keys(after))).alias("remove"))


def reconstruct(changes: DataFrame, revisions: DataFrame, upto: int) -> DataFrame:
    """(object_id, revision_no, property, value): the state at revision `upto`, or the last one
    before it: per property the last change up to there. Numbers are dense, so no chain is walked."""
    numbered = changes.join(revisions.select("object_id", "seq", "revision_no"), ["object_id", "seq"]).filter(F.col("revision_no") <= upto)
    last = numbered.groupBy("object_id", "property").agg(F.max(F.struct("revision_no", "value")).alias("x"))
    at = numbered.groupBy("object_id").agg(F.max("revision_no").alias("revision_no"))
    return last.join(at, "object_id").select("object_id", "revision_no", "property", F.col("x.value").alias("value"))


def bitemporal(facts: DataFrame) -> DataFrame:
    """Intervals from facts(object_id, property, value, valid_from, valid_to, system_at): a fact
    equal to the one before it changes nothing; any other closes it. system_to is null for the
    open one."""
    w = Window.partitionBy("object_id", "property").orderBy("system_at")
    same = F.lit(True)
    for c in ("value", "valid_from", "valid_to"):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    kept = facts.withColumn("_same", same & (F.row_number().over(w) > 1)).filter("NOT _same").drop("_same")
    return kept.withColumn("system_from", F.col("system_at")).withColumn("system_to", F.lead("system_at").over(w)).drop("system_at")


def as_of(intervals: DataFrame, valid: Column, system: Column) -> DataFrame:
    """The facts that held at `valid` as known at `system`."""
    known = (F.col("system_from") <= system) & (F.col("system_to").isNull() | (F.col("system_to") > system))
    held = (F.col("valid_from").isNull() | (F.col("valid_from") <= valid)) & (F.col("valid_to").isNull() | (F.col("valid_to") > valid))
    return intervals.filter(known & held)


# --- previews ---


def preview_linked(incoming: DataFrame, evidence: DataFrame, current: DataFrame, now: Column, **rule) -> DataFrame:
    """What an observation would do to the linked properties of its target, without doing it:
    (handoff_id, property, current_value, proposed_value, status, conflict, change).

    incoming: handoff_id and the columns of evidence; current: object_id, property, value. The
    rule is reconcile_linked()'s. change: ADDED, UNCHANGED, CHANGED, REMOVED, or null if the
    status brings no value and there was none.
    """
    asked = incoming.select("handoff_id", "object_id", "property").distinct()
    both = evidence.join(asked, ["object_id", "property"]).unionByName(incoming)
    keyed = both.withColumn("object_id", F.col("handoff_id")).drop("handoff_id")
    made = reconcile_linked(keyed, now, **rule).select(F.col("object_id").alias("handoff_id"), "property", "status", F.col("value").alias("proposed_value"))
    rows = asked.join(made, ["handoff_id", "property"]).join(current.withColumnRenamed("value", "current_value"), ["object_id", "property"], "left")
    kept = F.when(F.col("status") == "CONFLICT", F.col("current_value")).otherwise(F.col("proposed_value"))
    change = F.when(kept.isNull() & F.col("current_value").isNull(), F.lit(None)).when(F.col("current_value").isNull(), "ADDED").when(kept.isNull(), "REMOVED").when(kept == F.col("current_value"), "UNCHANGED").otherwise("CHANGED")
    return rows.select("handoff_id", "property", "current_value", kept.alias("proposed_value"), "status", (F.col("status") == "CONFLICT").alias("conflict"), change.alias("change"))
