"""Relationships: resolving references, choosing an edge's representative, merge and split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.hashing import match_key, uuid3
from cairnlake.sources.scratch import stored

from .access import label_rank


def resolve_references(references: DataFrame, targets: DataFrame, quarantine: bool = True, self_loops: bool = False) -> DataFrame:
    """references(source_id, tenant_id, relation, target_type, needle) with outcome (MATCHED,
    NO_MATCH, MULTIPLE_MATCHES, SELF_LOOP or SKIPPED), target_id and relationship_id.

    targets: object_id, tenant_id, canonical_type, status, match_key. Only ACTIVE ones of the
    reference's tenant and type count; a blank needle is skipped, and so is an unmatched one
    without quarantine.
    """
    keyed = targets.filter("status = 'ACTIVE'").groupBy("tenant_id", F.col("canonical_type").alias("target_type"), F.col("match_key").alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.min("object_id").alias("_one"))
    rows = references.withColumn("_k", match_key(F.col("needle"))).join(keyed, ["tenant_id", "target_type", "_k"], "left")
    outcome = F.when(F.col("_k").isNull(), "SKIPPED").when(F.col("_n").isNull(), "NO_MATCH" if quarantine else "SKIPPED").when(F.col("_n") > 1, "MULTIPLE_MATCHES")
    if not self_loops:
        outcome = outcome.when(F.col("_one") == F.col("source_id"), "SELF_LOOP")
    outcome = outcome.otherwise("MATCHED")
    target = F.when(outcome == "MATCHED", F.col("_one"))
    return rows.select(*references.columns, outcome.alias("outcome"), target.alias("target_id"), F.when(outcome == "MATCHED", uuid3(F.col("source_id"), F.col("relation"), F.col("_one"))).alias("relationship_id"))


def edge_representative(supports: DataFrame) -> DataFrame:
    """Of each relationship's ACTIVE supports(relationship_id, label, revision_no, ...) the one
    of the strictest label, then the newest."""
    w = Window.partitionBy("relationship_id").orderBy(label_rank(F.col("label")).desc(), F.col("revision_no").desc())
    return supports.filter("status = 'ACTIVE'").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def newest_observations(observations: DataFrame) -> DataFrame:
    """Observations with is_newest: per binding the greatest (observed_at, received_at, id)
    counts; late ones stay as history."""
    at = F.struct("observed_at", "received_at", "handoff_id")
    return observations.withColumn("is_newest", at == F.max(at).over(Window.partitionBy("source_id", "source_object_id")))


def repoint(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges after merges(merged_id, survivor_id): source_id, target_id, new_status.

    An edge whose ends meet is SUPERSEDED (SELF_LOOP), as is one that repeats another after
    re-pointing (DUPLICATE, an edge that wasn't moved is kept first); a moved edge is REPOINTED.
    Only touched keys take part in the duplicate search.
    """
    m = merges.select("merged_id", "survivor_id")
    rows = edges
    for end in ("source_id", "target_id"):
        rows = rows.join(m.select(F.col("merged_id").alias(end), F.col("survivor_id").alias(f"_{end}")), end, "left")
    moved = F.col("_source_id").isNotNull() | F.col("_target_id").isNotNull()
    rows = rows.withColumn("_moved", moved).withColumn("new_source", F.coalesce("_source_id", "source_id")).withColumn("new_target", F.coalesce("_target_id", "target_id"))
    nth = F.row_number().over(Window.partitionBy("new_source", "relation", "new_target").orderBy("_moved", "relationship_id"))
    loop = F.col("_moved") & (F.col("new_source") == F.col("new_target"))
    status = F.when(loop, "SUPERSEDED_SELF_LOOP").when(F.col("_moved") & (nth > 1), "SUPERSEDED_DUPLICATE").when(F.col("_moved"), "REPOINTED").otherwise("UNCHANGED")
    return rows.select("relationship_id", "relation", "new_source", "new_target", status.alias("new_status"))


def merge_impact(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Per merge: edges by what becomes of them."""
    touched = repoint(edges, merges).filter("new_status <> 'UNCHANGED'")
    ends = touched.select(F.explode(F.array_distinct(F.array("new_source", "new_target"))).alias("survivor_id"), "new_status")
    rows = merges.select("survivor_id").distinct().join(ends, "survivor_id")
    return rows.groupBy("survivor_id", "new_status").agg(F.count(F.lit(1)).alias("n_edges"))


def split_edges(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """Edges of a split object, each once, REVIEW_REQUIRED, with the number of successors it
    could go to. splits: object_id, successor_id."""
    n = splits.groupBy("object_id").agg(F.count_distinct("successor_id").alias("successors"))
    ends = edges.select("relationship_id", "relation", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("object_id"))
    return ends.join(n, "object_id").groupBy("relationship_id", "relation").agg(F.max("successors").alias("successors")).withColumn("status", F.lit("REVIEW_REQUIRED"))


def resolve_redirects(merges: DataFrame) -> DataFrame:
    """(merged_id, final_id, hops): redirect chains of any length, followed by doubling until no
    final_id is itself merged; a cycle raises an error. A merge into null ends its chain."""
    out = stored(merges.select("merged_id", F.col("survivor_id").alias("final_id"), F.lit(1).cast("long").alias("hops")), "redirects")
    most, reach = out.count(), 1  # a chain without a cycle has a hop per merge at most
    while True:
        nxt = out.filter("final_id IS NOT NULL").select(F.col("merged_id").alias("final_id"), F.col("final_id").alias("_f"), F.col("hops").alias("_h"))
        rows = out.join(nxt, "final_id", "left")
        step = stored(rows.select("merged_id", F.coalesce("_f", "final_id").alias("final_id"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"), F.col("_f").isNotNull().alias("_moved")), "redirects")
        out = step.drop("_moved")
        if step.filter("_moved").isEmpty():
            return out
        if reach >= most:
            raise ValueError("redirects form a cycle")
        reach *= 2


def tenant_backfill(scopes: DataFrame) -> DataFrame:
    """issues whose candidate tenants are all the same: scopes(issue_id, tenant_id), null for a
    candidate that is unknown."""
    agg = scopes.groupBy("issue_id").agg(F.min("tenant_id").alias("tenant_id"), F.count_distinct("tenant_id").alias("t"), F.count("tenant_id").alias("known"), F.count(F.lit(1)).alias("n"))
    return agg.filter("t = 1 AND known = n").select("issue_id", "tenant_id", F.col("n").alias("candidates"))


def retry_issues(issues: DataFrame, targets: DataFrame, most: int = 10) -> DataFrame:
    """One tick: the `most` oldest OPEN issues(issue_id, state, opened_at and the columns of
    resolve_references()) resolved again; RESOLVED where there is one target now."""
    oldest = issues.filter("state = 'OPEN'").orderBy("opened_at", "issue_id").limit(most)
    out = resolve_references(oldest, targets)
    return out.select("issue_id", F.when(F.col("outcome") == "MATCHED", "RESOLVED").otherwise("OPEN").alias("state"), "outcome", "target_id")
