"""Bounded reads of the relationship graph: edges(relationship_id, source_id, relation,
target_id, label, status), objects(object_id, canonical_type, tenant_id, status, label)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.sources.scratch import stored

from .access import checked_iris, label_filter

EDGE = ("relationship_id", "source_id", "relation", "target_id")
MOST_HITS, MOST_TYPES, MOST_RELATIONS, MOST_DEPTH = 200, 10, 20, 4


@dataclass(frozen=True)
class Scope:
    tenant: str
    labels: tuple[str, ...]


def related(objects: DataFrame, edges: DataFrame, relation: str, outbound: bool, types: Sequence[str], scope: Scope) -> DataFrame:
    """(anchor_id, object_id, canonical_type, relationship_id) for all visible ACTIVE anchors of
    the tenant: the objects at the other end of permitted ACTIVE edges of one relation."""
    types = checked_iris(types, MOST_TYPES)
    (relation,) = checked_iris([relation], 1)
    live = objects.filter((F.col("tenant_id") == scope.tenant) & (F.col("status") == "ACTIVE"))
    near, far = ("source_id", "target_id") if outbound else ("target_id", "source_id")
    seen = label_filter(edges.filter((F.col("relation") == relation) & (F.col("status") == "ACTIVE")), scope.labels)
    anchors = live.select(F.col("object_id").alias(near), F.col("canonical_type").alias("anchor_type"))
    others = live.filter(F.col("canonical_type").isin(types)).select(F.col("object_id").alias(far), "canonical_type")
    out = seen.join(anchors, near).join(others, far)
    return out.select(F.col(near).alias("anchor_id"), "anchor_type", F.col(far).alias("object_id"), "canonical_type", "relationship_id")


def related_search(objects: DataFrame, edges: DataFrame, anchor: str, anchor_type: str, relation: str, outbound: bool, types: Sequence[str], most: int, scope: Scope) -> DataFrame:
    """One anchor's related objects, ordered by type and id; `truncated` tells of more."""
    if not 1 <= most <= MOST_HITS:
        raise ValueError(f"1 to {MOST_HITS} results can be asked for")
    one = edges.filter(F.col("source_id" if outbound else "target_id") == anchor)
    hits = related(objects, one, relation, outbound, types, scope).filter(F.col("anchor_type") == anchor_type)
    hits = hits.orderBy("canonical_type", "object_id", "relationship_id").limit(most + 1)
    top = hits.agg(F.sort_array(F.collect_list(F.struct("canonical_type", "object_id", "relationship_id"))).alias("h"))  # most + 1 rows
    return top.select(F.posexplode(F.slice("h", 1, most)).alias("rank", "x"), (F.size("h") > most).alias("truncated")).select("rank", "x.*", "truncated")


def _permitted(edges: DataFrame, relations: Sequence[str], scope: Scope) -> DataFrame:
    seen = label_filter(edges.filter(F.col("relation").isin(checked_iris(relations, MOST_RELATIONS)) & (F.col("status") == "ACTIVE")), scope.labels)
    return seen.select(*[c for c in EDGE if c in edges.columns])


def neighbors(objects: DataFrame, edges: DataFrame, starts: DataFrame, relations: Sequence[str], scope: Scope) -> DataFrame:
    """One hop outwards from starts(object_id): ACTIVE permitted edges to targets of the tenant.
    The ends' status plays no part, as in traverse. Edges whose id derives from the others' columns
    may come without it; it is then left to the caller, and no exchange carries it."""
    own = objects.filter(F.col("tenant_id") == scope.tenant).select(F.col("object_id").alias("target_id"))
    seen = _permitted(edges, relations, scope)
    return seen.join(starts.select(F.col("object_id").alias("source_id")), "source_id", "left_semi").join(own, "target_id", "left_semi").select(*seen.columns)


def bounded(df: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """The first rows in order, with `truncated` telling of more."""
    rows = df.orderBy(*order).limit(most + 1)
    top = rows.agg(F.collect_list(F.struct(*df.columns)).alias("r"))  # most + 1 rows
    sorted_ = F.array_sort("r", lambda a, b: F.when(F.struct(*[a[c] for c in order]) < F.struct(*[b[c] for c in order]), -1).when(F.struct(*[a[c] for c in order]) > F.struct(*[b[c] for c in order]), 1).otherwise(0))
    return top.select(F.explode(F.slice(sorted_, 1, most)).alias("x"), (F.size("r") > most).alias("truncated")).select("x.*", "truncated")


def traverse(objects: DataFrame, edges: DataFrame, starts: DataFrame, relations: Sequence[str], depth: int, scope: Scope) -> DataFrame:
    """Simple outward paths of 1 to depth edges from each start: (start_id, depth, relationship_id,
    source_id, relation, target_id, path). An edge appears once for each path that ends with it;
    relationship_id is there if the edges have it.

    Edges are stored once, without those that no path can use: an edge's source is a start, or one
    of the tenant's objects, as all targets are. The first level is the starts' own edges; each further
    one is an equi-join of the stored level before with the edges that can follow another, so none is
    walked twice. The path array, at most depth + 1 long, stops cycles.
    """
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth is 1 to {MOST_DEPTH}")
    seen = _permitted(edges, relations, scope)
    columns = seen.columns
    kept = [c for c in columns if c not in ("source_id", "target_id")]  # the path has the rest
    own = objects.filter(F.col("tenant_id") == scope.tenant).select(F.col("object_id").alias("target_id"))
    sources = starts.select(F.col("object_id").alias("source_id"), F.lit(1).alias("_n"))
    if depth > 1:
        sources = sources.unionByName(own.select(F.col("target_id").alias("source_id"), F.lit(0).alias("_n")))
    sources = sources.groupBy("source_id").agg(F.sum("_n").cast("int").alias("_starts"), F.max(F.col("_n") == 0).alias("_inner"))
    seen = seen.join(sources, "source_id").join(own, "target_id", "left_semi")
    seen = stored(seen, "edges") if depth > 1 else seen
    step = seen.filter("_starts > 0 AND source_id <> target_id")
    step = step.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_starts")))).select(*kept, F.array("source_id", "target_id").alias("path"))
    out = step
    inner = stored(seen.filter("_inner").select(*columns), "inner-edges") if depth > 1 else seen
    for d in range(2, depth + 1):
        ends = step.select("path", F.element_at("path", -1).alias("source_id"))
        step = ends.join(inner, "source_id").filter(~F.array_contains("path", F.col("target_id"))).select(*kept, F.array_append("path", F.col("target_id")).alias("path"))
        step = stored(step, "paths") if d < depth else step
        out = out.unionByName(step)
    ends = {"source_id": F.element_at("path", -2).alias("source_id"), "target_id": F.element_at("path", -1).alias("target_id")}
    return out.select(F.element_at("path", 1).alias("start_id"), (F.size("path") - 1).alias("depth"), *[ends.get(c, c) for c in columns], "path")
