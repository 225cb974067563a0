"""Intake of observations: contract checks, idempotent acceptance, raw references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.hashing import canonical_json, sha256_ref

OPERATIONS = ("UPSERT", "DELETE", "TOMBSTONE")
MODES = ("FULL_SNAPSHOT", "DELTA_PATCH", "PROPERTY_EVENTS")
REQUIRED = ("handoff_id", "ingestion_run_id", "ingestion_id", "source_id", "type_code", "source_object_id", "lineage_id", "content_hash")
STAMP = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"


def contract_violations(columns: Sequence[str]) -> Column:
    """Paths at which an envelope, a flat row of strings, breaks the contract, sorted.

    Required texts are present and not empty; operation and mode are known; acquired_at is a
    date-time; UPSERT needs canonical_payload, a JSON object; DELTA_PATCH a base_revision_ref or
    base_content_hash; PROPERTY_EVENTS an event_sequence of 0 or more.
    """
    empty = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    checks: dict[str, Column] = {c: empty(c) for c in REQUIRED}
    checks["operation"] = ~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False))
    checks["mode"] = ~F.coalesce(F.col("mode").isin(*MODES), F.lit(False))
    checks["acquired_at"] = ~F.coalesce(F.col("acquired_at").rlike(STAMP) & F.try_to_timestamp("acquired_at").isNotNull(), F.lit(False))
    body = F.json_object_keys("canonical_payload").isNotNull()
    checks["canonical_payload"] = (F.col("operation") == "UPSERT") & ~F.coalesce(body, F.lit(False))
    checks["base"] = (F.col("mode") == "DELTA_PATCH") & empty("base_revision_ref") & empty("base_content_hash")
    checks["event_sequence"] = (F.col("mode") == "PROPERTY_EVENTS") & ~F.coalesce(F.col("event_sequence").try_cast("long") >= 0, F.lit(False))
    for c in checks:
        if c not in ("base", "mode") and c not in columns:
            raise ValueError(f"envelopes have no column {c}")
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), c) for c, bad in sorted(checks.items())])
    return F.filter(found, lambda x: x.isNotNull())


def unknown_keys(json: Column, known: Sequence[str]) -> Column:
    """Keys of a closed JSON object that it shouldn't have, sorted."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known])))


def classify(batch: DataFrame, accepted: DataFrame | None = None, scheme: str = "registry") -> DataFrame:
    """The batch with `decision`: NEW, DUPLICATE or CONFLICT, and a `receipt` of the given scheme.

    batch: handoff_id, content_hash, payload, arrival (total order). accepted: handoff_id,
    content_hash, payload of earlier batches, one row an id. The first arrival of an unknown id
    is NEW; what equals the accepted row is a DUPLICATE, anything else a CONFLICT. Payloads that
    are JSON are equal whatever the order of their keys.
    """
    first = Window.partitionBy("handoff_id").orderBy("arrival")
    rows = batch.withColumn("_n", F.row_number().over(first))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    rows = rows.withColumn("_h", F.first("content_hash").over(first)).withColumn("_p", F.first("payload").over(first))
    if accepted is not None:
        old = accepted.select("handoff_id", F.col("content_hash").alias("_oh"), F.col("payload").alias("_op"), F.lit(True).alias("_old"))
        rows = rows.join(old, "handoff_id", "left").withColumn("_h", F.when(F.col("_old"), F.col("_oh")).otherwise(F.col("_h"))).withColumn("_p", F.when(F.col("_old"), F.col("_op")).otherwise(F.col("_p")))
    else:
        rows = rows.withColumn("_old", F.lit(None).cast("boolean"))
    alike = same("payload", "_p") | F.coalesce(canonical_json(F.col("payload")) == canonical_json(F.col("_p")), F.lit(False))
    decision = F.when(F.col("_old").isNull() & (F.col("_n") == 1), "NEW").when(same("content_hash", "_h") & alike, "DUPLICATE").otherwise("CONFLICT")
    return rows.select(*batch.columns, decision.alias("decision"), F.concat(F.lit(f"{scheme}://handoffs/"), F.col("handoff_id")).alias("receipt"))


def verify_raw_refs(batch: DataFrame, lake: DataFrame) -> DataFrame:
    """The batch with raw_status: NONE without a reference, else MISSING, SCOPE, TIER or OK."""
    own = lake.select(F.concat(F.lit("lake://"), F.col("lake_id")).alias("raw_ref"), F.col("tenant_id").alias("_t"), F.col("source_id").alias("_s"), F.col("type_code").alias("_c"), F.col("tier").alias("_tier"), F.col("status").alias("_st"))
    rows = batch.join(own, "raw_ref", "left")
    scope = (F.col("tenant_id") == F.col("_t")) & (F.col("source_id") == F.col("_s")) & (F.col("type_code") == F.col("_c"))
    status = F.when(F.col("raw_ref").isNull(), "NONE").when(F.col("_tier").isNull(), "MISSING").when(~scope, "SCOPE").when((F.col("_tier") != "RAW") | (F.col("_st") != "VERIFIED"), "TIER").otherwise("OK")
    return rows.withColumn("raw_status", status).drop("_t", "_s", "_c", "_tier", "_st")


def lookup(accepted: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(handoff_id) with found and the accepted row's columns, null where there is none."""
    rows = accepted.withColumn("found", F.lit(True))
    return wanted.join(rows, "handoff_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def publication_problems(publications: DataFrame) -> DataFrame:
    """publications(ref, body, checksum) with problem: NOT_JSON, CHECKSUM (the SHA-256 of the body
    with sorted keys isn't the pinned one) or null."""
    body = canonical_json(F.col("body"))
    problem = F.when(body.isNull(), "NOT_JSON").when(~F.coalesce(sha256_ref(body) == F.col("checksum"), F.lit(False)), "CHECKSUM")
    return publications.withColumn("problem", problem)


def json_kind(c: Column) -> Column:
    """string, number, boolean, map, list or null of a JSON text; null where it isn't JSON."""
    kind = F.schema_of_variant(F.try_parse_json(c))
    return F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.startswith("OBJECT"), "map").when(kind.startswith("ARRAY"), "list").when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), "number")
