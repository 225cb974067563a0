"""Row and column security: tenants, labels, validity, grants, redaction. All fail closed."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Access labels, weakest first.
LABELS = ("OPEN", "ANONYMOUS", "PERSONAL", "SENSITIVE", "RESTRICTED")


def label_rank(c: Column) -> Column:
    """1 for OPEN and unknown labels up to 5 for RESTRICTED."""
    rank = F.lit(1)
    for i, name in enumerate(LABELS[1:], 2):
        rank = F.when(c == name, i).otherwise(rank)
    return rank


def label_filter(df: DataFrame, labels: Sequence[str], column: str = "label") -> DataFrame:
    """Rows of the given labels; no labels, no rows."""
    return df.filter(F.col(column).isin(*labels) if labels else F.lit(False))


def scoped(df: DataFrame, tenant: str, labels: Sequence[str]) -> DataFrame:
    """Rows of a tenant that the labels let through: the first filter of every read."""
    return label_filter(df.filter(F.col("tenant_id") == tenant), labels)


def valid_at(start: Column, end: Column, now: Column) -> Column:
    """Half-open validity; a null bound is unbounded."""
    return (start.isNull() | (start <= now)) & (end.isNull() | (end > now))


def policy_filter(df: DataFrame, grants: DataFrame, capability: str, key: str = "object_id") -> DataFrame:
    """Rows that some grant(capability, canonical_type, label, effect) of the capability allows
    and none denies; a null type or label of a grant stands for any.

    The four forms of a grant (type, label, both, neither) are joins of equal keys, with a
    constant in place of what the grant leaves open.
    """
    own = grants.filter(F.col("capability") == capability).select(F.coalesce("canonical_type", F.lit("*")).alias("_t"), F.coalesce("label", F.lit("*")).alias("_l"), "effect")
    forms = own.groupBy("_t", "_l").agg(F.max(F.col("effect") == "ALLOW").alias("_allow"), F.max(F.col("effect") == "DENY").alias("_deny"))
    allow, deny, out = F.lit(False), F.lit(False), df
    for i, (t, label) in enumerate((("canonical_type", "label"), ("canonical_type", None), (None, "label"), (None, None))):
        names = [f"_t{i}", f"_l{i}", f"_a{i}", f"_d{i}"]
        out = out.join(forms.toDF(*names), (F.col(names[0]) == (F.lit("*") if t is None else F.col(t))) & (F.col(names[1]) == (F.lit("*") if label is None else F.col(label))), "left")
        allow, deny = allow | F.coalesce(names[2], F.lit(False)), deny | F.coalesce(names[3], F.lit(False))
    return out.filter(allow & ~deny).select(*df.columns)


def geometry_policy(objects: DataFrame, grants: DataFrame, capability: str) -> DataFrame:
    """Objects whose geometry may be used: the object's own grants, those of urban.geometry.read
    and those of the capability all allow it."""
    out = objects
    for needed in ("urban.object.read", "urban.geometry.read", capability):
        out = policy_filter(out, grants, needed)
    return out


def edge_policy(edges: DataFrame, objects: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Edges whose own label and both ends are visible."""
    seen = label_filter(objects, labels).select("object_id")
    out = label_filter(edges, labels)
    for end in ("source_id", "target_id"):
        out = out.join(seen.withColumnRenamed("object_id", end), end, "left_semi")
    return out


def redact_properties(rows: DataFrame, labels: Sequence[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """(visible, redacted) rows of properties(object_id, property, value, label, valid_from,
    valid_to). Hidden properties are left out, not nulled; the second frame is the audit."""
    allowed = F.coalesce(F.col("label").isin(*labels) if labels else F.lit(False), F.lit(False))
    live = valid_at(F.col("valid_from"), F.col("valid_to"), now)
    visible = rows.filter(allowed & live)
    audit = rows.filter(~(allowed & live)).select("object_id", "property", "label", F.when(~allowed, "LABEL").otherwise("EXPIRED").alias("reason"))
    return visible, audit


def member_access(labels: Sequence[str]) -> Column:
    """Of an array `members` with `contributions` arrays: whether every contribution is permitted."""
    return F.forall("members", lambda m: F.forall(m["contributions"], lambda c: c["label"].isin(*labels) if labels else F.lit(False)))


def member_valid_at(now: Column) -> Column:
    """Whether every member has a contribution that is valid now; no members, no value."""
    return (F.size("members") > 0) & F.forall("members", lambda m: F.exists(m["contributions"], lambda c: valid_at(c["valid_from"], c["valid_to"], now)))


def checked_iris(iris: Sequence[str], most: int) -> list[str]:
    """Distinct sorted names; ValueError before any plan is built if one is blank, long or wild."""
    for x in iris:
        if not x or len(x) > 256 or re.search(r"[\s*%]", x):
            raise ValueError(f"not an exact name: {x!r}")
    out = sorted(set(iris))
    if not out or len(out) > most:
        raise ValueError(f"1 to {most} names are needed")
    return out
