"""The stored index that governed identity retrieves candidates from, and resolution against it.

Two keyed tables: an object's tokens, and the same as postings dealt by token. A refresh takes the
objects that changed, compares their old tokens with the new ones and rewrites the touched buckets
only. A coverage row holds what the index stands for: the policy, the versions of both tables,
counts and an additive digest of the indexed (object, version) pairs. It is written last. Whether
the index is complete is not a flag that somebody must lower: it follows from comparing the digest
with that of the objects as they are now, so any other change makes it stale by itself.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.sources.scratch import stored
from cairnlake.sources.upsert import Upserts

from .identity import GovernedPolicy, decide_by_tokens, policy_fingerprint, tokens

_OBJECT = "object_id string, tokens map<string,struct<comparator:string,token:string>>, version long"
_POSTING = "property string, comparator string, token string, object_id string, version long"
_COVERAGE = "policy string, field_set string, objects long, tokens long, source_digest decimal(38,0), token_digest decimal(38,0), objects_at int, postings_at int, version long"


class CoverageStale(RuntimeError):
    """The index doesn't stand for what a refresh builds on."""


def _sum(*parts: Column | str) -> Column:
    return F.coalesce(F.sum(F.xxhash64(*parts).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def field_set_hash(policy: GovernedPolicy) -> str:
    return hashlib.sha256("\0".join(sorted(p for p, _ in policy.signals)).encode()).hexdigest()


class IdentityIndex:
    """Under root, for one policy. objects and changes: object_id, version (long, growing), status and
    the policy's properties; only ACTIVE ones are indexed."""

    def __init__(self, spark: SparkSession, root: str, policy: GovernedPolicy, buckets: int = 64):
        self.spark, self.policy = spark, policy
        self._objects = Upserts(spark, f"{root}/objects", ["object_id"], buckets)
        self._postings = Upserts(spark, f"{root}/postings", ["property", "comparator", "token", "object_id"], buckets, ["property", "comparator", "token"])
        self._coverage = Upserts(spark, f"{root}/coverage", ["policy"], 1)

    def objects(self) -> DataFrame:
        return self._objects.read(_OBJECT)

    def postings(self) -> DataFrame:
        return self._postings.read(_POSTING)

    def coverage(self) -> dict | None:
        """The coverage row, or None if there is none or a run ended before it was written."""
        rows = [r.asDict() for r in self._coverage.read(_COVERAGE).collect()]
        good = [r for r in rows if (r["objects_at"], r["postings_at"]) == (self._objects.version(), self._postings.version())]
        return good[0] if good else None

    def ref(self) -> str | None:
        """Names what the index covers; equal refs stand for equal contents."""
        c = self.coverage()
        return f"coverage://{c['policy'][:16]}/{c['objects']}/{c['source_digest']}/{c['token_digest']}" if c else None

    def complete(self, current: DataFrame) -> bool:
        """Whether the index covers the current objects under its policy: one scan of three columns."""
        c = self.coverage()
        if c is None or (c["policy"], c["field_set"]) != (policy_fingerprint(self.policy), field_set_hash(self.policy)):
            return False
        now = current.filter("status = 'ACTIVE'").agg(F.count(F.lit(1)), _sum("object_id", F.col("version").cast("long"))).first()
        return (c["objects"], c["source_digest"]) == (now[0], now[1])

    def build(self, objects: DataFrame) -> None:
        """Indexes all objects anew, whatever the index held."""
        ids = objects.select("object_id")
        left = self.objects().join(ids, "object_id", "left_anti").select("object_id", (F.col("version") + 1).alias("version"), F.lit("GONE").alias("status"))
        self._change(objects.unionByName(left, allowMissingColumns=True), None)

    def refresh(self, changes: DataFrame) -> None:
        """Follows changed objects, one row each, as they are now; one that is no longer ACTIVE leaves."""
        c = self.coverage()
        if c is None or (c["policy"], c["field_set"]) != (policy_fingerprint(self.policy), field_set_hash(self.policy)):
            raise CoverageStale("a refresh needs a coverage of this policy")
        self._change(changes, c)

    def _change(self, changes: DataFrame, before: dict | None) -> None:
        policy = self.policy
        live = F.col("status") == "ACTIVE"
        changes = changes.withColumn("version", F.col("version").cast("long"))
        pair = F.struct("comparator", "token")
        new = tokens(changes.filter(live), "object_id", policy).groupBy("object_id").agg(F.map_from_entries(F.collect_list(F.struct("property", pair))).alias("tokens"))
        rows = changes.select("object_id", "version", (~live).alias("deleted")).join(new, "object_id", "left")
        old = self.objects().select("object_id", F.col("tokens").alias("old"), F.col("version").alias("was"))
        empty = F.expr("CAST(map() AS map<string,struct<comparator:string,token:string>>)")
        rows = rows.withColumn("tokens", F.coalesce("tokens", empty)).join(old, "object_id", "left")
        rows = stored(rows.filter(F.col("was").isNull() | (F.col("version") >= F.col("was"))), "index-changes")

        def side(column: str, version: str) -> DataFrame:
            return rows.select("object_id", F.col(version).alias("v"), "version", F.explode(column).alias("property", "x")).select("object_id", "v", "version", "property", "x.comparator", "x.token")

        mine, theirs = side("tokens", "version"), side("old", "was")
        keys = ["property", "comparator", "token", "object_id"]
        gone = theirs.join(mine.select(*keys), keys, "left_anti").select(*keys, "version", F.lit(True).alias("deleted"))
        came = mine.select(*keys, "version", F.lit(False).alias("deleted"))
        # both digests add up: what leaves is taken off, what comes is put on
        d_objects = rows.agg(F.sum((~F.col("deleted")).cast("int")).alias("came"), F.count("was").alias("left"), _sum_if(~F.col("deleted"), "object_id", "version").alias("on"), _sum_if(F.col("was").isNotNull(), "object_id", "was").alias("off")).first()
        d_new, d_old = (df.agg(F.count(F.lit(1)).alias("n"), _sum(*keys).alias("d")).first() for df in (mine, theirs))
        self._objects.apply(rows.select("object_id", "tokens", "version", "deleted"), "version")
        self._postings.apply(came.unionByName(gone), "version")
        if before is None:  # a build counts what is there
            counts = tuple(self._counted().values())
        else:
            b = before
            counts = (b["objects"] + (d_objects.came or 0) - d_objects.left, b["tokens"] + d_new.n - d_old.n, b["source_digest"] + d_objects.on - d_objects.off, b["token_digest"] + d_new.d - d_old.d)
        at = self._coverage.version() + 1
        row = (policy_fingerprint(policy), field_set_hash(policy), *counts, self._objects.version(), self._postings.version(), at, False)
        self._coverage.apply(self.spark.createDataFrame([row], f"{_COVERAGE}, deleted boolean"), "version")

    def _counted(self) -> dict:
        o = self.objects().agg(F.count(F.lit(1)).alias("n"), _sum("object_id", "version").alias("d")).first()
        t = self.postings().agg(F.count(F.lit(1)).alias("n"), _sum("property", "comparator", "token", "object_id").alias("d")).first()
        return {"objects": o.n, "tokens": t.n, "source_digest": o.d, "token_digest": t.d}

    def decide(self, subjects: DataFrame, current: DataFrame) -> DataFrame:
        """governed_decisions() from the stored postings; without coverage of the current objects
        nothing is decided by machine."""
        return decide_by_tokens(subjects, self.postings().select("object_id", "property", "comparator", "token"), self.policy, self.complete(current))


def _sum_if(test: Column, *parts: str) -> Column:
    return F.coalesce(F.sum(F.when(test, F.xxhash64(*parts).cast("decimal(38,0)"))), F.lit(0).cast("decimal(38,0)"))


def governed_resolve(subjects: DataFrame, decisions: DataFrame, bindings: DataFrame, prior: DataFrame, policy: str, coverage_ref: str | None, complete: bool) -> DataFrame:
    """(handoff_id, outcome, reason, target, replayed) of subjects(handoff_id, binding).

    decisions: of the index, for these subjects. bindings: binding, bound_id, healthy (binding and
    object ACTIVE, in the policy's tenant and class). prior: what was decided on a handoff before:
    handoff_id, prior_policy, prior_outcome, issue_state, human_action, reviewed_ref, materialized.

    A prior decision is replayed: under another policy it is a conflict; an open review stays open; a
    human CREATE_NEW holds only if the coverage reviewed is the coverage now, else its review opens
    again. Without one, a healthy binding is continuity enough, an unhealthy one goes to review, and
    only then the machine's decision counts. outcome CONFLICT takes the place of an error.
    """
    rows = subjects.join(bindings, "binding", "left").join(prior, "handoff_id", "left").join(decisions.select("handoff_id", F.col("outcome").alias("_o"), F.col("reason").alias("_r"), F.col("target").alias("_t")), "handoff_id", "left")
    bound, healthy = F.col("bound_id").isNotNull(), F.coalesce("healthy", F.lit(False))
    old, human, done = F.col("prior_outcome"), F.coalesce(F.col("human_action") == "CREATE_NEW", F.lit(False)), F.coalesce("materialized", F.lit(False))
    review = old == "REVIEW_REQUIRED"
    own, none = F.col("bound_id"), F.lit(None).cast("string")
    yes, no = F.lit(True), F.lit(False)
    same = F.coalesce(F.col("reviewed_ref") == F.lit(coverage_ref), F.lit(False))
    cases: list[tuple[Column, str | Column, str | Column, Column, Column]] = [
        (old.isNotNull() & (F.col("prior_policy") != policy), "CONFLICT", "IDENTITY_DECISION_CONFLICT", none, no),
        (review & (F.coalesce("issue_state", F.lit("OPEN")) != "RESOLVED"), "REVIEW_REQUIRED", "REVIEW_OPEN", none, yes),
        (review & human & ~healthy & bound, "CONFLICT", "IDENTITY_BINDING_CONFLICT", none, no),
        (review & human & ~healthy & F.lit(not complete), "CONFLICT", "IDENTITY_COVERAGE_UNVERIFIED", none, no),
        (review & human & ~healthy & ~same, "REVIEW_REQUIRED", "NEW_IDENTITY_EVIDENCE_STALE", none, no),
        (review & human & ~healthy, "NEW_OBJECT", "HUMAN_CREATE_NEW", none, no),
        (review & ~healthy, "REVIEW_REQUIRED", "BINDING_NOT_HEALTHY", none, yes),
        (review & human & ~done, "CONFLICT", "NEW_IDENTITY_BINDING_CONFLICT", none, no),
        (review, "MATCH", "REVIEWED_BINDING", own, done),
        (old.isNotNull() & ~healthy, "CONFLICT", "IDENTITY_BINDING_MISSING", none, no),
        (old.isNotNull(), old, "REPLAYED", own, yes),
        (healthy, "MATCH", "ACTIVE_SOURCE_BINDING", own, no),
        (bound, "REVIEW_REQUIRED", "SOURCE_BINDING_CONFLICT", none, no),
    ]
    out = F.struct(F.col("_o").alias("outcome"), F.col("_r").alias("reason"), F.col("_t").alias("target"), no.alias("replayed"))
    for test, outcome, reason, target, replayed in reversed(cases):
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        out = F.when(F.coalesce(test, no), F.struct(lit(outcome).alias("outcome"), lit(reason).alias("reason"), target.alias("target"), replayed.alias("replayed"))).otherwise(out)
    return rows.select("handoff_id", out.alias("x")).select("handoff_id", "x.*")
