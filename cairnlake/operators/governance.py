"""Plans that change identities, carried out in batches, and packages of reviewed issues.

A batch holds many plans or packages at once. Those that share an object can't all be carried out;
`independent` chooses, as if they came one after the other in the order of a hash of their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.sources.scratch import stored

from .relate import repoint

MOST_REASON = 1000


def independent(members: DataFrame, owner: str, thing: str) -> DataFrame:
    """(owner, chosen) of members(owner, thing): owners in the order of the SHA-256 of their id (then
    of the id), each chosen unless it shares a thing with one chosen before it.

    In each round those that come first at all of their things are chosen and their neighbours drop
    out. The order being one of hashes, rounds grow with the logarithm of the batch, whatever the
    order of the ids; what is left is stored each round. Minima are combined before the exchange,
    so one thing may be in most plans. An owner without things isn't in the result.
    """
    rank = F.struct(F.sha2(F.col(owner).cast("string"), 256).alias("h"), F.col(owner).alias("id"))
    left = stored(members.filter(F.col(owner).isNotNull() & F.col(thing).isNotNull()).select(F.col(owner), F.col(thing), rank.alias("_r")).distinct(), "independent")
    done = []
    while not left.isEmpty():
        first = left.groupBy(thing).agg(F.min("_r").alias("_first"))
        best = left.join(first, thing).groupBy(owner).agg(F.min(F.col("_r") == F.col("_first")).alias("chosen")).filter("chosen").select(owner)
        best = stored(best, "independent")
        taken = left.join(best, owner, "left_semi").select(thing).distinct()
        lost = stored(left.join(best, owner, "left_anti").join(taken, thing, "left_semi").select(owner).distinct(), "independent")
        done += [best.withColumn("chosen", F.lit(True)), lost.withColumn("chosen", F.lit(False))]
        left = stored(left.join(best, owner, "left_anti").join(lost, owner, "left_anti"), "independent")
    out = members.select(owner).withColumn("chosen", F.lit(True)).limit(0)
    for d in done:
        out = out.unionAll(d)
    return out


def check_plans(plans: DataFrame, members: DataFrame, objects: DataFrame, bindings: DataFrame, allocations: DataFrame) -> DataFrame:
    """(plan_id, kind, outcome) for plans(plan_id, kind, state, version, expected_version, reason)
    with members(plan_id, role, object_id, planned_revision) and allocations(plan_id, binding,
    choice: a successor or UNRESOLVED).

    roles: SURVIVOR and MERGED of a MERGE, ORIGINAL and SUCCESSOR of a SPLIT. Outcomes, first that
    holds: KIND_INVALID, REASON_TOO_LONG, VERSION_CONFLICT (of the plan, or not PLANNED),
    MERGE_SAME_OBJECT, SPLIT_SUCCESSORS_INVALID, OBJECT_NOT_ACTIVE, IDENTITY_INCOMPATIBLE (tenants
    or types of a merge), STALE (an object's revision isn't the planned one), for a split
    BINDING_ALLOCATION_INCOMPLETE and ALLOCATION_TARGET_INVALID, else READY. Plans are taken as
    unique by plan_id; everything is counted per plan, nothing gathered.
    """
    m = members.join(objects.select("object_id", "tenant_id", "canonical_type", "status", "revision"), "object_id", "left")
    n = lambda role: F.count(F.when(F.col("role") == role, 1))
    seen = m.groupBy("plan_id").agg(
        n("SURVIVOR").alias("_sv"), n("MERGED").alias("_mg"), n("ORIGINAL").alias("_or"), n("SUCCESSOR").alias("_su"), F.count(F.lit(1)).alias("_n"), F.count_distinct("object_id").alias("_d"),
        F.min(F.coalesce(F.col("status") == "ACTIVE", F.lit(False))).alias("_active"), F.min(F.coalesce(F.col("revision") == F.col("planned_revision"), F.lit(False))).alias("_fresh"),
        (F.min(F.struct("tenant_id", "canonical_type")) == F.max(F.struct("tenant_id", "canonical_type"))).alias("_alike"),
    )
    own = members.filter("role = 'ORIGINAL'").join(bindings.filter("state = 'ACTIVE'").select("object_id", "binding"), "object_id").select("plan_id", "binding")
    missing = own.join(allocations.select("plan_id", "binding"), ["plan_id", "binding"], "left_anti").select("plan_id").distinct().withColumn("_missing", F.lit(True))
    heirs = members.filter("role = 'SUCCESSOR'").select("plan_id", F.col("object_id").alias("choice"))
    astray = allocations.filter("NOT choice <=> 'UNRESOLVED'").join(heirs, ["plan_id", "choice"], "left_anti").select("plan_id").distinct().withColumn("_astray", F.lit(True))
    rows = plans.join(seen, "plan_id", "left").join(missing, "plan_id", "left").join(astray, "plan_id", "left")
    merge, split = F.col("kind") == "MERGE", F.col("kind") == "SPLIT"
    yes = lambda c: F.coalesce(c, F.lit(False))
    outcome = (
        F.when(~yes(merge | split), "KIND_INVALID")
        .when(yes(F.length("reason") > MOST_REASON), "REASON_TOO_LONG")
        .when(~yes((F.col("state") == "PLANNED") & (F.col("version") == F.col("expected_version"))), "VERSION_CONFLICT")
        .when(merge & ~yes((F.col("_sv") == 1) & (F.col("_mg") == 1) & (F.col("_n") == 2) & (F.col("_d") == 2)), "MERGE_SAME_OBJECT")
        .when(split & ~yes((F.col("_or") == 1) & (F.col("_su") >= 2) & (F.col("_d") == F.col("_n")) & (F.col("_n") == F.col("_su") + 1)), "SPLIT_SUCCESSORS_INVALID")
        .when(~yes(F.col("_active")), "OBJECT_NOT_ACTIVE")
        .when(merge & ~yes(F.col("_alike")), "IDENTITY_INCOMPATIBLE")
        .when(~yes(F.col("_fresh")), "STALE")
        .when(split & yes(F.col("_missing")), "BINDING_ALLOCATION_INCOMPLETE")
        .when(split & yes(F.col("_astray")), "ALLOCATION_TARGET_INVALID")
        .otherwise("READY")
    )
    return rows.select("plan_id", "kind", outcome.alias("outcome"))


def execute_plans(plans: DataFrame, members: DataFrame, objects: DataFrame, bindings: DataFrame, edges: DataFrame, allocations: DataFrame) -> dict[str, DataFrame]:
    """What a batch of plans does, see check_plans(); of READY plans that share an object one is
    EXECUTED and the others are in CONFLICT, see independent().

    plans: plan_id, kind, outcome. objects: object_id, status, redirect_to, revision and plan_id of
    the changed ones. bindings: binding, previous_id, object_id, state, disposition, plan_id of the
    changed ones (REALLOCATED, or UNRESOLVED without an object). edges: relationship_id, relation,
    new_source, new_target, new_status of the touched ones (of a merge as by repoint(); of a split
    REVIEW_REQUIRED, its ends as they were; one that both touch is repointed and to be reviewed:
    REVIEW_REQUIRED). issues: plan_id, issue_type, resource.
    """
    checked = stored(check_plans(plans, members, objects, bindings, allocations), "plans")
    ready = members.join(checked.filter("outcome = 'READY'").select("plan_id"), "plan_id", "left_semi")
    chosen = independent(ready, "plan_id", "object_id")
    settled = checked.join(chosen, "plan_id", "left").select("plan_id", "kind", F.when(F.col("chosen"), "EXECUTED").when(~F.col("chosen"), "CONFLICT").otherwise(F.col("outcome")).alias("outcome"))
    settled = stored(settled, "plans")
    m = members.join(settled.filter("outcome = 'EXECUTED'").select("plan_id"), "plan_id", "left_semi")
    role = lambda r, name: m.filter(F.col("role") == r).select("plan_id", F.col("object_id").alias(name))
    merges = stored(role("MERGED", "merged_id").join(role("SURVIVOR", "survivor_id"), "plan_id"), "merges")
    splits = stored(role("ORIGINAL", "object_id"), "splits")

    kept = objects.select("object_id", "revision")
    gone = merges.select(F.col("merged_id").alias("object_id"), F.lit("MERGED").alias("status"), F.col("survivor_id").alias("redirect_to"), "plan_id")
    gone = gone.unionByName(splits.select("object_id", F.lit("SPLIT").alias("status"), F.lit(None).cast("string").alias("redirect_to"), "plan_id"))
    changed = gone.join(kept, "object_id").select("object_id", "status", "redirect_to", (F.col("revision") + 1).alias("revision"), "plan_id")

    live = bindings.filter("state = 'ACTIVE'").select("binding", F.col("object_id").alias("previous_id"))
    moved = live.join(merges.select(F.col("merged_id").alias("previous_id"), F.col("survivor_id").alias("object_id"), "plan_id"), "previous_id")
    choice = F.when(F.col("choice") != "UNRESOLVED", F.col("choice"))
    dealt = live.join(splits.withColumnRenamed("object_id", "previous_id"), "previous_id").join(allocations.dropDuplicates(["plan_id", "binding"]), ["plan_id", "binding"]).withColumn("object_id", choice)
    names = ["binding", "previous_id", "object_id", "plan_id"]
    held = moved.select(*names).unionByName(dealt.select(*names))
    open_ = F.col("object_id").isNull()
    held = held.select("binding", "previous_id", "object_id", F.when(open_, "UNRESOLVED").otherwise("ACTIVE").alias("state"), F.when(open_, "UNRESOLVED").otherwise("REALLOCATED").alias("disposition"), "plan_id")

    active = edges.filter("status = 'ACTIVE'").select("relationship_id", "relation", "source_id", "target_id")
    ends = lambda at: active.join(splits.select(F.col("object_id").alias(at), "plan_id"), at).select("relationship_id", "plan_id")
    review = stored(ends("source_id").unionByName(ends("target_id")).distinct(), "review")
    # what has an end among the changed objects, or an equal edge there, is all that can change
    ids = stored(merges.select(F.explode(F.array("merged_id", "survivor_id")).alias("id")).unionByName(splits.select(F.col("object_id").alias("id"))).distinct(), "ids")
    at = lambda c: ids.withColumnRenamed("id", c)
    near = active.join(at("source_id"), "source_id", "left_semi").unionByName(active.join(at("target_id"), "target_id", "left_semi").join(at("source_id"), "source_id", "left_anti"))
    after = repoint(near, merges.select("merged_id", "survivor_id"))
    after = after.join(review.select("relationship_id").distinct().withColumn("_split", F.lit(True)), "relationship_id", "left")
    status = F.when(F.col("_split") & F.col("new_status").isin("UNCHANGED", "REPOINTED"), "REVIEW_REQUIRED").otherwise(F.col("new_status"))
    touched = after.withColumn("new_status", status).filter("new_status <> 'UNCHANGED'").drop("_split")

    issues = held.filter("state = 'UNRESOLVED'").select("plan_id", F.lit("BINDING_UNRESOLVED").alias("issue_type"), F.concat(F.lit("source-binding://"), "binding").alias("resource"))
    issues = issues.unionByName(review.select("plan_id", F.lit("RELATIONSHIP_REVIEW_REQUIRED").alias("issue_type"), F.concat(F.lit("relationship://"), "relationship_id").alias("resource")))
    return {"plans": settled, "objects": changed, "bindings": held, "edges": touched, "issues": issues}


# --- packages of reviewed issues ---


def merkle_digest(rows: DataFrame, by: str, key: str, leaf: str) -> DataFrame:
    """(by, digest, n) of rows(by, key, leaf): a tree by the SHA-256 of the key.

    The rows whose keys' hashes begin with the same six hexadecimal digits are a leaf page: the
    SHA-256 of their `leaf` values in order, joined by |. Pages of the same four digits, then two,
    then none, are one again: of their `digits:digest` in order of the digits. So no array holds more than
    256 digests, or a 16 millionth of the rows, and equal rows give equal digests whatever
    their order. One exchange deals the rows by two digits; a second takes 256 digests each.
    """
    at = F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256)
    page = rows.select(by, F.substring(at, 1, 6).alias("_6"), F.substring(at, 1, 4).alias("_4"), F.substring(at, 1, 2).alias("_2"), F.coalesce(F.col(leaf).cast("string"), F.lit("")).alias("_l")).repartition(by, "_2")
    page = page.groupBy(by, "_2", "_4", "_6").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_l")), "|"), 256).alias("_d"), F.count(F.lit(1)).alias("n"))
    for upper, lower in ((["_2", "_4"], "_6"), (["_2"], "_4"), ([], "_2")):
        lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", lower, "_d"))), "|")
        page = page.groupBy(by, *upper).agg(F.sha2(lines, 256).alias("_d"), F.sum("n").alias("n"))
    return page.select(by, F.concat(F.lit("sha256:"), "_d").alias("digest"), "n")


def review_hash(*fields: str):
    """What a reviewer saw of an issue, as `sha256:` and hexadecimal digits; null isn't empty."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in fields]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\n", *parts), 256))


def review_packages(issues: DataFrame) -> DataFrame:
    """(tenant_id, digest, n) of the OPEN issues(issue_id, tenant_id, version, state, review_hash): what
    a reviewer confirms."""
    line = F.concat_ws("|", "issue_id", "version", "review_hash")
    return merkle_digest(issues.filter("state = 'OPEN'").withColumn("_leaf", line), "tenant_id", "issue_id", "_leaf")


def confirm_packages(packages: DataFrame, choices: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages, decisions): a package is confirmed whole or not at all.

    packages: package_id, tenant_id, expected_digest. choices: package_id, issue_id,
    expected_version, expected_review_hash, action (APPROVE or DISMISS), target, reason. issues:
    see review_packages(), and candidates (an array).

    Outcomes, first that holds: INVALID (no digest, an issue absent or twice, a reason too long, an
    unknown action, review hashes for some choices only or malformed), BACKFILL_REQUIRED (an open
    issue has no tenant), STALE (no choices; an issue that isn't open, is another tenant's or has
    moved on; without review hashes also a digest that isn't the tenant's now, or an issue left out),
    TARGET_NOT_A_CANDIDATE, CONFLICT (another package of the batch decides one of the issues, see
    independent()), else CONFIRMED. A package with review hashes is about its own issues only.
    decisions: package_id, issue_id, state, target, version, of confirmed packages.
    """
    open_ = issues.filter("state = 'OPEN'")
    unscoped = F.lit(not open_.filter("tenant_id IS NULL").isEmpty())
    now = stored(review_packages(open_), "digests")
    rows = choices.join(packages.select("package_id", F.col("tenant_id").alias("_tenant")), "package_id")
    rows = rows.join(open_.select("issue_id", "tenant_id", "version", "review_hash", "candidates"), "issue_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    some = lambda c: F.max(yes(c))
    hashed = F.col("expected_review_hash").isNotNull()
    bad = F.col("issue_id").isNull() | yes(F.length("reason") > MOST_REASON) | ~yes(F.col("action").isin("APPROVE", "DISMISS")) | (hashed & ~yes(F.col("expected_review_hash").rlike("^sha256:[0-9a-f]{64}$")))
    stale = ~yes((F.col("tenant_id") == F.col("_tenant")) & (F.col("version") == F.col("expected_version"))) | (hashed & ~yes(F.col("review_hash") == F.col("expected_review_hash")))
    astray = (F.col("action") == "APPROVE") & ~yes(F.array_contains("candidates", F.col("target")))
    # one row an issue and package first: a package may hold millions of choices
    each = rows.groupBy("package_id", "issue_id").agg(F.count(F.lit(1)).alias("_n"), some(bad).alias("_bad"), some(stale).alias("_stale"), some(astray).alias("_astray"), F.max(hashed).alias("_any"), F.min(hashed).alias("_all"))
    told = each.groupBy("package_id").agg(F.count(F.lit(1)).alias("_k"), F.max(F.col("_bad") | (F.col("_n") > 1)).alias("_bad"), F.max("_stale").alias("_stale"), F.max("_astray").alias("_astray"), F.max("_any").alias("_any"), F.min("_all").alias("_all"))
    p = packages.join(told, "package_id", "left").join(now.withColumnRenamed("n", "_open"), "tenant_id", "left")
    whole = ~yes(F.col("_any"))
    outcome = (
        F.when(F.coalesce(F.trim("expected_digest"), F.lit("")) == "", "INVALID")
        .when(yes(F.col("_bad")) | yes(F.col("_any") & ~F.col("_all")), "INVALID")
        .when(unscoped, "BACKFILL_REQUIRED")
        .when(F.col("_k").isNull() | F.col("_stale"), "STALE")
        .when(whole & ~yes((F.col("digest") == F.col("expected_digest")) & (F.col("_k") == F.col("_open"))), "STALE")
        .when(F.col("_astray"), "TARGET_NOT_A_CANDIDATE")
        .otherwise("CONFIRMED")
    )
    checked = stored(p.select("package_id", "tenant_id", outcome.alias("outcome")), "packages")
    sound = choices.join(checked.filter("outcome = 'CONFIRMED'").select("package_id"), "package_id", "left_semi")
    settled = checked.join(independent(sound, "package_id", "issue_id"), "package_id", "left").withColumn("outcome", F.when(~F.col("chosen"), "CONFLICT").otherwise(F.col("outcome"))).drop("chosen")
    settled = stored(settled, "packages")
    made = sound.join(settled.filter("outcome = 'CONFIRMED'").select("package_id"), "package_id", "left_semi")
    state = F.when(F.col("action") == "APPROVE", "RESOLVED").otherwise("DISMISSED")
    return settled, made.select("package_id", "issue_id", state.alias("state"), F.when(F.col("action") == "APPROVE", F.col("target")).alias("target"), (F.col("expected_version") + 1).alias("version"))
