"""Which registered object an observation describes: exact keys, weighted evidence, governed rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.hashing import canonical_json, match_key
from cairnlake.functions.text import decimal_text, similarity, text_v1
from cairnlake.sources.scratch import stored


def resolve_exact(batch: DataFrame, objects: DataFrame, bindings: DataFrame) -> DataFrame:
    """batch(handoff_id, tenant_id, type_code, source_key, key, payload, arrival) with outcome,
    reason and target.

    In order: no payload is REJECTED; an ACTIVE binding(source_key, object_id) to an object of
    the same tenant and type that is ACTIVE is a MATCH, to another needs review; else ACTIVE
    objects(object_id, tenant_id, canonical_type, status, match_key) of the key decide: none is
    NEW_OBJECT, one a MATCH, more need review. Of one new key in a batch the first arrival makes
    the object and the others match it.
    """
    objects = objects.select("object_id", "tenant_id", "canonical_type", "status", "match_key")
    bound = bindings.filter(F.col("status") == "ACTIVE").select("source_key", F.col("object_id").alias("bound_id"))
    owner = objects.select(F.col("object_id").alias("bound_id"), F.col("tenant_id").alias("_bt"), F.col("canonical_type").alias("_bc"), F.col("status").alias("_bs"))
    keyed = objects.filter((F.col("status") == "ACTIVE") & F.col("match_key").isNotNull()).groupBy("tenant_id", F.col("canonical_type").alias("type_code"), "match_key").agg(F.count(F.lit(1)).alias("_n"), F.min("object_id").alias("_one"))
    rows = batch.withColumn("match_key", match_key(F.col("key"))).join(bound, "source_key", "left").join(owner, "bound_id", "left").join(keyed, ["tenant_id", "type_code", "match_key"], "left")
    in_scope = F.coalesce((F.col("_bt") == F.col("tenant_id")) & (F.col("_bc") == F.col("type_code")) & (F.col("_bs") == "ACTIVE"), F.lit(False))
    step = (
        F.when(F.col("payload").isNull(), "REJECTED")
        .when(F.col("bound_id").isNotNull(), F.when(in_scope, "BOUND").otherwise("SCOPE"))
        .when(F.col("match_key").isNull(), "FRESH")
        .when(F.col("_n").isNull(), "KEYED")
        .when(F.col("_n") > 1, "MANY")
        .otherwise("ONE")
    )
    rows = rows.withColumn("_s", step)
    made = F.concat(F.lit("object:"), F.md5(F.concat_ws("|", "tenant_id", "type_code", F.coalesce("match_key", F.concat(F.lit("handoff|"), F.col("handoff_id"))))))
    # only rows that make or await a new object take part in the order
    first = Window.partitionBy("tenant_id", "type_code", F.when(F.col("_s") == "KEYED", F.col("match_key")), F.when(F.col("_s") != "KEYED", F.col("handoff_id"))).orderBy("arrival")
    rows = rows.withColumn("_first", F.row_number().over(first) == 1)
    outcome = F.when(F.col("_s") == "REJECTED", "REJECTED").when(F.col("_s").isin("SCOPE", "MANY"), "REVIEW_REQUIRED").when((F.col("_s") == "FRESH") | ((F.col("_s") == "KEYED") & F.col("_first")), "NEW_OBJECT").otherwise("MATCH")
    reason = F.when(F.col("_s") == "SCOPE", "SOURCE_BINDING_SCOPE_MISMATCH").when(F.col("_s") == "MANY", "RESOLUTION_AMBIGUOUS").when(F.col("_s") == "REJECTED", "NO_CANONICAL_PAYLOAD")
    target = F.when(F.col("_s") == "BOUND", F.col("bound_id")).when(F.col("_s") == "ONE", F.col("_one")).when(F.col("_s").isin("FRESH", "KEYED"), made)
    return rows.select(*batch.columns, outcome.alias("outcome"), reason.alias("reason"), target.alias("target"))


# --- weighted evidence ---


SPATIAL = ("DISTANCE", "OVERLAP")


@dataclass(frozen=True)
class Signal:
    """kind: EXACT, TEXT, NUMBER (with tolerance), DISTANCE (with tolerance, on metres) or OVERLAP."""

    name: str
    kind: str
    weight: float
    tolerance: float | None = None


@dataclass(frozen=True)
class WeightedPolicy:
    signals: tuple[Signal, ...]
    blocking: tuple[str, ...]
    high: float
    review: float
    margin: float
    most: int
    spatial_alone: bool = False

    def __post_init__(self) -> None:
        if not self.signals or len(self.signals) > 16 or abs(sum(s.weight for s in self.signals) - 1) > 1e-9:
            raise ValueError("1 to 16 signals' weights add up to 1")
        if not 1 <= len(self.blocking) <= 8 or not 1 <= self.most <= 100:
            raise ValueError("1 to 8 blocking properties and 1 to 100 candidates")
        if not 0 <= self.review < self.high <= 1 or self.margin <= 0:
            raise ValueError("review < high, and a margin above 0")


def _evidence(s: Signal, c: Column) -> Column:
    """A signal's value as it is compared, made once per row before any pairing."""
    return text_v1(c) if s.kind in ("EXACT", "TEXT") else c.try_cast("double") if s.kind == "NUMBER" else c


def signal_score(s: Signal, mine: Column, theirs: Column) -> Column:
    """0 to 1 of values from _evidence; null where evidence is missing. DISTANCE and OVERLAP come
    with the candidate: metres, and the share of the union that both areas cover."""
    if s.kind == "EXACT":
        out = (mine == theirs).cast("double")
    elif s.kind == "TEXT":
        out = F.when((F.length(mine) > 512) | (F.length(theirs) > 512), F.raise_error(F.lit("a compared text has over 512 characters"))).otherwise(similarity(mine, theirs))
    elif s.kind == "NUMBER":
        fine = mine.isNotNull() & theirs.isNotNull() & ~F.isnan(mine) & ~F.isnan(theirs)  # greatest() would pass over a null
        out = F.when(fine, F.greatest(F.lit(0.0), 1 - F.abs(mine - theirs) / F.lit(s.tolerance)))
    elif s.kind == "DISTANCE":
        out = F.when(theirs.isNotNull(), F.greatest(F.lit(0.0), 1 - theirs / F.lit(s.tolerance)))
    elif s.kind == "OVERLAP":
        out = F.when(theirs.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), theirs)))
    else:
        raise ValueError(s.kind)
    return out


def _blocked(policy: WeightedPolicy) -> Column:
    out = F.lit(True)
    for b in policy.blocking:
        out = out & F.coalesce(F.trim(F.col(b).cast("string")) != "", F.lit(False))
    return out


def weighted_scores(incoming: DataFrame, candidates: DataFrame, policy: WeightedPolicy) -> DataFrame:
    """(handoff_id, candidate_id, score, missing, other_evidence, candidates) for all pairs of a
    block; candidates is the block's size. Blocks are counted first, and one of more than
    policy.most candidates, which is never ranked, isn't paired: a row without candidate and
    score stands for it.

    Both sides have the blocking and signal columns; DISTANCE and OVERLAP are the candidates'
    own. Missing evidence scores 0, and weights aren't spread anew. An incoming row whose
    blocking value is null or blank meets nobody.
    """
    keys = list(policy.blocking)
    sizes = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"))
    value = lambda side: [_evidence(s, F.col(s.name)).alias(f"{side}{i}") for i, s in enumerate(policy.signals)]
    mine = incoming.filter(_blocked(policy)).select("handoff_id", *keys, *value("_a")).join(sizes, keys)
    broad = F.col("candidates") > policy.most
    theirs = candidates.select(F.col("object_id").alias("candidate_id"), *keys, *value("_b"))
    pairs = mine.filter(~broad).join(theirs, keys)
    each = [signal_score(s, F.col(f"_a{i}"), F.col(f"_b{i}")) for i, s in enumerate(policy.signals)]
    weighed = [(s, v, F.coalesce(v, F.lit(0.0)) * F.lit(s.weight)) for s, v in zip(policy.signals, each, strict=True)]
    total = sum((w for _, _, w in weighed), F.lit(0.0))
    missing = F.filter(F.array(*[F.when(v.isNull(), f"{s.name}:{s.kind}") for s, v, _ in weighed]), lambda x: x.isNotNull())
    other = sum((w for s, _, w in weighed if s.kind not in SPATIAL), F.lit(0.0))
    scored = pairs.select("handoff_id", "candidate_id", total.alias("score"), missing.alias("missing"), (other > 0).alias("other_evidence"), "candidates")
    rest = mine.filter(broad).select("handoff_id", "candidates")
    return scored.unionByName(rest, allowMissingColumns=True)


def weighted_decisions(incoming: DataFrame, scores: DataFrame, policy: WeightedPolicy) -> DataFrame:
    """(handoff_id, outcome, reason, target, best, margin, candidates), a row per incoming row, from
    weighted_scores(). Too many candidates are never ranked, so no more than policy.most scores
    of a row come together.
    """
    order = F.struct((-F.col("score")).alias("s"), F.col("candidate_id").alias("id"), F.col("other_evidence").alias("o"))
    agg = scores.groupBy("handoff_id").agg(F.max("candidates").alias("candidates"), F.min(order).alias("b"), F.max((F.size("missing") > 0).cast("int")).alias("gaps"), F.slice(F.sort_array(F.collect_list(-F.col("score"))), 1, 2).alias("two"))
    rows = incoming.select("handoff_id", _blocked(policy).alias("_k")).join(agg, "handoff_id", "left")
    n = F.coalesce("candidates", F.lit(0))
    top = -F.col("b.s")
    margin = F.when(n > 1, top + F.col("two")[1]).otherwise(1.0)
    usable = F.col("b.o") | F.lit(policy.spatial_alone)
    match = (top >= policy.high) & (margin >= policy.margin) & usable
    low = top < policy.review
    outcome = F.when(~F.col("_k"), "REVIEW_REQUIRED").when(n == 0, "NEW_OBJECT").when(n > policy.most, "REVIEW_REQUIRED").when(low & (F.col("gaps") == 1), "REVIEW_REQUIRED").when(low, "NEW_OBJECT").when(match, "MATCH").otherwise("REVIEW_REQUIRED")
    reason = F.when(~F.col("_k"), "BLOCKING_EVIDENCE_MISSING").when(n == 0, "NO_CANDIDATES").when(n > policy.most, "RESOLUTION_TOO_BROAD").when(low & (F.col("gaps") == 1), "IDENTITY_EVIDENCE_INCOMPLETE").when(low, "BELOW_REVIEW_THRESHOLD").when(match, "HIGH_CONFIDENCE").otherwise("AMBIGUOUS_OR_POLICY_REVIEW")
    ranked = n.between(1, policy.most)
    return rows.select("handoff_id", outcome.alias("outcome"), reason.alias("reason"), F.when(outcome == "MATCH", F.col("b.id")).alias("target"), F.when(ranked, F.round(top, 6)).alias("best"), F.when(ranked, F.round(margin, 6)).alias("margin"), n.cast("long").alias("candidates"))


# --- governed rules ---


COMPARATORS = {"CONCEPT": lambda c: c, "TEXT_V1": text_v1, "DECIMAL_V1": decimal_text, "JSON_V1": canonical_json}
#: Field sets are bit masks, and disjoint ones are enumerated.
MOST_SIGNALS = 16


@dataclass(frozen=True)
class GovernedPolicy:
    """signals: property -> comparator. sufficient, distinct: sets of properties that prove
    equality, or difference, together."""

    signals: tuple[tuple[str, str], ...]
    sufficient: tuple[tuple[str, ...], ...]
    distinct: tuple[tuple[str, ...], ...] = ()
    most: int = 10
    allow_new: bool = False

    def __post_init__(self) -> None:
        names = {n for n, _ in self.signals}
        if not names or any(not r or not set(r) <= names for r in (*self.sufficient, *self.distinct)):
            raise ValueError("rules name signals, and there is a signal")
        if len(names) > MOST_SIGNALS or len(names) < len(self.signals):
            raise ValueError(f"signals are distinct, and {MOST_SIGNALS} at most")


def tokens(rows: DataFrame, key: str, policy: GovernedPolicy) -> DataFrame:
    """(key, property, comparator, token): one row per present property; token is the SHA-256
    of the normalised value."""
    one = [F.struct(F.lit(p).alias("property"), F.lit(c).alias("comparator"), COMPARATORS[c](F.col(p).cast("string")).alias("v")) for p, c in policy.signals]
    out = rows.select(key, F.explode(F.array(*one)).alias("t")).filter(F.trim("t.v") != "")
    return out.select(key, "t.property", "t.comparator", F.sha2("t.v", 256).alias("token"))


def shapes(token_rows: DataFrame, key: str) -> DataFrame:
    """(key, fields sorted, shape): shape is the SHA-256 of the names joined by NUL."""
    out = token_rows.groupBy(key).agg(F.sort_array(F.collect_set("property")).alias("fields"))
    return out.withColumn("shape", F.sha2(F.array_join("fields", "\0"), 256))


def _masked(token_rows: DataFrame, key: str, policy: GovernedPolicy) -> DataFrame:
    """(key, mask): the properties a key has tokens of, a bit each in the order of the signals."""
    bit = F.lit(0)
    for i, (p, _) in enumerate(policy.signals):
        bit = F.when(F.col("property") == p, 1 << i).otherwise(bit)
    return token_rows.groupBy(key).agg(F.bit_or(bit).alias("mask"))


def _apart(masks: DataFrame, policy: GovernedPolicy) -> DataFrame:
    """(mask, other): every non-empty set of properties that is disjoint from each of the masks."""
    every = F.sequence(F.lit(1), F.lit((1 << len(policy.signals)) - 1))
    return masks.select("mask").distinct().select("mask", F.explode(F.filter(every, lambda o: o.bitwiseAND(F.col("mask")) == 0)).alias("other"))


def _broad(mine: DataFrame, theirs: DataFrame, masks: DataFrame, held: DataFrame, policy: GovernedPolicy) -> DataFrame:
    """(handoff_id) of subjects that a single token, or the disjoint field sets, give more than
    policy.most candidates: told from counts per token and field set, without pairing."""
    keys = ["property", "comparator", "token"]
    hot = theirs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > policy.most)
    counts = held.groupBy(F.col("mask").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    wide = _apart(masks, policy).join(counts, "other").groupBy("mask").agg(F.sum("n").alias("n")).filter(F.col("n") > policy.most)
    return mine.join(hot, keys, "left_semi").select("handoff_id").union(masks.join(wide, "mask", "left_semi").select("handoff_id")).distinct()


def _assessed(mine: DataFrame, theirs: DataFrame, masks: DataFrame, held: DataFrame, broad: DataFrame, policy: GovernedPolicy) -> DataFrame:
    """(handoff_id, object_id, exact, excluded) of the retrieved candidates: those sharing an equal
    token, and those whose fields are disjoint from the subject's.

    Broad subjects aren't paired: nothing of theirs is ranked. So no token or field set brings a
    subject more than policy.most candidates.
    """
    mine, masks = (df.join(broad, "handoff_id", "left_anti") for df in (mine, masks))
    equal = mine.join(theirs, ["property", "comparator", "token"]).select("handoff_id", "object_id")
    disjoint = masks.join(_apart(masks, policy), "mask").select("handoff_id", "other").join(held.withColumnRenamed("mask", "other"), "other").select("handoff_id", "object_id")
    hits = equal.unionByName(disjoint).distinct()
    as_map = lambda t, k, name: t.groupBy(k).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("property", "token")))).alias(name))
    rows = hits.join(as_map(mine, "handoff_id", "a"), "handoff_id").join(as_map(theirs, "object_id", "b"), "object_id")
    ka, kb = F.map_keys("a"), F.map_keys("b")
    shared = F.array_intersect(ka, kb)
    agree = F.filter(shared, lambda p: F.col("a")[p] == F.col("b")[p])
    differ = F.array_except(shared, agree)
    has = lambda names, within: F.size(F.array_except(F.array(*[F.lit(n) for n in names]), within)) == 0
    nested = (F.size(F.array_except(ka, kb)) == 0) | (F.size(F.array_except(kb, ka)) == 0)
    any_of = lambda rules, within: F.greatest(F.lit(False), F.lit(False), *[has(r, within) for r in rules])
    exact = nested & any_of(policy.sufficient, shared) & (F.size(differ) == 0)
    excluded = ((F.size(shared) > 0) & (F.size(agree) == 0)) | (~any_of(policy.sufficient, agree) & any_of(policy.distinct, differ))
    return rows.select("handoff_id", "object_id", exact.alias("exact"), (excluded & ~exact).alias("excluded"))


def governed_decisions(subjects: DataFrame, candidates: DataFrame, policy: GovernedPolicy, complete: bool = True) -> DataFrame:
    """(handoff_id, outcome, reason, target, candidates). `complete`: whether the index that the
    candidates came from covers the current snapshot. Beyond policy.most candidates the count
    is policy.most + 1, as retrieval ends there."""
    return decide_by_tokens(subjects, stored(tokens(candidates, "object_id", policy), "candidate-tokens"), policy, complete)


def decide_by_tokens(subjects: DataFrame, theirs: DataFrame, policy: GovernedPolicy, complete: bool = True) -> DataFrame:
    """governed_decisions() against tokens(object_id, property, comparator, token) that are stored."""
    mine = stored(tokens(subjects, "handoff_id", policy), "subject-tokens")
    masks, held = _masked(mine, "handoff_id", policy), _masked(theirs, "object_id", policy)
    wide = stored(_broad(mine, theirs, masks, held, policy), "subjects-broad")
    found = _assessed(mine, theirs, masks, held, wide, policy).groupBy("handoff_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("exact").cast("int")).alias("ne"), F.sum(F.col("excluded").cast("int")).alias("nx"), F.min(F.when(F.col("exact"), F.col("object_id"))).alias("hit"))
    exposed = masks.select("handoff_id", F.lit(True).alias("_f"))
    broad = wide.withColumn("_b", F.lit(policy.most + 1))
    rows = subjects.select("handoff_id").join(exposed, "handoff_id", "left").join(found, "handoff_id", "left").join(broad, "handoff_id", "left")
    n, ne, nx = F.least(F.coalesce("_b", "n", F.lit(0)), F.lit(policy.most + 1)), F.coalesce("ne", F.lit(0)), F.coalesce("nx", F.lit(0))
    new = F.lit(policy.allow_new)
    cases = [
        (n > policy.most, "REVIEW_REQUIRED", "RESOLUTION_TOO_BROAD"),
        (F.lit(not complete), "REVIEW_REQUIRED", "CANDIDATE_COVERAGE_UNVERIFIED"),
        (F.col("_f").isNull(), "REVIEW_REQUIRED", "NO_EXPOSED_CANONICAL_FIELDS"),
        ((n == 0) & new, "NEW_OBJECT", "NO_CANDIDATES"),
        (n == 0, "REVIEW_REQUIRED", "CREATION_NOT_AUTHORIZED"),
        ((ne == 1) & (nx == n - 1), "MATCH", "COMPLETE_CANONICAL_EQUALITY"),
        ((ne == 0) & (nx == n) & new, "NEW_OBJECT", "ALL_CANDIDATES_DISTINCT"),
    ]
    outcome, reason = F.lit("REVIEW_REQUIRED"), F.lit("UNRESOLVED_IDENTITY")
    for test, o, r in reversed(cases):
        outcome, reason = F.when(test, o).otherwise(outcome), F.when(test, r).otherwise(reason)
    return rows.select("handoff_id", outcome.alias("outcome"), reason.alias("reason"), F.when(outcome == "MATCH", F.col("hit")).alias("target"), n.cast("long").alias("candidates"))


def policy_fingerprint(policy: GovernedPolicy) -> str:
    import hashlib
    import json

    return hashlib.sha256(json.dumps([sorted(policy.signals), sorted(map(sorted, policy.sufficient)), sorted(map(sorted, policy.distinct)), policy.most, policy.allow_new]).encode()).hexdigest()


def preflight(decisions: DataFrame, names: Sequence[str] = ("outcome", "reason")) -> DataFrame:
    """Counts by outcome and reason, and the largest candidate set."""
    return decisions.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.max("candidates").alias("most_candidates"))
