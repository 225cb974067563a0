"""Batches of merges, splits and review packages against one after the other in plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from cairnlake.operators import governance

sha = lambda s: hashlib.sha256(str(s).encode()).hexdigest()


def chosen(members):
    own, taken, out = {}, set(), {}
    for o, t in members:
        own.setdefault(o, set()).add(t)
    for o in sorted(own, key=lambda x: (sha(x), x)):
        out[o] = not own[o] & taken
        taken |= own[o] if out[o] else set()
    return out


def test_independent(spark):
    rng = random.Random(1)
    hot = [(i, 0) for i in range(60)] + [(i, i + 1000) for i in range(60)]
    chain = [(i, t) for i in range(100, 300) for t in (5000 + i, 5001 + i)]
    some = [(rng.randrange(400, 460), rng.randrange(6000, 6080)) for _ in range(150)]
    for members in (hot, chain + some, hot + chain + some + some[:20]):
        df = spark.createDataFrame([*members, (None, 1), (999, None)], "o long, t long")
        got = [(r.o, r.chosen) for r in governance.independent(df, "o", "t").collect()]
        assert len(got) == len(dict(got)) and dict(got) == chosen(members)
    assert governance.independent(df.limit(0), "o", "t").collect() == []


def test_plans(spark):
    rng, n = random.Random(4), 60
    objects = {f"o{i}": ("t" if i % 9 else "u", "T", "MERGED" if i % 17 == 5 else "ACTIVE", i % 3) for i in range(n)}
    bindings = {f"b{i}": f"o{rng.randrange(n)}" for i in range(90)}
    edges = {f"e{i}": (f"o{rng.randrange(n)}", rng.choice("rs"), f"o{rng.randrange(n)}") for i in range(200)}
    edges = {k: v for k, v in {v: k for k, v in edges.items()}.items()}
    edges = {k: v for v, k in edges.items()}
    plans, members, choices = [], [], []
    for i in range(30):
        a, b, c = (f"o{rng.randrange(n)}" for _ in range(3))
        pid = f"p{i}"
        if i % 3:
            plans.append((pid, "MERGE", "PLANNED", 1, 1 + (i % 11 == 1), "r"))
            members += [(pid, "SURVIVOR", a, objects[a][3]), (pid, "MERGED", b, objects[b][3] + (i % 4 == 1))]
        else:
            plans.append((pid, "SPLIT", "PLANNED", 1, 1, "r"))
            members += [(pid, "ORIGINAL", a, objects[a][3]), (pid, "SUCCESSOR", b, objects[b][3]), (pid, "SUCCESSOR", c, objects[c][3])]
            own = [x for x, o in bindings.items() if o == a]
            choices += [(pid, x, rng.choice([b, c, "UNRESOLVED"])) for x in own]
    plans += [("none", "SPLIT", "PLANNED", 1, 1, "r"), ("odd", None, "PLANNED", 1, 1, None), ("long", "MERGE", "PLANNED", 1, 1, "x" * 1001)]

    def checked(pid, kind, state, version, expected, reason):
        m = [x for x in members if x[0] == pid]
        ids = [x[2] for x in m]
        if kind not in ("MERGE", "SPLIT"):
            return "KIND_INVALID"
        if len(reason) > 1000:
            return "REASON_TOO_LONG"
        if version != expected:
            return "VERSION_CONFLICT"
        if len(set(ids)) < (2 if kind == "MERGE" else 3):
            return "MERGE_SAME_OBJECT" if kind == "MERGE" else "SPLIT_SUCCESSORS_INVALID"
        if any(objects[o][2] != "ACTIVE" for o in ids):
            return "OBJECT_NOT_ACTIVE"
        if kind == "MERGE" and objects[ids[0]][:2] != objects[ids[1]][:2]:
            return "IDENTITY_INCOMPATIBLE"
        return "READY" if all(objects[x[2]][3] == x[3] for x in m) else "STALE"

    want = {p[0]: checked(*p) for p in plans}
    free = chosen([(m[0], m[2]) for m in members if want[m[0]] == "READY"])
    want |= {p: "EXECUTED" if yes else "CONFLICT" for p, yes in free.items()}
    out = governance.execute_plans(
        spark.createDataFrame(plans, "plan_id string, kind string, state string, version int, expected_version int, reason string"), spark.createDataFrame(members, "plan_id string, role string, object_id string, planned_revision int"),
        spark.createDataFrame([(o, *v) for o, v in objects.items()], "object_id string, tenant_id string, canonical_type string, status string, revision int"),
        spark.createDataFrame([(b, o, "ACTIVE") for b, o in bindings.items()], "binding string, object_id string, state string"),
        spark.createDataFrame([(e, s, r, t, "ACTIVE") for e, (s, r, t) in edges.items()], "relationship_id string, source_id string, relation string, target_id string, status string"),
        spark.createDataFrame(choices, "plan_id string, binding string, choice string"),
    )
    assert {r.plan_id: r.outcome for r in out["plans"].collect()} == want and {"EXECUTED", "CONFLICT", "STALE"} <= set(want.values())
    # one after the other: no two share an object, so the order doesn't matter
    into, split, moved, issues = {}, {}, {}, set()
    for pid, kind, *_ in plans:
        if want[pid] == "EXECUTED":
            role = {r: o for p, r, o, _ in members if p == pid}
            if kind == "MERGE":
                into[role["MERGED"]] = role["SURVIVOR"]
                moved |= {b: (role["SURVIVOR"], "REALLOCATED", pid) for b, o in bindings.items() if o == role["MERGED"]}
            else:
                split[role["ORIGINAL"]] = pid
                for p, b, c in choices:
                    if p == pid:
                        moved[b] = (None, "UNRESOLVED", pid) if c == "UNRESOLVED" else (c, "REALLOCATED", pid)
                        issues |= {(pid, f"source-binding://{b}")} if c == "UNRESOLVED" else set()
    assert {r.binding: (r.object_id, r.disposition, r.plan_id) for r in out["bindings"].collect()} == moved and moved
    assert {r.object_id: (r.status, r.redirect_to, r.revision) for r in out["objects"].collect()} == {o: ("MERGED", s, objects[o][3] + 1) for o, s in into.items()} | {o: ("SPLIT", None, objects[o][3] + 1) for o in split}
    after = {}
    for e, (s, r, t) in edges.items():
        key, was = (into.get(s, s), r, into.get(t, t)), s in into or t in into
        issues |= {(split[x], f"relationship://{e}") for x in (s, t) if x in split}
        after[e] = [key, was, "SUPERSEDED_SELF_LOOP" if was and key[0] == key[2] else "REPOINTED" if was else "UNCHANGED"]
    for key in {v[0] for v in after.values()}:
        for e in sorted((e for e, v in after.items() if v[0] == key), key=lambda e: (after[e][1], e))[1:]:
            if after[e][2] == "REPOINTED":
                after[e][2] = "SUPERSEDED_DUPLICATE"
    for e, (s, r, t) in edges.items():
        if (s in split or t in split) and after[e][2] in ("UNCHANGED", "REPOINTED"):
            after[e][2] = "REVIEW_REQUIRED"
    assert {r.relationship_id: (r.new_source, r.new_target, r.new_status) for r in out["edges"].collect()} == {e: (k[0], k[2], st) for e, (k, _, st) in after.items() if st != "UNCHANGED"}
    assert {(r.plan_id, r.resource) for r in out["issues"].collect()} == issues


def packages_of(spark, packages, choices, issues):
    schema = "issue_id long, tenant_id string, version long, state string, review_hash string, candidates array<string>"
    made, decided = governance.confirm_packages(spark.createDataFrame(packages, "package_id string, tenant_id string, expected_digest string"), spark.createDataFrame(choices, "package_id string, issue_id long, expected_version long, expected_review_hash string, action string, target string, reason string"), spark.createDataFrame(issues, schema))
    return {r.package_id: r.outcome for r in made.collect()}, {(r.package_id, r.issue_id, r.state, r.target, r.version) for r in decided.collect()}


def test_packages(spark):
    h = ["sha256:" + sha(i) for i in range(9)]
    issues = [(i, "a" if i < 4 else "b", i, "OPEN" if i != 3 else "RESOLVED", h[i], ["x", "y"]) for i in range(8)]
    schema = "issue_id long, tenant_id string, version long, state string, review_hash string, candidates array<string>"
    now = {r.tenant_id: r.digest for r in governance.review_packages(spark.createDataFrame(issues, schema)).collect()}
    ok = lambda p, i, **m: tuple({"p": p, "i": i, "v": i, "h": None, "a": "APPROVE", "t": "x", "r": None, **m}.values())
    all_a = lambda p, **m: [ok(p, 0, **m), ok(p, 1), ok(p, 2, a="DISMISS")]
    packages = [("whole", "a", now["a"]), ("old", "a", now["b"]), ("blank", "a", " "), ("none", "a", now["a"]), ("stale", "a", now["a"]), ("part", "a", now["a"]), ("target", "b", "any"), ("some", "b", "any"), ("mixed", "b", "any"), ("twice", "a", now["a"]), ("other", "b", "any"), ("word", "a", now["a"]), ("long", "a", now["a"])]
    choices = [*all_a("whole"), *all_a("old"), *all_a("blank"), *all_a("stale", v=7), *all_a("part")[:2], ok("target", 4, h=h[4], t="z"), ok("some", 5, h=h[5]), ok("some", 6, h=h[6], t="y"), ok("mixed", 5, h=h[5]), ok("mixed", 6)]
    choices += [*all_a("twice"), ok("twice", 0), ok("other", 0, h=h[0]), *all_a("word", a="KEEP"), *all_a("long", r="x" * 1001)]
    got, decided = packages_of(spark, packages, choices, issues)
    assert got == {"whole": "CONFIRMED", "old": "STALE", "blank": "INVALID", "none": "STALE", "stale": "STALE", "part": "STALE", "target": "TARGET_NOT_A_CANDIDATE", "some": "CONFIRMED", "mixed": "INVALID", "twice": "INVALID", "other": "STALE", "word": "INVALID", "long": "INVALID"}
    assert decided == {("whole", 0, "RESOLVED", "x", 1), ("whole", 1, "RESOLVED", "x", 2), ("whole", 2, "DISMISSED", None, 3), ("some", 5, "RESOLVED", "x", 6), ("some", 6, "RESOLVED", "y", 7)}
    two, decided = packages_of(spark, [("p", "a", now["a"]), ("q", "a", now["a"])], [*all_a("p"), *all_a("q")], issues)
    assert sorted(two.values()) == ["CONFIRMED", "CONFLICT"] and len(decided) == 3
    assert packages_of(spark, [("p", "a", now["a"])], all_a("p"), [*issues, (99, None, 1, "OPEN", h[8], [])])[0] == {"p": "BACKFILL_REQUIRED"}


def test_digest(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("t"), "id", F.concat(F.lit("v"), "id").alias("leaf"))
    one = {r.t: (r.digest, r.n) for r in governance.merkle_digest(rows, "t", "id", "leaf").collect()}
    again = {r.t: (r.digest, r.n) for r in governance.merkle_digest(rows.orderBy(F.desc("id")).repartition(7), "t", "id", "leaf").collect()}
    assert one == again and {n for _, n in one.values()} == {1000} and len({d for d, _ in one.values()}) == 3
    other = {r.t: r.digest for r in governance.merkle_digest(rows.withColumn("leaf", F.when(F.col("id") == 4, "w").otherwise(F.col("leaf"))), "t", "id", "leaf").collect()}
    assert [other[t] == one[t][0] for t in range(3)] == [True, False, True]
