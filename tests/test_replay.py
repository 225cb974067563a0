"""Replay plans and recovery from outages, against plain loops."""

import random

from cairnlake.operators import replay

REFS = "array<struct<kind:string,ref:string>>"
CATALOGUE = [("BUNDLE", "b1", "1", "h1", "AVAILABLE"), ("MAPPING", "m1", "1", "h2", "AVAILABLE"), ("MAPPING", "m2", "1", "h3", "REVOKED")]


def tables(spark, handoffs, raws, catalogue=CATALOGUE):
    return (
        spark.createDataFrame(handoffs, f"handoff_id string, content_hash string, raw_id string, refs {REFS}, ingestion_run_id string, body string"),
        spark.createDataFrame(raws, "raw_id string, tenant_id string, tier string, state string, content_hash string, size_bytes long"),
        spark.createDataFrame(catalogue, "kind string, ref string, version string, content_hash string, status string"),
    )


HANDOFFS = [
    ("h1", "c1", "r1", [("BUNDLE", "b1"), ("MAPPING", "m1")], "i1", "x"), ("h2", "c2", "r2", [("BUNDLE", "b1"), ("MAPPING", "m2")], "i2", "y"),
    ("h3", "c3", "r3", [("BUNDLE", "b1")], "i3", "z"), ("h4", "c4", "r4", [("BUNDLE", "b1")], "i4", "w"), ("h5", "c5", "r5", [], "i5", None),
]
RAWS = [("r1", "t", "RAW", "VERIFIED", "c1", 9), ("r2", "t", "RAW", "COLD", "c2", 9), ("r3", "t", "RAW", "STAGED", "c3", 9), ("r4", "t", "RAW", "VERIFIED", "other", 9), ("r5", "t", "RAW", "COMPACTED", "c5", 9)]
REQUESTS = [("p1", "t", "h1", "why"), ("p2", "t", "h2", "why"), ("p3", "t", "h3", "why"), ("p4", "t", "h4", "why"), ("p5", "t", "h5", "why"), ("p6", "t", "h1", " "), ("p7", "else", "h1", "why")]


def planned(spark, *data):
    return replay.plan_replays(spark.createDataFrame(REQUESTS, "plan_id string, tenant_id string, source_handoff_id string, reason string"), *data)


def commands(spark, rows):
    return spark.createDataFrame(rows, "plan_id string, tenant_id string, seq long, command string, expected_version long, reason string")


def test_plans(spark):
    data = tables(spark, HANDOFFS, RAWS)
    got = {r.plan_id: (r.outcome, r.state, len(r.missing or [])) for r in planned(spark, *data).collect()}
    assert got == {"p1": ("REPRODUCE_PLANNED", "READY", 0), "p2": ("REPRODUCE_PAUSED", "PAUSED", 1), "p3": ("RAW_NOT_DURABLE", None, 0), "p4": ("RAW_NOT_DURABLE", None, 0), "p5": ("REPRODUCE_PLANNED", "READY", 0), "p6": ("REASON_REQUIRED", None, 0), "p7": ("RAW_NOT_DURABLE", None, 0)}


def test_steps(spark):
    data = tables(spark, HANDOFFS, RAWS)
    plans = planned(spark, *data).filter("state IS NOT NULL").drop("outcome")
    batch = commands(spark, [
        ("p1", "t", 1, "EXECUTE", 5, None), ("p1", "t", 2, "EXECUTE", 0, None), ("p1", "t", 3, "EXECUTE", 9, None), ("p1", "t", 4, "ABORT", 1, "late"),
        ("p2", "t", 1, "RESUME", 0, None), ("p2", "t", 2, "EXECUTE", 0, None), ("p2", "t", 3, "ABORT", 0, ""), ("p5", "else", 1, "EXECUTE", 0, None), ("no", "t", 1, "ABORT", 0, "x"),
    ])
    out = replay.step_replays(plans, batch, *data)
    got = {r.plan_id: (r.state, r.version, [x.outcome for x in r.said], r.replay_handoff_id) for r in out.collect()}
    assert got == {
        "p1": ("SUCCEEDED", 1, ["VERSION_CONFLICT", "REPRODUCE_EXECUTED", "REPRODUCE_DONE", "VERSION_CONFLICT"], "replay-p1"),
        "p2": ("PAUSED", 0, ["REPRODUCE_RECHECK_FAILED", "VERSION_CONFLICT", "REASON_REQUIRED"], None),
        "p5": ("READY", 0, [], None),
    }
    assert {(r.plan_id, r.tenant_id) for r in replay.unknown(plans, batch).collect()} == {("p5", "else"), ("no", "t")}
    (row,) = replay.replayed_handoffs(out, data[0]).collect()
    assert (row.handoff_id, row.ingestion_run_id, row.content_hash, row.body, row.replay_of) == ("replay-p1", "reproduce-p1", "c1", "x", "h1")

    # references come back, one is published anew, a source changes: the next batches see it
    back = [*CATALOGUE[:2], ("MAPPING", "m2", "1", "h3", "AVAILABLE")]
    data = tables(spark, HANDOFFS, RAWS, back)
    out = replay.step_replays(out.drop("said"), commands(spark, [("p2", "t", 1, "RESUME", 0, None), ("p2", "t", 2, "EXECUTE", 1, None), ("p1", "t", 3, "EXECUTE", 0, None)]), *data)
    got = {r.plan_id: (r.state, r.version, [x.outcome for x in r.said]) for r in out.collect()}
    assert got["p2"] == ("SUCCEEDED", 2, ["REPRODUCE_RESUMED", "REPRODUCE_EXECUTED"]) and got["p1"] == ("SUCCEEDED", 1, ["REPRODUCE_DONE"])


def test_changes_between_plan_and_execution(spark):
    data = tables(spark, HANDOFFS, RAWS)
    plans = planned(spark, *data).filter("plan_id = 'p1'").drop("outcome")
    run = commands(spark, [("p1", "t", 1, "EXECUTE", 0, None)])
    said = lambda *d: [(r.state, r.said[0].outcome, r.baseline_hash is None, len(r.missing)) for r in replay.step_replays(plans, run, *tables(spark, *d)).collect()]
    assert said(HANDOFFS, RAWS, [("BUNDLE", "b1", "2", "new", "AVAILABLE"), CATALOGUE[1]]) == [("PAUSED", "REPRODUCE_PAUSED", True, 1)]
    assert said(HANDOFFS, [("r1", "t", "RAW", "DELETED", "c1", 9)]) == [("READY", "RAW_NOT_DURABLE", False, 0)]
    assert said([("h1", "c1", "r1", [("BUNDLE", "b1")], "i1", "x")], RAWS) == [("READY", "SOURCE_CHANGED", False, 0)]
    assert said([("h1", "c9", "r1", HANDOFFS[0][3], "i1", "x")], [("r1", "t", "RAW", "COLD", "c9", 9)]) == [("READY", "SOURCE_CHANGED", False, 0)]


def looped(job, tries, factor, most, millis):
    """One job's attempts, one after another."""
    state, started, n, total, due, code = job
    for at, claimed, outcome, earliest in sorted(tries):
        if state in ("QUARANTINED", "SUCCEEDED"):
            break
        if started is not None and (n >= most or at >= started + millis):
            state, due, code = "QUARANTINED", None, "RETRY_EXHAUSTED"
            continue
        if started is not None:
            n, total = n + 1, total + 1
        if outcome == "OK":
            state, started, n, due, code = "SUCCEEDED", None, 0, None, None
        elif outcome == "UNAVAILABLE":
            if started is None:
                started, n, total = claimed, 1, total + 1
            due = max(at + int(replay.DELAYS[min(n, 5) - 1] * factor(n)), earliest or 0)
            state, code = "PAUSED", "DEPENDENCY_UNAVAILABLE"
            if n >= most or due >= started + millis:
                state, due, code = "QUARANTINED", None, "RETRY_EXHAUSTED"
        else:
            state, due, code = "QUARANTINED", None, outcome
    return state, started, n, total, due, code


def test_recovery(spark):
    import hashlib

    rnd, jobs, tries = random.Random(2), {}, {}
    for j in range(80):
        jobs[j] = ("RUNNING", None, 0, rnd.randrange(3), None, None)
        at, tries[j] = 1000, []
        for _ in range(rnd.randrange(9)):
            at += rnd.choice((1, 5_000, 70_000, 900_000))
            tries[j].append((at, at - 500, rnd.choice(("OK", "UNAVAILABLE", "UNAVAILABLE", "UNAVAILABLE", "UNAVAILABLE", "BROKEN")), rnd.choice((None, None, at + 400_000))))
    factor = lambda j: lambda n: 0.8 + int(hashlib.sha256(f"{j}|{n}".encode()).hexdigest()[:3], 16) / 4095 * 0.4
    a = spark.createDataFrame([(j, *t) for j, ts in tries.items() for t in ts] + [(-1, 1, 1, "OK", None)], "job_id long, at_ms long, claimed_ms long, outcome string, not_before_ms long")
    b = spark.createDataFrame([(j, *x) for j, x in jobs.items()], "job_id long, state string, started_ms long, attempts long, cumulative long, due_ms long, failure_code string")
    got = {r.job_id: tuple(r)[1:] for r in replay.recover(b, a, 5, 2_000_000).collect()}
    assert got == {j: looped(jobs[j], tries[j], factor(j), 5, 2_000_000) for j in jobs}
    assert len({x[0] for x in got.values()}) == 4 and {"RETRY_EXHAUSTED", "BROKEN"} <= {x[5] for x in got.values()}
