"""The stored identity index: refreshed as if built anew, stale by itself, whole after a failed run."""

import random

import pytest

from cairnlake.operators.identity import GovernedPolicy, governed_decisions, tokens
from cairnlake.operators.identity_index import CoverageStale, IdentityIndex

POLICY = GovernedPolicy((("a", "TEXT_V1"), ("b", "CONCEPT"), ("c", "JSON_V1")), (("a", "b"),), (("b",),), 3, True)
SCHEMA = "object_id string, a string, b string, c string, status string, version long"


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_refresh_equals_rebuild(spark, tmp_path):
    rnd = random.Random(4)
    make = lambda i, v: (f"o{i}", rnd.choice([None, "X ", "y"]), rnd.choice([None, "p", "q"]), rnd.choice([None, '{"k": 1, "j": 2}', '{"j":2,"k":1}']), rnd.choice(["ACTIVE", "ACTIVE", "MERGED"]), v)
    now = {i: make(i, 1) for i in range(30)}
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    index = IdentityIndex(spark, f"file://{tmp_path}/i", POLICY, 4)
    with pytest.raises(CoverageStale):
        index.refresh(frame(list(now.values())))
    assert not index.complete(frame(list(now.values())))
    index.build(frame(list(now.values())))
    for step in range(2, 5):
        changed = {i: make(i, step) for i in rnd.sample(range(36), 9)}
        now |= changed
        current = frame(list(now.values()))
        assert index.complete(current) == all(r[4] != "ACTIVE" for r in changed.values())
        index.refresh(frame(list(changed.values())))
        assert index.complete(current)
        live = current.filter("status = 'ACTIVE'")
        assert rows_of(index.postings().select("object_id", "property", "comparator", "token")) == rows_of(tokens(live, "object_id", POLICY))
        again = IdentityIndex(spark, f"file://{tmp_path}/again{step}", POLICY, 3)
        again.build(current)
        assert again.ref() == index.ref()
    other = IdentityIndex(spark, f"file://{tmp_path}/i", GovernedPolicy(POLICY.signals, POLICY.sufficient), 4)
    assert not other.complete(current)
    with pytest.raises(CoverageStale):
        other.refresh(current)
    subjects = spark.createDataFrame([("h1", "x", "p", None), ("h2", None, None, None), ("h3", "y", None, '{"k":1,"j":2}')], "handoff_id string, a string, b string, c string")
    assert rows_of(index.decide(subjects, current)) == rows_of(governed_decisions(subjects, live, POLICY))
    later = current.withColumn("version", current.version + 1)
    assert {r.reason for r in index.decide(subjects, later).filter("candidates <= 3").collect()} == {"CANDIDATE_COVERAGE_UNVERIFIED"}
    # a run that ended between its tables and its coverage leaves no coverage
    index._objects.apply(frame(list(now.values())[:1]).selectExpr("object_id", "CAST(map() AS map<string,struct<comparator:string,token:string>>) AS tokens", "99L AS version", "false AS deleted"), "version")
    assert index.coverage() is None and not index.complete(current)
    index.build(current.withColumn("version", current.version + 200))
    assert index.complete(current.withColumn("version", current.version + 200))


def test_policies():
    with pytest.raises(ValueError):
        GovernedPolicy(tuple((f"p{i}", "CONCEPT") for i in range(17)), (("p1",),))
