"""Materialised revisions: batches, refusals, deletions; reconstruction of each."""

import json

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import revisions
from cairnlake.operators.revisions import Profile, Rule

SCHEMA = "object_id string, seq long, handoff_id string, source_id string, mode string, base_revision long, base_content string, fingerprint string, observed_at timestamp_ntz, payload map<string,string>, deletes array<string>"
PROFILE = Profile((Rule("height", ("a", "b")), Rule("name", ("b",), "PERSONAL", ("b",))), 3)


def observations(spark, rows):
    """(object, seq, source, payload, more)"""
    full = [(o, n, f"h{n}", s, m.get("mode", "FULL_SNAPSHOT"), m.get("base"), m.get("content"), m.get("print"), None, p, m.get("deletes")) for o, n, s, p, m in rows]
    return spark.createDataFrame(full, SCHEMA)


def told(results):
    return [(r.object_id, r.seq, r.outcome, r.revision_no) for r in results.orderBy("object_id", "seq").collect()]


def test_order_decides(spark):
    rows = [
        ("x", 1, "c", {"height": "1"}, {"mode": "DELTA_PATCH"}),  # nothing to go on from
        ("x", 2, "c", {"height": "1"}, {}),
        ("x", 3, "d", {"height": "2"}, {}),  # unranked sources differ: the value stays
        ("x", 4, "b", {"height": "3", "name": '"n"'}, {"print": "f"}),
        ("x", 5, "a", {"height": "9"}, {"print": "f"}),  # an equal fingerprint says nothing
        ("x", 6, "a", {"height": "3"}, {"mode": "DELTA_PATCH", "base": 1}),
        ("x", 7, "a", {"height": "3"}, {"mode": "PROPERTY_EVENTS", "base": 2}),  # same value, new authority
        ("x", 8, "a", None, {"deletes": ["name"]}),  # may not delete
        ("x", 9, "b", {}, {"deletes": ["name"]}),
        ("x", 10, "b", {"name": "null"}, {}),  # an explicit null is a value
        ("y", 1, "b", {"other": "1"}, {}),
    ]
    results, states = revisions.materialize(observations(spark, rows), PROFILE)
    assert told(results) == [("x", 1, "DELTA_BASE_REQUIRED", None), ("x", 2, "REVISION", 1), ("x", 3, "UNCHANGED", 1), ("x", 4, "REVISION", 2), ("x", 5, "UNCHANGED", 2), ("x", 6, "DELTA_BASE_MISMATCH", None), ("x", 7, "REVISION", 3), ("x", 8, "UNCHANGED", 3), ("x", 9, "REVISION", 4), ("x", 10, "REVISION", 5), ("y", 1, "REVISION", 1)]
    by = {(r.object_id, r.seq): r for r in results.collect()}
    assert by["x", 3].conflicts == ["height"] and by["x", 9].representation == "FULL_CHECKPOINT" and dict(by["x", 9]["values"]) == {"height": "3"}
    assert by["x", 7].canonical_hash == by["x", 4].canonical_hash != by["x", 9].canonical_hash and dict(by["x", 10].set) == {"name": "null"}
    out = {(r.object_id, r.revision_no): (r.status, r["values"]) for r in revisions.reconstruct(revisions.revisions_of(results)).collect()}
    assert out == {("x", 1): ("OK", {"height": "1"}), ("x", 2): ("OK", {"height": "3", "name": '"n"'}), ("x", 3): ("OK", {"height": "3", "name": '"n"'}), ("x", 4): ("OK", {"height": "3"}), ("x", 5): ("OK", {"height": "3", "name": "null"}), ("y", 1): ("OK", {})}
    assert {r.object_id: json.loads(r.state)["revision"] for r in states.collect()} == {"x": 5, "y": 1}


@pytest.mark.parametrize("cut", [(40,), (1, 90, 91)])
def test_batches_equal_the_whole(spark, cut):
    rows = [(f"o{n * 7 % 5}", n, "abcde"[n * 11 % 5], {"height": str(n % 3), **({"name": f'"{n % 4}"'} if n % 2 else {})}, {"deletes": ["name"] if n % 9 == 0 else None, "mode": "DELTA_PATCH" if n % 4 == 0 else "FULL_SNAPSHOT", "base": n % 6 if n % 8 == 0 else None}) for n in range(120)]
    whole, _ = revisions.materialize(observations(spark, rows), PROFILE)
    states, parts = None, []
    for a, b in zip((0, *cut), (*cut, 120), strict=True):
        results, states = revisions.materialize(observations(spark, rows[a:b]), PROFILE, states)
        parts += results.collect()
    assert sorted(map(repr, parts)) == sorted(map(repr, whole.collect()))
    assert states.count() == 5


def test_damaged_chains(spark):
    rows = [("x", n, "a", {"height": str(n)}, {}) for n in range(1, 8)]
    made = revisions.revisions_of(revisions.materialize(observations(spark, rows), PROFILE)[0])
    ask = spark.createDataFrame([("x", n) for n in range(1, 9)] + [("none", 1)], "object_id string, revision_no long")
    status = lambda df, **k: [r.status for r in revisions.reconstruct(df, ask, **k).orderBy(F.col("object_id").desc(), "revision_no").collect()]
    assert status(made) == ["OK"] * 7 + ["REVISION_NOT_FOUND"] * 2
    assert status(made.filter("revision_no <> 4"))[3:7] == ["REVISION_NOT_FOUND", "CHAIN_INVALID", "CHAIN_INVALID", "OK"]
    assert status(made.filter("revision_no > 1"))[:3] == ["REVISION_NOT_FOUND", "CHAIN_INVALID", "CHAIN_INVALID"]
    assert status(made, most=2)[:3] == ["OK", "OK", "CHAIN_LIMIT"]
    assert status(made.withColumn("set", F.map_from_arrays(F.array(F.lit("height")), F.array(F.lit("0")))))[1] == "HASH_MISMATCH"
    assert revisions.reconstruct(made.limit(0)).collect() == []


def test_profiles():
    with pytest.raises(ValueError):
        Profile((Rule("a"), Rule("a"))).check()
    with pytest.raises(ValueError):
        Profile((Rule('a"'),)).check()
