"""Relationships by supports, batch by batch; keyed tables by upserts."""

import datetime

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import reconcile
from cairnlake.sources.upsert import Upserts

REFS = "array<struct<relation: string, target_type: string, needle: string, label: string>>"
SCHEMA = f"handoff_id long, binding string, source_id string, tenant_id string, observed_at timestamp_ntz, received_at timestamp_ntz, references {REFS}"
DAY = datetime.datetime(2024, 1, 1)


def seen(spark, rows):
    """(id, binding, observed day, needles[, label])"""
    made = [(i, b, f"s:{b[0]}", "t", DAY + datetime.timedelta(d), DAY + datetime.timedelta(hours=i), [("r", "N", x, m[0] if m else "OPEN") for x in needles]) for i, b, d, needles, *m in rows]
    return spark.createDataFrame(made, SCHEMA)


def targets(spark, **keys):
    return spark.createDataFrame([(o, "t", "N", "ACTIVE", k) for o, k in keys.items()] or [("-", "t", "N", "MERGED", "-")], "object_id string, tenant_id string, canonical_type string, status string, match_key string")


def edges(t):
    return sorted((r.source_id, r.target_id, r.status, r.label if r.status == "ACTIVE" else None) for r in t.edges.collect())


def issues(t):
    return sorted((r.binding, r.needle, r.reason, r.state) for r in t.issues.collect())


def test_supports(spark):
    known = targets(spark, n1="a", n2="b", n3="c", n4="c")
    one, out = reconcile.step(reconcile.Tables.empty(spark), seen(spark, [(1, "x1", 5, ["a", "b", " A "]), (2, "x2", 1, ["a"], "RESTRICTED"), (3, "y", 1, ["c", "zz"])]), known)
    assert edges(one) == [("s:x", "n1", "ACTIVE", "RESTRICTED"), ("s:x", "n2", "ACTIVE", "OPEN")]
    assert issues(one) == [("y", "c", "MULTIPLE_MATCHES", "OPEN"), ("y", "zz", "NO_MATCH", "OPEN")]
    # a late one says nothing, a newer one retires what its binding supported
    two, out = reconcile.step(one, seen(spark, [(4, "x1", 2, ["zz"]), (5, "x2", 9, ["b"]), (6, "x1", 6, [])]), known)
    assert {r.handoff_id: (r.outcome, r.is_head) for r in out.collect()} == {4: ("LATE", False), 5: ("ACCEPTED", True), 6: ("ACCEPTED", True)}
    assert edges(two) == [("s:x", "n1", "SUPERSEDED", None), ("s:x", "n2", "ACTIVE", "OPEN")] and issues(two) == issues(one)
    # targets change: what waits for a decision stays, an unmatched one is solved
    after = targets(spark, n1="a", n2="b", n3="c", n5="zz")
    three, _ = reconcile.step(two, seen(spark, []), after, reconcile.changed_keys(known, after))
    assert edges(three) == [*edges(two), ("s:y", "n5", "ACTIVE", "OPEN")]
    assert issues(three) == [("y", "c", "MULTIPLE_MATCHES", "OPEN"), ("y", "zz", "NO_MATCH", "RESOLVED")]
    four, _ = reconcile.step(three, seen(spark, [(9, "y", 2, ["a"])]), targets(spark, n1="a"), reconcile.changed_keys(after, targets(spark, n1="a")))
    assert edges(four) == [("s:x", "n1", "SUPERSEDED", None), ("s:x", "n2", "SUPERSEDED", None), ("s:y", "n1", "ACTIVE", "OPEN"), ("s:y", "n5", "SUPERSEDED", None)]
    assert ("x2", "b", "NO_MATCH", "OPEN") in issues(four) and ("y", "c", "MULTIPLE_MATCHES", "SUPERSEDED") in issues(four)


def test_too_many_values(spark):
    t, out = reconcile.step(reconcile.Tables.empty(spark), seen(spark, [(1, "x", 1, [f"n{i}" for i in range(257)]), (2, "x", 0, ["a"])]), targets(spark, n1="a"))
    assert {r.handoff_id: r.outcome for r in out.collect()} == {1: "REFUSED", 2: "ACCEPTED"} and edges(t) == [("s:x", "n1", "ACTIVE", "OPEN")]


@pytest.mark.parametrize("cuts", [(30,), (7, 31, 52)])
def test_batches_equal_the_whole(spark, cuts):
    known = targets(spark, **{f"n{i}": f"k{i % 9}" for i in range(10)})
    rows = [(i, f"b{i * 5 % 11}", i * 13 % 17, [f"k{i % 10}", f"k{i * 3 % 10}"], ("OPEN", "SENSITIVE", "PERSONAL")[i % 3]) for i in range(60)]
    whole, _ = reconcile.step(reconcile.Tables.empty(spark), seen(spark, rows), known)
    t = reconcile.Tables.empty(spark)
    for a, b in zip((0, *cuts), (*cuts, 60), strict=True):
        t, _ = reconcile.step(t, seen(spark, rows[a:b]), known)
    assert edges(t) == edges(whole) and issues(t) == issues(whole)
    for name in ("heads", "references", "supports"):
        assert sorted(map(repr, getattr(t, name).collect())) == sorted(map(repr, getattr(whole, name).collect()))


def test_a_step_stores_references_once_and_no_derived_ids(spark, monkeypatch):
    written, keep = [], reconcile.stored
    monkeypatch.setattr(reconcile, "stored", lambda df, name: written.append((name, df.columns)) or keep(df, name))
    known = targets(spark, n1="a", n2="b")
    one, _ = reconcile.step(reconcile.Tables.empty(spark), seen(spark, [(1, "x", 1, ["a", "zz"])]), known)
    two, _ = reconcile.step(one, seen(spark, [(2, "x", 2, ["b"])]), known)
    assert edges(two) == [("s:x", "n1", "SUPERSEDED", None), ("s:x", "n2", "ACTIVE", "OPEN")] and issues(two) == [("x", "zz", "NO_MATCH", "SUPERSEDED")]
    assert not {c for _, columns in written for c in columns} & {"ref_id", "relationship_id"} and len(written) <= 2 * 5
    supported = two.supports.first()
    assert two.edges.filter("status = 'ACTIVE'").first().relationship_id == supported.relationship_id and supported.ref_id == two.references.first().ref_id


def test_label_of_an_edge(spark):
    """The strictest of its live supports, unknown ones being the weakest; a lost edge keeps its last."""
    known = targets(spark, n1="a", n2="b", n3="c")
    label = lambda t: {r.target_id: (r.status, r.label) for r in t.edges.collect()}
    one, _ = reconcile.step(reconcile.Tables.empty(spark), seen(spark, [(1, "x1", 1, ["a"], "ZEBRA"), (2, "x2", 1, ["a"], "OPEN"), (3, "x3", 1, ["b"], "SENSITIVE"), (4, "x4", 1, ["b"], "ZEBRA"), (5, "x5", 1, ["c"], "RESTRICTED"), (6, "x5", 2, ["b"], "ANONYMOUS")]), known)
    assert label(one) == {"n1": ("ACTIVE", "ZEBRA"), "n2": ("ACTIVE", "SENSITIVE"), "n3": ("SUPERSEDED", "RESTRICTED")}
    two, _ = reconcile.step(one, seen(spark, [(7, "x1", 3, []), (8, "x3", 3, ["c"], "PERSONAL"), (9, "x3", 4, []), (10, "x4", 3, []), (11, "x5", 3, [])]), known)
    assert label(two) == {"n1": ("ACTIVE", "OPEN"), "n2": ("SUPERSEDED", "SENSITIVE"), "n3": ("SUPERSEDED", "RESTRICTED")}



def test_upserts(spark, tmp_path):
    schema, kept = "k long, v string, at long", {}
    table = Upserts(spark, f"file://{tmp_path}/t", ["k"], 8)
    assert table.read(schema).collect() == []
    changes = [[(i, f"a{i}", 1, False) for i in range(40)], [(3, "b", 5, False), (3, "c", 4, False), (7, None, 9, True), (99, "n", 1, None)], [(3, "old", 2, False), (3, "gone", 2, True), (7, "back", 10, False)], [(i, None, 20, True) for i in range(100)]]
    for batch in changes:
        n = table.apply(spark.createDataFrame(batch, f"{schema}, deleted boolean"), "at")
        for k in {r[0] for r in batch}:
            _, v, at, gone = max((r for r in batch if r[0] == k), key=lambda r: r[2])
            if k not in kept or at >= kept[k][1]:
                kept.pop(k, None)
                if not gone:
                    kept[k] = (v, at)
        assert {r.k: (r.v, r.at) for r in table.read(schema).collect()} == kept and table.read(schema).count() == len(kept) and 0 < n <= 8
    assert kept == {} and table.apply(spark.createDataFrame([], f"{schema}, deleted boolean"), "at") == 0
    table.apply(spark.createDataFrame([(1, "x", 30, False)], f"{schema}, deleted boolean"), "at")
    (tmp_path / "t" / "_manifest" / "77").mkdir()  # a run that failed before it was done
    assert [tuple(r) for r in table.read(schema).collect()] == [(1, "x", 30)]


def test_upsert_of_few_touches_few(spark, tmp_path):
    table = Upserts(spark, f"file://{tmp_path}/t", ["k"], 16)
    table.apply(spark.range(500).selectExpr("id k", "'a' v", "1L at", "false deleted"), "at")
    before = table._versions()
    assert table.apply(spark.range(1).selectExpr("17L k", "'b' v", "2L at", "false deleted"), "at") == 1
    after = table._versions()
    assert sum(before[b] != after[b] for b in before) == 1 and table.read("k long, v string, at long").filter(F.col("v") == "b").count() == 1


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        Upserts(spark, f"file://{tmp_path}/t", ["k"], 1).apply(spark.range(500).selectExpr("id k", "'a' v", "1L at", "false deleted"), "at")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "t" / "v1" / "b=0").glob("*.parquet"))) > 1
