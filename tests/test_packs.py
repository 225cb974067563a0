"""Packs written and read by ranges; shadow copies put in place and taken back."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import lake
from cairnlake.sources import packs

sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def made(spark):
    data = {f"e{i:03d}": bytes([i % 256]) * (i * 37 % 900) for i in range(200)} | {"huge": b"h" * 9000, "alone": b"a"}
    rows = [(k, "t" if k != "alone" else "u", "RAW", "STANDARD", "OPEN", sha(v), len(v), "VERIFIED") for k, v in data.items()]
    catalogue = spark.createDataFrame(rows, "lake_id string, tenant_id string, tier string, retention_class string, label string, content_hash string, size_bytes long, status string")
    return data, catalogue, lake.compaction_plan(catalogue, most_inputs=20, most_bytes=5000)


def contents(spark, data):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "lake_id string, content binary")


def test_packs(spark, made, tmp_path):
    data, catalogue, plan = made
    out = packs.compact(catalogue, plan, contents(spark, data), f"file://{tmp_path}/a").collect()
    assert {r.lake_id for r in out} == set(data) - {"huge", "alone"} and {r.outcome for r in out} == {"COMPACTED"}
    for r in out:
        assert (tmp_path / "a" / r.pack).read_bytes()[r.logical_offset : r.logical_offset + r.size_bytes] == data[r.lake_id]
    manifest = spark.read.parquet(f"{tmp_path}/a/manifest").collect()
    assert all(sha((tmp_path / "a" / m.pack).read_bytes()) == m.pack_hash and m.bytes <= 5000 and m.entries <= 20 for m in manifest)
    again = packs.write_packs(plan, contents(spark, data), f"file://{tmp_path}/b").collect()
    assert sorted(again) == sorted(manifest)


def test_damaged(spark, made, tmp_path):
    """One content differs and one is absent: their packs are left out whole."""
    data, catalogue, plan = made
    bad = {k: v for k, v in data.items() if k != "e150"} | {"e020": b"?" * len(data["e020"])}
    out = {r.lake_id: r.outcome for r in packs.compact(catalogue, plan, contents(spark, bad), f"file://{tmp_path}/a").collect()}
    bins = {r.lake_id: r.bin_id for r in plan.collect()}
    hurt = {bins["e020"], bins["e150"]}
    assert out["e020"] == out["e150"] == "VERIFY_FAILED" and {k for k, v in out.items() if v != "COMPACTED"} == {k for k in out if bins[k] in hurt}


def test_ranges(spark, tmp_path):
    (tmp_path / "p.bin").write_bytes(bytes(range(100)))
    rows = spark.createDataFrame([("a", "p.bin", 3, 4), ("b", "p.bin", 98, 3), ("c", "none", 0, 1), ("d", None, 0, 1), ("e", "p.bin", 100, 0)], "lake_id string, pack string, logical_offset long, size_bytes long")
    got = {r.lake_id: r.content and bytes(r.content) for r in packs.read_packed(rows, f"file://{tmp_path}", most_open=1).collect()}
    assert got == {"a": bytes([3, 4, 5, 6]), "b": None, "c": None, "d": None, "e": b""} or got == {"a": bytes([3, 4, 5, 6]), "b": None, "c": None, "d": None, "e": bytearray()}


def test_shadow(spark):
    current = spark.createDataFrame([(i, f"old{i}", None, f"h{i}", "VERIFIED", 1) for i in range(6)], "lake_id int, locator string, previous_locator string, content_hash string, state string, version int")
    plan = current.filter("lake_id < 4").select("lake_id", "locator", "content_hash")
    copied = plan.select("lake_id", F.concat(F.lit("shadow"), "lake_id").alias("shadow_locator"), "content_hash")
    state, after = packs.cutover(plan, copied, current)
    assert state == "CUTOVER" and {tuple(r) for r in after.collect()} == {(i, f"shadow{i}", f"old{i}", f"h{i}", "VERIFIED", 2) if i < 4 else (i, f"old{i}", None, f"h{i}", "VERIFIED", 1) for i in range(6)}
    state, back = packs.rollback(plan, copied, after)
    assert state == "ROLLED_BACK" and {tuple(r)[:3] for r in back.collect()} == {(i, f"old{i}", f"shadow{i}" if i < 4 else None) for i in range(6)}
    assert packs.rollback(plan, copied, current)[0] == packs.rollback(plan, copied, back)[0] == "ROLLBACK_GATE_FAILED"
    moved = current.withColumn("locator", F.when(F.col("lake_id") == 2, "new").otherwise(F.col("locator")))
    gone = current.withColumn("state", F.when(F.col("lake_id") == 1, "DELETED").otherwise(F.col("state")))
    assert packs.cutover(plan, copied, moved)[0] == packs.cutover(plan, copied, gone)[0] == packs.cutover(plan, copied.filter("lake_id > 0"), current)[0] == packs.cutover(plan.limit(0), copied, current)[0] == "REFERENCE_GATE_FAILED"
