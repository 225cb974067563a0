"""Published and hand-made vectors for the operators that SQL checks can't reach."""

import json
import math
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import geometry as G
from cairnlake.functions.hashing import canonical_json, decode_cursor, encode_cursor, match_key, uuid3
from cairnlake.functions.text import decimal_text, nfc_trim, similarity, text_v1
from cairnlake.operators import access, admission, canonical, identity, intake, lake, relate, spatial
from cairnlake.sources.lake_scan import load_catalogue, scan_objects
from cairnlake.sources.state import Versions
from cairnlake.streaming.intake import ENVELOPE, guard_stream, intake_stream, release_parked, take_batch


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_hashing(spark):
    class Name:
        bytes = b""

    want = str(uuid.uuid3(Name, "a|r|b"))
    assert one(spark, uuid3(F.lit("a"), F.lit("r"), F.lit("b"))) == want
    assert one(spark, canonical_json(F.lit('{"b":1,"a":{"d":2,"c":3}}'))) == one(spark, canonical_json(F.lit('{"a":{"c":3,"d":2},"b":1}')))
    assert one(spark, canonical_json(F.lit("{"))) is None
    assert decode_cursor(one(spark, encode_cursor(F.lit("a?>ü" * 30)))) == "a?>ü" * 30
    assert one(spark, match_key(F.lit("\t Ab "))) == "ab" and one(spark, match_key(F.lit(" \t"))) is None


def test_text(spark):
    assert one(spark, text_v1(F.lit("  Ａ  b\tC "))) == "a b c"
    assert one(spark, nfc_trim(F.lit(" café "))) == "café"
    assert [one(spark, decimal_text(F.lit(x))) for x in ("1.50", "100", "1e3", "-0.0", "x", "NaN")] == ["1.5", "100", "1000", "0", None, None]
    assert one(spark, similarity(F.lit("abcd"), F.lit("abcf"))) == 0.75


def decide(spark, incoming, candidates, policy):
    i = spark.createDataFrame(incoming, "handoff_id string, district string, name string, address string, geometry double")
    c = spark.createDataFrame(candidates, "object_id string, district string, name string, address string, geometry double")
    return identity.weighted_decisions(i, identity.weighted_scores(i, c, policy), policy).first()


POLICY = identity.WeightedPolicy((identity.Signal("name", "TEXT", 0.4), identity.Signal("address", "TEXT", 0.3), identity.Signal("geometry", "DISTANCE", 0.3, 20.0)), ("district",), 0.85, 0.5, 0.1, 10)


def test_weighted(spark):
    me = [("h", "d", "Main School", "Road 1", None)]
    same, other = ("a", "d", "Main School", "Road 1", 0.0), ("b", "d", "Old Mill", "Lane 9", 30.0)
    for pair in ([same, other], [other, same]):
        got = decide(spark, me, pair, POLICY)
        assert (got.outcome, got.target) == ("MATCH", "a")
    assert decide(spark, me, [same, ("b", *same[1:])], POLICY).outcome == "REVIEW_REQUIRED"
    got = decide(spark, [("h", "d", "Main School", None, None)], [("a", "d", "Main School", None, None)], POLICY)
    assert (got.outcome, got.reason, got.best) == ("REVIEW_REQUIRED", "IDENTITY_EVIDENCE_INCOMPLETE", 0.4)
    assert decide(spark, [("h", None, "x", "y", None)], [same], POLICY).reason == "BLOCKING_EVIDENCE_MISSING"
    assert decide(spark, me, [], POLICY).reason == "NO_CANDIDATES"
    assert decide(spark, me, [(f"o{i}", *same[1:]) for i in range(11)], POLICY).reason == "RESOLUTION_TOO_BROAD"


@pytest.mark.parametrize(("value", "want"), [("101.49", "MATCH"), ("101.5", "MATCH"), ("101.51", "REVIEW_REQUIRED"), ("105", "REVIEW_REQUIRED"), ("105.01", "NEW_OBJECT"), ("NaN", "REVIEW_REQUIRED"), ("x", "REVIEW_REQUIRED")])
def test_number_thresholds(spark, value, want):
    policy = identity.WeightedPolicy((identity.Signal("size", "NUMBER", 1.0, 10.0),), ("district",), 0.85, 0.5, 0.1, 10)
    i = spark.createDataFrame([("h", "d", "100")], "handoff_id string, district string, size string")
    c = spark.createDataFrame([("a", "d", value)], "object_id string, district string, size string")
    assert identity.weighted_decisions(i, identity.weighted_scores(i, c, policy).withColumn("score", F.round("score", 9)), policy).first().outcome == want


def test_policies_are_checked():
    s = identity.Signal("a", "EXACT", 0.5)
    with pytest.raises(ValueError):
        identity.WeightedPolicy((s,), ("b",), 0.9, 0.5, 0.1, 5)
    with pytest.raises(ValueError):
        identity.GovernedPolicy((("a", "CONCEPT"),), (("b",),))
    for bad in (["a*"], [""], ["x" * 257], []):
        with pytest.raises(ValueError):
            access.checked_iris(bad, 5)


LINKED = "object_id string, property string, source_id string, record_id string, revision long, authority_rank int, value string, valid_from timestamp, valid_to timestamp, deleted boolean"


def linked(spark, rows, **how):
    df = spark.createDataFrame([("o", "p", *r) for r in rows], LINKED)
    got = canonical.reconcile_linked(df, F.expr("TIMESTAMP '2024-06-01 00:00:00'"), **how).first()
    return got.status, got.value


def test_linked(spark):
    past, future = datetime(2024, 1, 1), datetime(2025, 1, 1)
    assert linked(spark, [("s", "r", 1, 0, " ", None, None, False)]) == ("NO_VALID_CONTRIBUTION", None)
    assert linked(spark, [("s", "r1", 1, 0, "A", None, None, False), ("s", "r2", 1, 0, " A ", None, None, False)])[0] == "CONFLICT"
    assert linked(spark, [("s", "r1", 1, 0, " café ", None, None, False), ("s", "r2", 1, 0, "café", None, None, False)], normaliser="NFC_TRIM") == ("RECONCILED", "café")
    # an expired newest revision doesn't bring back an older one; a future one doesn't hide it
    assert linked(spark, [("s", "r", 1, 0, "old", None, None, False), ("s", "r", 2, 0, "new", None, past, False)])[0] == "NO_VALID_CONTRIBUTION"
    assert linked(spark, [("s", "r", 1, 0, "old", None, None, False), ("s", "r", 2, 0, "new", future, None, False)]) == ("RECONCILED", "old")
    assert linked(spark, [("s", "r", 1, 0, "top", None, past, False), ("t", "r", 1, 1, "next", None, None, False)]) == ("RECONCILED", "next")
    assert linked(spark, [("s", "r", 1, 0, None, None, None, True)])[0] == "DELETED"
    assert linked(spark, [("s", "r", 1, 0, None, None, None, True), ("s", "q", 1, 0, "x", None, None, False)])[0] == "CONFLICT"
    status, value = linked(spark, [("s", "r", 1, 0, " A ", None, None, False), ("t", "r", 1, 1, "B", None, None, False), ("u", "r", 1, 2, "A", None, None, False)], multi=True, normaliser="NFC_TRIM")
    assert status == "RECONCILED" and sorted(value.split("|")) == ["A", "B"]


def test_revisions(spark):
    rows = [("o", "name", 1, "Road"), ("o", "surface", 1, "10"), ("o", "surface", 2, "11")]
    changes = spark.createDataFrame(rows, "object_id string, property string, seq long, value string")
    chain = canonical.revision_chain(changes, 4).orderBy("revision_no").collect()
    assert [(r.revision_no, r.is_checkpoint, r.delta) for r in chain] == [(1, True, "name=Road|surface=10"), (2, False, "surface=11")]
    state = canonical.reconstruct(changes, canonical.revision_chain(changes), 2).collect()
    assert {r.property: r.value for r in state} == {"name": "Road", "surface": "11"}


def test_members(spark):
    rows = [([[("OPEN",), ("RESTRICTED",)]],), ([[("OPEN",)]],), ([],)]
    df = spark.createDataFrame([([{"contributions": [{"label": c[0], "valid_from": None, "valid_to": None} for c in m]} for m in r[0]],) for r in rows], "members array<struct<contributions: array<struct<label: string, valid_from: timestamp, valid_to: timestamp>>>>")
    assert [r.x for r in df.select(access.member_access(["OPEN"]).alias("x")).collect()] == [False, True, True]
    assert [r.x for r in df.select(access.member_access([]).alias("x")).collect()] == [False, False, True]
    assert [r.x for r in df.select(access.member_valid_at(F.current_timestamp()).alias("x")).collect()] == [True, True, False]


def test_retry_guard_ignores_order(spark):
    rel = lambda *r: F.array(*[F.lit(x) for x in r])
    prints = {one(spark, admission.fingerprint(F.lit("c"), F.lit("p"), F.lit("s"), r)) for r in (rel("b", "a"), rel("a", "b", "a"), rel("a", " b"))}
    assert len(prints) == 1


def test_budget(spark):
    log = spark.createDataFrame([("k", datetime(2024, 1, 1, 0, 0, i), i, 1200.0) for i in range(3)], "key string, at timestamp, request_id long, nodes double")
    got = admission.admit(log, {"nodes": "nodes"}, {"nodes": 2000}).first()
    assert (got.accepted, got.rejected, got.sum_nodes) == (1, 2, 1200.0)


def test_geodesic():
    # Vincenty's own line, Flinders Peak to Buninyong, on GRS80, which differs from WGS84 below a millimetre here
    d = G.geodesic(144.42486789, -37.95103342, 143.92649553, -37.65282114)
    assert abs(d - 54972.271) < 0.01
    assert G.geodesic(0, 0, 0, 0) == 0
    assert abs(G.geodesic(0, 0, 179.9, 0.1) - 20_003_931) < 30_000  # nearly opposite


def test_projection():
    x, y = G.run_pipeline(G.parse_pipeline("+proj=pipeline +step +proj=utm +zone=33"), 15.0, 45.0)
    assert abs(x - 500_000) < 1e-6 and abs(y - 4_982_950.4) < 1
    lon, lat = G.tmerc_inverse(*G.tmerc(13.77, 45.65, 15.0), 15.0)
    assert math.isclose(lon, 13.77, abs_tol=1e-9) and math.isclose(lat, 45.65, abs_tol=1e-9)
    for bad in ("+proj=geos", "proj=utm", "+proj=utm;rm", "+proj=hgridshift +grids=x.gsb"):
        with pytest.raises(ValueError):
            G.parse_pipeline(bad)
    with pytest.raises(LookupError):
        G.run_pipeline(G.parse_pipeline("+proj=hgridshift +grids=x.gsb", ["x.gsb"]), 1, 1)


def square(x, y, s):
    return {"type": "Polygon", "coordinates": [[[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]]}


def test_polygons():
    polys = lambda g: G.rings(*G.from_wkb(G.to_wkb(*G.from_geojson(json.dumps(g)))))
    a, b, far = polys(square(0, 0, 2)), polys(square(1, 1, 2)), polys(square(9, 9, 1))
    assert G.overlap(a, b) == pytest.approx(1) and G.area(a) == 4 and G.overlap(a, far) == 0
    assert G.intersects(a, b) and G.intersects(a, polys(square(2, 2, 1))) and not G.intersects(a, far)
    hole = polys({"type": "Polygon", "coordinates": [*square(0, 0, 4)["coordinates"], square(1, 1, 2)["coordinates"][0]]})
    assert G.area(hole) == 12 and G.overlap(hole, b) == pytest.approx(0) and G.locate((2, 2), hole[0]) == -1 and G.locate((1, 2), hole[0]) == 0
    bent = polys({"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [2, 1], [0, 4], [0, 0]]]})
    assert G.overlap(bent, bent) == pytest.approx(G.area(bent))
    for bad, why in (({"type": "Point", "coordinates": [1, 2, 3]}, "DIMENSION"), ({"type": "Polygon", "coordinates": [[[0, 0], [1, 1]]]}, "INVALID"), ({"type": "Point", "coordinates": []}, "DIMENSION"), ({}, "EMPTY")):
        with pytest.raises(ValueError, match=why):
            G.from_geojson(json.dumps(bad))


def test_nearby_equals_brute_force(spark):
    spots = [(f"p{i}", lon, lat) for i, (lon, lat) in enumerate([(179.999, 10.0), (-179.999, 10.001), (0.0, 84.9), (0.2, 84.9), (13.7, 45.6), (13.71, 45.6), (13.7, 45.64), (20.0, 0.0), (20.01, -0.01), (50.0, 88.0), (-130.0, 88.1), (13.7, 45.6)])]
    df = spark.createDataFrame(spots, "object_id string, lon double, lat double")
    pairs = df.alias("a").crossJoin(df.alias("b")).filter("a.object_id <> b.object_id").select(F.col("a.object_id").alias("anchor_id"), F.col("b.object_id").alias("object_id"), spatial.haversine(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")).alias("d"))
    for radius in (500.0, 4000.0, 50_000.0):
        want = {(r.anchor_id, r.object_id) for r in pairs.filter(F.col("d") <= radius).collect()}
        assert {(r.anchor_id, r.object_id) for r in spatial.nearby_pairs(df, df, radius).collect()} == want
    with pytest.raises(ValueError):
        spatial.nearby_pairs(df, df, 50_001.0)
    with pytest.raises(ValueError):
        spatial.envelope_points(df, 0, 0, 10, 10)


def test_references(spark):
    refs = spark.createDataFrame([("s", "t", "r", "N", "UNKNOWN")], "source_id string, tenant_id string, relation string, target_type string, needle string")
    targets = spark.createDataFrame([("x", "t", "N", "ACTIVE", "known")], "object_id string, tenant_id string, canonical_type string, status string, match_key string")
    got = relate.resolve_references(refs, targets).first()
    assert (got.outcome, got.relationship_id) == ("NO_MATCH", None)
    assert relate.resolve_references(refs, targets, quarantine=False).first().outcome == "SKIPPED"


def envelope(i, **change):
    row = dict.fromkeys([c.split()[0] for c in ENVELOPE.split(", ")]) | {"handoff_id": i, "ingestion_run_id": "r", "ingestion_id": "i", "source_id": "s", "type_code": "t", "source_object_id": "o", "lineage_id": "l", "content_hash": "h", "operation": "UPSERT", "mode": "FULL_SNAPSHOT", "acquired_at": "2024-01-01T00:00:00Z", "canonical_payload": '{"a":1}'}
    return row | change


def test_intake_stream(spark, tmp_path):
    put = lambda n, rows: (tmp_path / "in").mkdir(exist_ok=True) or (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
    go = lambda: intake_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/state", f"file://{tmp_path}/cp").awaitTermination(120)
    put("1", [envelope("a"), envelope("b"), envelope("bad", operation="MERGE")])
    assert go()
    put("2", [envelope("a"), envelope("b", content_hash="other"), envelope("c")])
    assert go()
    state = Versions(spark, f"file://{tmp_path}/state")
    assert {r.handoff_id: r.decision for r in state.read("receipts").collect()} == {"a": "DUPLICATE", "b": "CONFLICT", "c": "NEW"}
    assert sorted(r.handoff_id for r in state.read("accepted").collect()) == ["a", "b", "c"]
    before = state.current("accepted")
    take_batch(state, spark.createDataFrame([envelope("c")], ENVELOPE), before)  # a retry of the last version
    assert state.current("accepted") == before
    assert [r.x for r in spark.range(1).select(F.array_join(intake.unknown_keys(F.lit('{"a":1,"z":2}'), ["a"]), ",").alias("x")).collect()] == ["z"]


def test_sources(spark, tmp_path):
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "x.bin").write_bytes(b"abc")
    row = scan_objects(spark, str(tmp_path / "o")).first()
    assert (row.size_bytes, row.content_hash) == (3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")
    good = {"kind": "k", "ref": "r", "version": "1", "hash": "0" * 64, "status": "ACTIVE"}
    (tmp_path / "c.json").write_text("\n".join(json.dumps(x) for x in (good, good | {"ref": "q"}, good | {"ref": "q"}, good | {"ref": "z", "hash": "x"})))
    ok, bad = load_catalogue(spark, str(tmp_path / "c.json"))
    assert ([r.ref for r in ok.collect()], sorted(r.ref for r in bad.collect())) == (["r"], ["q", "q", "z"])


def test_redirects_of_any_length(spark):
    merges = lambda pairs: spark.createDataFrame(pairs, "merged_id long, survivor_id long")
    chain = [(i, i - 1) for i in range(1, 301)] + [(1000, 1001), (1002, None)]
    got = {r.merged_id: (r.final_id, r.hops) for r in relate.resolve_redirects(merges(chain)).collect()}
    assert got == {i: (0, i) for i in range(1, 301)} | {1000: (1001, 1), 1002: (None, 1)}
    assert relate.resolve_redirects(merges([])).collect() == []
    for loop in ([(1, 2), (2, 1)], [(7, 7)], [(1, 2), (2, 3), (3, 4), (4, 2), (9, 8)]):
        with pytest.raises(ValueError, match="cycle"):
            relate.resolve_redirects(merges(loop))


def test_weighted_overlap_and_sizes(spark):
    policy = identity.WeightedPolicy((identity.Signal("name", "TEXT", 0.6), identity.Signal("share", "OVERLAP", 0.4)), ("district",), 0.9, 0.5, 0.1, 3)
    i = spark.createDataFrame([("h", "d", "Old Mill", None), ("w", "wide", "x", None), ("n", "none", "x", None), ("b", " ", "x", None)], "handoff_id string, district string, name string, share double")
    c = spark.createDataFrame([("a", "d", "old  mill", 1.0), ("b", "d", "old mill", 0.2)] + [(f"o{k}", "wide", "x", 1.0) for k in range(4)], "object_id string, district string, name string, share double")
    scores = identity.weighted_scores(i, c, policy)
    assert sorted((r.handoff_id, r.candidate_id or "", r.candidates) for r in scores.collect()) == [("h", "a", 2), ("h", "b", 2), ("w", "", 4)]
    got = {r.handoff_id: (r.reason, r.target, r.candidates) for r in identity.weighted_decisions(i, scores, policy).collect()}
    assert got == {"h": ("HIGH_CONFIDENCE", "a", 2), "w": ("RESOLUTION_TOO_BROAD", None, 4), "n": ("NO_CANDIDATES", None, 0), "b": ("BLOCKING_EVIDENCE_MISSING", None, 0)}


def test_compaction(spark):
    mib = 1 << 20
    sizes = [40, 10, 30, 70, 20, 64, 5]
    rows = [(f"l{k}", "t", "RAW", "STANDARD", "OPEN", "VERIFIED", s * mib) for k, s in enumerate(sizes)] + [("x", "t", "RAW", "STANDARD", "OPEN", "COLD", 1)]
    df = spark.createDataFrame(rows, "lake_id string, tenant_id string, tier string, retention_class string, label string, status string, size_bytes long")
    got = {r.lake_id: r for r in lake.compaction_plan(df).collect()}
    assert {k: r.reason for k, r in got.items() if r.reason} == {"l3": "TOO_LARGE", "l5": "SINGLE_INPUT", "l6": "SINGLE_INPUT"}
    assert got["l0"].bin_id == got["l1"].bin_id != got["l2"].bin_id == got["l4"].bin_id and got["l1"].logical_offset == 40 * mib
    assert lake.compaction_plan(df.limit(0)).collect() == []
    many = lake.compaction_plan(df, packed=2).collect()
    assert len(many) == len(sizes)


def test_lifecycle(spark):
    schema = "lake_id string, status string, content_hash string, version int, note string"
    before = [("a", "STAGED", "h", 1, ""), ("b", "COLD", "h", 1, ""), ("c", "STAGED", "h", 1, ""), ("d", "VERIFIED", "h", 1, ""), ("e", "VERIFIED", "h", 1, ""), ("f", "VERIFIED", "h", 1, "")]
    after = [("a", "FAILED", "h", 2, ""), ("b", "QUARANTINED", "h", 2, ""), ("c", "QUARANTINED", "h", 2, ""), ("d", "VERIFIED", "h", 1, ""), ("e", "VERIFIED", "h", 1, "changed"), ("f", "VERIFIED", "x", 2, "")]
    got = {(r.lake_id, r.problem) for r in lake.transition_problems(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)).collect()}
    assert got == {("c", "STATUS"), ("e", "VERSION"), ("f", "IDENTITY")}


def test_preview(spark):
    schema = "object_id string, property string, source_id string, record_id string, revision int, authority_rank int, value string, valid_from timestamp, valid_to timestamp, deleted boolean"
    kept = spark.createDataFrame([("o", "name", "s", "1", 1, 0, "old", None, None, False), ("p", "name", "s", "1", 1, 0, "same", None, None, False), ("q", "name", "s", "1", 1, 0, "one", None, None, False)], schema)
    asked = [("h1", "o", "name", "s", "1", 2, 0, "new", None, None, False), ("h2", "p", "name", "t", "1", 1, 0, " same ", None, None, False), ("h3", "q", "name", "t", "1", 1, 0, "two", None, None, False), ("h4", "r", "name", "s", "1", 1, 0, "first", None, None, False), ("h5", "o", "name", "s", "1", 3, 0, None, None, None, True)]
    incoming = spark.createDataFrame(asked, "handoff_id string, " + schema)
    current = spark.createDataFrame([("o", "name", "old"), ("p", "name", "same"), ("q", "name", "one")], "object_id string, property string, value string")
    rows = canonical.preview_linked(incoming, kept, current, F.expr("TIMESTAMP '2024-01-01 00:00:00'"), normaliser="NFC_TRIM").collect()
    assert {(r.handoff_id, r.proposed_value, r.status, r.change) for r in rows} == {("h1", "new", "RECONCILED", "CHANGED"), ("h2", "same", "RECONCILED", "UNCHANGED"), ("h3", "one", "CONFLICT", "UNCHANGED"), ("h4", "first", "RECONCILED", "ADDED"), ("h5", None, "DELETED", "REMOVED")}


def test_geometry_kernels():
    square = lambda x, y, s: ("Polygon", [[[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]])
    a, b = square(13.0, 45.0, 0.01), square(13.002, 45.002, 0.004)
    assert G.within(b, a) and not G.within(a, b) and G.within(a, a)
    assert G.within(("Point", [13.005, 45.005]), a) and not G.within(("Point", [13.0, 45.0]), a)
    assert G.distance_m(a, b) == 0 and G.distance_m(("Point", [13.001, 45.001]), a) == 0
    far = G.distance_m(a, square(13.02, 45.0, 0.01))
    assert abs(far - G.geodesic(13.01, 45.0, 13.02, 45.0)) < 0.01 * far
    assert abs(G.distance_m(("Point", [13.02, 45.005]), a) - far) < 0.01 * far
    assert abs(G.area_m2(a) / 16 * 2.56 - G.area_m2(b)) < 0.01 * G.area_m2(a)
    with pytest.raises(ValueError, match="MAX_DISTANCE"):
        spatial.spatial_candidates(None, None, "NEAREST")


def test_nearest_and_distances(spark):
    point = lambda i, x, y: (i, '{"type":"Point","coordinates":[%s,%s]}' % (x, y))  # noqa: E731, UP031
    frame = lambda rows: spatial.with_bounds(spark.createDataFrame(rows, "object_id string, geojson string"))
    s, t = frame([point("a", 13.0, 45.0), point("b", 14.0, 45.0)]), frame([point("x", 13.001, 45.0), point("y", 13.003, 45.0), point("a", 13.0, 45.0)])
    got = lambda **more: {r.anchor_id: (r.outcome, r.object_id, r.candidates) for r in spatial.spatial_relate(s, t, "NEAREST", max_distance=500.0, **more).collect()}
    assert got(margin=50.0) == {"a": ("SELF_LOOP_NOT_ALLOWED", None, 3), "b": ("SPATIAL_NO_MATCH", None, 0)}
    assert got(margin=50.0, self_loops=True)["a"] == ("MATCHED", "a", 3) and got(margin=100.0)["a"][0] == "SPATIAL_MULTIPLE_MATCHES" and got()["a"][0] == "SPATIAL_MULTIPLE_MATCHES"


def test_guard_stream(spark, tmp_path):
    """The stream, in two runs of one file each, gives what the batch gives for all rows."""
    rows = [("k", "2024-01-01 00:00:00", 1), ("k", "2024-01-01 00:05:00", 2), ("l", "2024-01-01 00:06:00", 3), ("k", "2024-01-01 00:10:00", 4), ("k", "2024-01-01 00:11:00", 5), ("k", "2024-01-01 02:00:00", 6), ("l", "2024-01-01 02:01:00", 7), ("l", "2024-01-01 02:02:00", 8)]
    whole = spark.createDataFrame(rows, "key string, t string, request_id long").select("key", F.to_timestamp("t").alias("at"), "request_id")
    want = {tuple(r) for r in admission.retry_guard(whole, 3, 900).select("key", "request_id", "session", "attempt", "state").collect()}
    for i, part in enumerate((whole.filter("request_id <= 3"), whole.filter("request_id > 3"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = guard_stream(spark.readStream.schema(whole.schema).parquet(f"{tmp_path}/in"))
        assert stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        assert i or spark.read.parquet(f"{tmp_path}/out").count() == 3
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("key", "request_id", "session", "attempt", "state").collect()}
    assert got == want


def test_parked(spark, tmp_path):
    state, at = Versions(spark, f"file://{tmp_path}/s"), lambda d: datetime(2024, 1, d)
    batch = lambda rows: spark.createDataFrame(rows, "handoff_id string, valid_from timestamp")
    release_parked(state, batch([("a", None), ("b", at(5)), ("c", at(9))]), at(1), 1)
    assert {r.handoff_id for r in state.read("released").collect()} == {"a"}
    for _ in range(2):  # the second is a retry
        release_parked(state, batch([("d", at(20))]), at(6), 2)
        assert {r.handoff_id for r in state.read("released").collect()} == {"b"} and {r.handoff_id for r in state.read("parked").collect()} == {"c", "d"}
