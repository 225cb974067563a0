"""Nearest neighbours and pairs of shapes where many rows lie at one place."""

import inspect

from pyspark.sql import functions as F

from cairnlake.operators import spatial


def points(spark, n):
    p = lambda c: [(f"{c}{i:03d}", 13.6 + i % 7 * 0.001, 45.6 + i // 7 % 3 * 0.001) for i in range(n)]
    return spark.createDataFrame(p("t"), "object_id string, lon double, lat double")


def test_nearest_of_many_at_one_place(spark):
    """Ties and the anchor itself, against all pairs; the pairs of places don't grow with copies."""
    t = points(spark, 150)
    for kind, k in (("sphere", 10), ("spheroid", 3)):
        pairs = {}
        for r in spatial.nearby_pairs(t, t, 250.0, kind).collect():
            pairs.setdefault(r.anchor_id, []).append((round(r.distance_m, 3), r.object_id))
        want = {(a, o, d, i) for a, x in pairs.items() for i, (d, o) in enumerate(sorted(x)[:k], 1)}
        for most in (None, 5):
            assert {tuple(r) for r in spatial.nearest_pairs(t, t, 250.0, k, kind, 3, most).collect()} == want
    made = [spatial._close(p.select(F.col("lon").alias("alon"), F.col("lat").alias("alat")).distinct(), p.select(F.col("lon").alias("tlon"), F.col("lat").alias("tlat")).distinct(), 250.0, 100).count() for p in (t, points(spark, 600))]
    assert made[0] == made[1] < 21 * 21 and "_close(places" in inspect.getsource(spatial.nearest_pairs)


def squares(spark, n, size, c):
    text = '{{"type":"Polygon","coordinates":[[[{0},{1}],[{2},{1}],[{2},{3}],[{0},{3}],[{0},{1}]]]}}'
    at = lambda i: (i % 5 * 0.001, i // 5 % 2 * 0.001)
    rows = [(f"{c}{i:03d}", text.format(x, y, round(x + size, 6), round(y + size, 6))) for i in range(n) for x, y in [at(i)]]
    return spatial.with_bounds(spark.createDataFrame([*rows, (f"{c}none", "no")], "object_id string, geojson string"))


def test_pairs_of_many_at_one_place(spark):
    """Copies are told apart only in the result; tasks follow the number of pairs."""
    a, b = squares(spark, 30, 0.0015, "s"), squares(spark, 70, 0.0025, "t")
    both = spatial.box_pairs(a, b)
    want = sorted((r.l_object_id, r.r_object_id) for r in both.filter(spatial._intersects()).collect())
    assert sorted(map(tuple, spatial.intersection_pairs(a, b).collect())) == want and len(want) > 30 * 7
    shares = sorted((r[0], r[1], round(r[2], 6)) for r in both.select("l_object_id", "r_object_id", spatial._overlaps().alias("x")).filter("x >= 0.3").collect())
    assert sorted((r[0], r[1], round(r[2], 6)) for r in spatial.overlap_pairs(a, b, 0.3).collect()) == shares
    (p, m), (q, o) = spatial._shapes(a), spatial._shapes(b)
    assert (p.count(), q.count()) == (10, 10)
    split = spatial._member_pairs(spatial.box_pairs(p, q).filter(spatial._intersects()).select("l_object_id", "r_object_id", "l_n", "r_n"), m, o, most=4)
    assert sorted(map(tuple, split.collect())) == want
    assert not [r for r in spatial.intersection_pairs(a, a).collect() if r[0] == r[1]]
    counts = {r.anchor_id: r.candidates for r in spatial.spatial_relate(a, b, "INTERSECTS").collect()}
    assert counts == {f"s{i:03d}": sum(x == f"s{i:03d}" for x, _ in want) for i in range(30)} | {"snone": 0}
    got = {r.anchor_id: (r.outcome, r.candidates) for r in spatial.spatial_relate(a, a, "WITHIN", same=["object_id"]).collect()}
    assert got == {f"s{i:03d}": ("SELF_LOOP_NOT_ALLOWED", 1) for i in range(30)} | {"snone": ("SPATIAL_NO_MATCH", 0)}
    gap = {r.outcome for r in spatial.spatial_relate(a.filter("object_id = 's000'"), b.filter("object_id IN ('t000', 't010')"), "NEAREST", max_distance=500.0, margin=1.0).collect()}
    assert gap == {"SPATIAL_MULTIPLE_MATCHES"}
