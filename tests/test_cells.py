"""Pairs of shapes of very different sizes against comparison of all with all."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import geometry as G
from cairnlake.operators import spatial


def polygon(rng, x, y, r, n):
    turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [[x + r * rng.uniform(0.4, 1) * math.cos(t), y + r * rng.uniform(0.4, 1) * math.sin(t)] for t in turn]
    return {"type": "Polygon", "coordinates": [[*ring, ring[0]]]}


def box(x, y, w, h):
    return {"type": "Polygon", "coordinates": [[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]}


@pytest.fixture(scope="module")
def shapes(spark):
    rng = random.Random(5)
    hole = {"type": "Polygon", "coordinates": [box(8, 40, 10, 10)["coordinates"][0], box(12, 44, 2, 2)["coordinates"][0]]}
    line = {"type": "LineString", "coordinates": [[9, 41], [10, 42]]}
    two = {"type": "MultiPolygon", "coordinates": [box(9, 41, 1, 1)["coordinates"], polygon(rng, 15, 47, 2, 9)["coordinates"]]}
    large = [box(-20, 30, 60, 40), hole, two, line, *(polygon(rng, 13, 45, r, 12) for r in (0.5, 3, 8)), {"type": "Point", "coordinates": [13.0, 45.0]}]
    spot = lambda: (rng.gauss(13, 2), rng.gauss(45, 2))
    small = [box(*spot(), rng.uniform(0.001, 0.4), rng.uniform(0.001, 0.4)) for _ in range(30)] + [polygon(rng, *spot(), rng.uniform(0.01, 0.3), 7) for _ in range(30)]
    small += [{"type": "Point", "coordinates": list(spot())} for _ in range(20)] + [box(9, 41, 0.5, 0.5), box(12.5, 44.5, 0.25, 0.25), line]
    made = lambda p, rows: spatial.with_bounds(spark.createDataFrame([(f"{p}{i}", json.dumps(g)) for i, g in enumerate(rows)] + [(f"{p}?", None)], "object_id string, geojson string"))
    return {"large": large, "small": small}, made("l", large), made("s", small)


def pairs(df):
    rows = [(r.anchor_id, r.object_id) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("predicate", ["INTERSECTS", "WITHIN", "CONTAINS", "OVERLAP_RATIO", "NEAREST"])
def test_same_as_all_with_all(shapes, predicate):
    given, large, small = shapes
    wkb = {p: {f"{p[0]}{i}": G.from_wkb(G.to_wkb(*G.from_geojson(json.dumps(g)))) for i, g in enumerate(rows)} for p, rows in given.items()}
    test = {"INTERSECTS": spatial._meets, "WITHIN": G.within, "CONTAINS": lambda a, b: G.within(b, a), "OVERLAP_RATIO": lambda a, b: spatial._share(a, b) >= 0.5, "NEAREST": lambda a, b: G.distance_m(a, b) <= 20_000}[predicate]
    a, b = ("large", "small") if predicate == "CONTAINS" else ("small", "large")
    want = {(i, j) for i, x in wkb[a].items() for j, y in wkb[b].items() if test(x, y)}
    frames = {"large": large, "small": small}
    got = pairs(spatial.spatial_candidates(frames[a], frames[b], predicate, max_distance=20_000.0, min_overlap=0.5))
    assert got == want and want


def test_kernels_only_on_borders(shapes):
    _, large, small = shapes
    rows = spatial.box_pairs(small, large).filter("NOT coalesce(l_is_box AND r_is_box, false)")
    known = F.coalesce(spatial._in_clear_cell("l", "r"), spatial._in_clear_cell("r", "l"))
    n, open_ = rows.count(), rows.filter(known.isNull()).count()
    assert open_ < n / 2


def test_cells_of_a_row_and_split_cells(spark):
    """A continent beside many small squares, all in one of its cells."""
    n = 900
    b = lambda x, y, w: [x.alias("min_x"), y.alias("min_y"), (x + w).alias("max_x"), (y + w).alias("max_y"), F.lit(True).alias("is_box"), F.lit(b"box").alias("wkb")]
    small = spark.range(n).select(F.concat(F.lit("s"), "id").alias("object_id"), *b(F.col("id") % 60 / 10.0, F.floor(F.col("id") / 60) / 10.0, 0.0625))
    large = spark.range(5).select(F.concat(F.lit("l"), "id").alias("object_id"), *b(F.lit(0.0), F.lit(0.0), F.pow(F.lit(10.0), F.col("id") - 2.0)))
    for most in (20_000, 7):
        rows = [(r.l_object_id, r.r_object_id) for r in spatial.box_pairs(small, large, most=most).collect()]
        got = set(rows)
        assert len(got) == len(rows)
        assert got == {(f"s{i}", f"l{j}") for i in range(n) for j in range(5) if max(i % 60 / 10, i // 60 / 10) <= 10 ** (j - 2)}


def test_nothing(spark, shapes):
    _, large, _ = shapes
    for pair in ((large.limit(0), large), (large, large.limit(0))):
        assert spatial.intersection_pairs(*pair).collect() == [] and spatial.overlap_pairs(*pair, 0.5).collect() == []
    assert {r.outcome for r in spatial.spatial_relate(large, large.limit(0), "INTERSECTS").collect()} == {"SPATIAL_NO_MATCH"}


def test_lines():
    line, area = ("LineString", [[9, 41], [10, 42]]), G.from_geojson(json.dumps(box(8, 40, 4, 4)))
    assert G.within(line, area) and not G.within(("LineString", [[9, 41], [13, 42]]), area) and not G.within(("LineString", [[8, 41], [8, 42]]), area)
    assert spatial._meets(line, area) and spatial._meets(line, ("LineString", [[9, 42], [10, 41]])) and not spatial._meets(line, ("LineString", [[0, 0], [1, 0]]))
    assert G.distance_m(line, area) == 0 and G.distance_m(line, ("Point", [9.0, 41.0])) == 0 and G.area_m2(line) == 0


def test_clear_cells():
    rng = random.Random(3)
    for _ in range(20):
        polys = G.rings("Polygon", polygon(rng, 0, 0, 5, rng.randint(3, 30))["coordinates"])
        cells = G.clear_cells(polys)
        assert len(cells) <= 255
        for x0, y0, x1, y1, inside in cells:
            spots = [(rng.uniform(x0, x1), rng.uniform(y0, y1)) for _ in range(5)] + [(x0, y0), (x1, y1)]
            assert {G.locate(p, polys[0]) for p in spots} == {1 if inside else -1}


def test_dense_place(spark):
    """A fifth of all points in one spot: the same pairs, however the cell is split."""
    rng = random.Random(8)
    rows = [(f"p{i}", 13.6 + rng.uniform(0, 0.0005), 45.6 + rng.uniform(0, 0.0005)) if i % 5 == 0 else (f"p{i}", 13.6 + rng.uniform(-0.05, 0.05), 45.6 + rng.uniform(-0.05, 0.05)) for i in range(400)]
    df = spark.createDataFrame([*rows, ("none", None, 1.0)], "object_id string, lon double, lat double")
    whole = sorted(map(tuple, spatial.nearby_pairs(df, df, 300.0).collect()))
    parts = sorted(map(tuple, spatial.nearby_pairs(df.filter("object_id > 'p3'"), df, 300.0, most=15).collect()))
    assert parts == [r for r in whole if r[0] > "p3"] and len(whole) > 80 * 79
