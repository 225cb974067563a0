"""Spatial reads and joins over grid cells.

points: object_id, lon, lat and the scope columns. polygons: object_id, wkb, and the bounds
min_x, min_y, max_x, max_y. No join here compares all pairs: both sides are dealt into grid
cells, joined on the cell, and refined by the exact test.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, StructField, StructType

from cairnlake.functions import geometry as G
from cairnlake.sources.scratch import stored

MOST_RADIUS, MOST_KM2, MOST_HITS = 50_000.0, 2500.0, 200
#: Metres a degree of latitude has at least.
DEGREE = 110_574.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the mean sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (2 * G.MEAN_RADIUS)


@pandas_udf(DoubleType())
def spheroid(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    return pd.Series([G.geodesic(*p) for p in zip(lon1, lat1, lon2, lat2, strict=True)], dtype="float64")


def nearby_pairs(anchors: DataFrame, targets: DataFrame, radius: float, distance: str = "sphere", most: int | None = None) -> DataFrame:
    """(anchor_id, object_id, distance_m) within the radius, an object not with itself.

    Anchors are dealt into the cells around them, of three rows with each row's own columns, and
    across the date line. Beyond 85 degrees of latitude a row is one cell. A cell with over `most`
    (MOST_IN_CELL, if not given) anchors or targets is split, both ways. distance: sphere (JVM only)
    or spheroid.
    """
    t = targets.filter("lon IS NOT NULL AND lat IS NOT NULL").select("object_id", F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))
    a = anchors.filter("lon IS NOT NULL AND lat IS NOT NULL").select(F.col("object_id").alias("anchor_id"), F.col("lon").alias("alon"), F.col("lat").alias("alat"))
    pairs = _close(a, t, radius, most or MOST_IN_CELL).filter("anchor_id <> object_id")
    return _measured(pairs, radius, distance).select("anchor_id", "object_id", "distance_m")


def _close(a: DataFrame, t: DataFrame, radius: float, most: int) -> DataFrame:
    """Each row of a(alon, alat, ...) beside the rows of t(tlon, tlat, ...) that share a cell with it:
    all within the radius, and some beyond."""
    if not 0 < radius <= MOST_RADIUS:
        raise ValueError(f"a radius is above 0 and up to {MOST_RADIUS:g} m")
    few = a.select("alon").limit(most + 1).count() <= most >= t.select("tlon").limit(most + 1).count()
    a_ids, t_ids = a.columns, [c for c in t.columns if c != "ids"]
    step = radius / DEGREE * 1.02
    # a column's width in a row: by the row's latitude farthest from the equator
    width = lambda row: F.when(F.greatest(F.abs(row), F.abs(row + 1)) * step > 85, F.lit(360.0)).otherwise(step / F.cos(F.radians(F.greatest(F.abs(row), F.abs(row + 1)) * step)))
    cell = lambda lon, row: F.floor(F.pmod(lon + 180, F.lit(360.0)) / width(row))
    t = t.withColumn("row", F.floor(F.col("tlat") / step)).withColumn("cell", cell(F.col("tlon"), F.col("row")))
    a = a.withColumn("row", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("alat") / step) + d)))
    reach = F.when(F.abs(F.col("alat")) + step > 85, F.lit(180.0)).otherwise(step / F.cos(F.radians(F.least(F.abs(F.col("alat")) + step, F.lit(85.0)))))
    a = a.withColumn("w", width(F.col("row"))).withColumn("reach", reach)
    spans = F.transform(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)), lambda s: F.sequence(F.floor((F.col("alon") + 180 - F.col("reach") + s) / F.col("w")), F.floor((F.col("alon") + 180 + F.col("reach") + s) / F.col("w"))))
    cells = F.array_distinct(F.filter(F.flatten(spans), lambda c: c.between(0, F.floor(360 / F.col("w")))))
    a = a.withColumn("cell", F.explode(cells)).drop("w", "reach")
    key = ["row", "cell"]
    # a side of so few rows has no dense cell, so nothing is counted by cell
    if not few:
        (a, t), key = _split_cells(a, t, most, key, a_ids, t_ids), [*key, "_part"]
    return a.join(t, key)


def _measured(pairs: DataFrame, radius: float, distance: str) -> DataFrame:
    """pairs with distance_m, up to the radius. The sphere's distance is within 0.6 % of the
    spheroid's, so geodesics are solved for few pairs beyond the radius only."""
    here = [F.col(c) for c in ("alon", "alat", "tlon", "tlat")]
    if distance != "sphere":
        pairs = pairs.filter(haversine(*here) <= radius * 1.01)
    return pairs.withColumn("distance_m", (haversine if distance == "sphere" else spheroid)(*here)).filter(F.col("distance_m") <= radius)


def nearest_pairs(anchors: DataFrame, targets: DataFrame, radius: float, k: int, distance: str = "sphere", digits: int | None = None, most: int | None = None) -> DataFrame:
    """Of nearby_pairs() each anchor's k nearest, by distance (rounded to `digits`, if given) and
    id, with rank.

    Pairs are made between places. Of the targets at one place only the k + 1 least ids can be
    among the nearest (one may be the anchor), and anchors at one place share their nearest, so
    neither copies of targets nor of anchors make pairs. An id is at one place.
    """
    top = lambda df, n, by, *order: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
    here, there = ["alon", "alat"], ["tlon", "tlat"]
    t = targets.filter("lon IS NOT NULL AND lat IS NOT NULL AND object_id IS NOT NULL").select("object_id", F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))
    t = stored(top(t, k + 1, there, "object_id").groupBy(*there).agg(F.sort_array(F.collect_list("object_id")).alias("ids")), "places")
    a = anchors.filter("lon IS NOT NULL AND lat IS NOT NULL").select(F.col("object_id").alias("anchor_id"), F.col("lon").alias("alon"), F.col("lat").alias("alat"))
    places = stored(a.select(*here).distinct(), "places")
    pairs = _measured(_close(places, t, radius, most or MOST_IN_CELL), radius, distance)
    if digits is not None:
        pairs = pairs.withColumn("distance_m", F.round("distance_m", digits))
    # k + 1 nearer rows, one of each nearer place, leave no room for a farther place
    pairs = top(pairs, k + 1, here, "distance_m", F.col("ids")[0])
    rows = top(pairs.select(*here, "distance_m", F.explode("ids").alias("object_id")), k + 1, here, "distance_m", "object_id")
    out = a.join(rows, here).filter("anchor_id <> object_id").select("anchor_id", "object_id", "distance_m")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id").orderBy("distance_m", "object_id"))).filter(F.col("rank") <= k)


def nearby(anchors: DataFrame, targets: DataFrame, radius: float, k: int, distance: str = "sphere") -> DataFrame:
    """Each anchor's k nearest within the radius, by distance and id, with rank."""
    if not 1 <= k <= MOST_HITS:
        raise ValueError(f"1 to {MOST_HITS} hits can be asked for")
    return nearest_pairs(anchors, targets, radius, k, distance)


def envelope_km2(min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> float:
    return (max_lat - min_lat) * 111.32 * (max_lon - min_lon) * 111.32 * math.cos(math.radians((min_lat + max_lat) / 2))


def envelope_points(points: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float, within: bool = False) -> DataFrame:
    """Points that intersect the box, or lie within it: a point on its border only intersects."""
    if not (-180 <= min_lon <= max_lon <= 180 and -90 <= min_lat <= max_lat <= 90 and 0 < envelope_km2(min_lon, min_lat, max_lon, max_lat) <= MOST_KM2):
        raise ValueError(f"a box of EPSG:4326 with up to {MOST_KM2:g} km² is needed")
    if within:
        return points.filter((F.col("lon") > min_lon) & (F.col("lon") < max_lon) & (F.col("lat") > min_lat) & (F.col("lat") < max_lat))
    return points.filter(F.col("lon").between(min_lon, max_lon) & F.col("lat").between(min_lat, max_lat))


# --- polygons ---


def with_bounds(df: DataFrame, geojson: str = "geojson") -> DataFrame:
    """df with wkb, bounds, is_box and geometry_status (OK, or what is wrong, then wkb is null)."""

    @pandas_udf("wkb binary, min_x double, min_y double, max_x double, max_y double, is_box boolean, geometry_status string")
    def parse(s: pd.Series) -> pd.DataFrame:
        rows = []
        for text in s:
            try:
                kind, c = G.from_geojson(text)
                flat = [c] if kind == "Point" else [p for r in ([c] if kind == "LineString" else c if kind == "Polygon" else [r for p in c for r in p]) for p in r]
                xs, ys = zip(*flat, strict=True)
                rows.append((G.to_wkb(kind, c), min(xs), min(ys), max(xs), max(ys), G.is_box(kind, c), "OK"))
            except ValueError as e:
                rows.append((None, None, None, None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["wkb", "min_x", "min_y", "max_x", "max_y", "is_box", "geometry_status"])

    return df.withColumn("_g", parse(F.col(geojson))).select(*df.columns, "_g.*")


def _pairwise(returns: DataType, kernel):
    """A pandas UDF over two WKB columns, null where one is; each distinct geometry of a batch is
    parsed once."""

    @pandas_udf(returns)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[bytes, tuple[str, list]] = {}

        def get(x):
            x = bytes(x)
            if x not in known:
                known[x] = G.from_wkb(x)
            return known[x]

        return pd.Series([None if x is None or y is None else kernel(get(x), get(y)) for x, y in zip(a, b, strict=True)], dtype="float64" if returns == DoubleType() else "object")

    return run


def _meets(a: tuple[str, list], b: tuple[str, list]) -> bool:
    (k, c), (m, d) = a, b
    if k == "Point" and m == "Point":
        return c == d
    if k == "Point":
        return any(G.locate(tuple(c), p) >= 0 for p in G.rings(m, d))
    if m == "Point":
        return any(G.locate(tuple(d), p) >= 0 for p in G.rings(k, c))
    return G.intersects(G.rings(k, c), G.rings(m, d))


def _share(a: tuple[str, list], b: tuple[str, list]) -> float:
    p, q = G.rings(*a), G.rings(*b)
    if not p or not q:
        return 0.0
    lat = p[0][0][0][1]
    p, q = G.local_metres(p, lat), G.local_metres(q, lat)
    whole = G.area(p)
    return G.overlap(p, q) / whole if whole else 0.0


polygons_intersect = _pairwise(BooleanType(), _meets)
#: Area of the intersection by that of the first; both around one latitude.
overlap_share = _pairwise(DoubleType(), _share)
distance_between = _pairwise(DoubleType(), G.distance_m)
lies_within = _pairwise(BooleanType(), G.within)


# --- pairs of shapes by cells of many sizes ---

#: The smallest cells have sides of 2^LEAST_LEVEL degrees, a decimetre.
LEAST_LEVEL = -20
#: Rows of one side in one cell beyond which the cell is split.
MOST_IN_CELL = 20_000
#: A shape at least 2^CLEAR_FROM times as wide as the other side's smallest is told apart by clear cells.
CLEAR_FROM = 3


def _level(df: DataFrame) -> Column:
    """The power of two that a shape's wider side stays within: it touches four cells of that side
    at most (nine, if its bounds are at a power of two and the logarithm is rounded)."""
    wide = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    return F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log2(wide))).cast("int")


COVER = ArrayType(StructType([*(StructField(c, DoubleType()) for c in ("x0", "y0", "x1", "y1")), StructField("inside", BooleanType())]))


@pandas_udf(COVER)
def clear_cells(wkb: pd.Series) -> pd.Series:
    """Cells of a shape's bounds that its border doesn't touch; null for points."""
    out = []
    for x in wkb:
        polys = [] if x is None else G.rings(*G.from_wkb(bytes(x)))
        out.append(G.clear_cells(polys) if polys else None)
    return pd.Series(out, dtype="object")


def _split_cells(cells: DataFrame, other: DataFrame, most: int, key: Sequence[str], ids: Sequence[str], other_ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column _part: a cell with over `most` rows of one side is dealt into parts
    by hash, and the rows of the other side go to each of them."""
    n = lambda df, c: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / most).alias(c)).filter(F.col(c) > 1)
    parts = stored(n(cells, "_p").join(n(other, "_q"), key, "full_outer").na.fill(1, ["_p", "_q"]), "cells")

    def deal(df: DataFrame, mine: str, theirs: str, ids: Sequence[str]) -> DataFrame:
        rows = df.join(parts, key, "left").na.fill(1, ["_p", "_q"])
        own = F.pmod(F.xxhash64(*ids), F.col(mine))
        all_ = F.transform(F.sequence(F.lit(0).cast("long"), F.col(theirs) - 1), lambda i: F.struct(own.alias("a"), i.alias("b")))
        rows = rows.withColumn("_x", F.explode(all_))
        return rows.withColumn("_part", F.concat_ws("/", *(F.col(f"_x.{c}").cast("string") for c in ("ab" if mine == "_p" else "ba")))).drop("_p", "_q", "_x")

    return deal(cells, "_p", "_q", ids), deal(other, "_q", "_p", other_ids)


def box_pairs(left: DataFrame, right: DataFrame, most: int = MOST_IN_CELL, same: Sequence[str] = ()) -> DataFrame:
    """Pairs (left columns as l_*, right as r_*) whose bounds meet, each once; if `same` names
    columns, only pairs that agree in them.

    A shape has a level by its size and lies in four cells of it or so; two shapes meet in cells of
    the larger one's level. So a row is dealt into a few cells of each larger level that occurs on
    the other side (some 30 at most), however large the largest is. A pair is kept in the cell of
    its common lower corner only. Cells with over `most` rows of a side are split, both ways. Both
    sides are read several times: store what is costly to make. l_cover and r_cover hold the clear
    cells of shapes much larger than the other side's smallest.
    """

    def named(df: DataFrame, p: str) -> DataFrame:
        own = df.filter("wkb IS NOT NULL").withColumn("level", _level(df))
        return own.select(*[F.col(c).alias(f"{p}_{c}") for c in own.columns])

    sides = {"l": named(left, "l"), "r": named(right, "r")}
    levels = [df.select(F.lit(p).alias("p"), F.col(f"{p}_level").alias("level"), F.coalesce(F.col(f"{p}_is_box"), F.lit(False)).alias("box")) for p, df in sides.items()]
    found = levels[0].unionAll(levels[1]).groupBy("p", "level").agg(F.count(F.lit(1)).alias("n"), F.min("box").alias("box")).collect()  # a row a level
    sizes = {p: {r.level: r.n for r in found if r.p == p} for p in sides}
    boxes = {f"{p}_is_box": all(r.box for r in found if r.p == p) for p in sides}
    for p, q in (("l", "r"), ("r", "l")):
        least, shape = min(sizes[q], default=0), F.col(f"{p}_level")
        large = F.when((shape >= least + CLEAR_FROM) & ~F.coalesce(F.col(f"{p}_is_box"), F.lit(False)), F.col(f"{p}_wkb"))
        none = F.lit(None).cast(COVER)
        sides[p] = sides[p].withColumn(f"{p}_cover", clear_cells(large) if max(sizes[p], default=0) >= least + CLEAR_FROM else none)

    def dealt(p: str, levels: Column) -> DataFrame:
        out = sides[p].withColumn("_lv", F.explode(levels))
        for axis in ("x", "y"):
            span = F.sequence(*(F.floor(F.col(f"{p}_{end}_{axis}") / F.pow(F.lit(2.0), F.col("_lv"))) for end in ("min", "max")))
            out = out.withColumn(f"_c{axis}", F.explode(span))
        return out.withColumns({f"_s_{c}": F.col(f"{p}_{c}") for c in same}) if same else out

    def joined(large: str, small: str, strictly: bool) -> DataFrame | None:
        levels = [v for v in sorted(sizes[large]) if v >= min(sizes[small], default=0) + strictly]
        if not levels or not sizes[small]:
            return None
        over = F.filter(F.array(*map(F.lit, levels)), lambda v: v > F.col(f"{small}_level") if strictly else v >= F.col(f"{small}_level"))
        both = {large: dealt(large, F.array(f"{large}_level")), small: dealt(small, over)}
        l, r, key = both["l"], both["r"], ["_lv", "_cx", "_cy", *(f"_s_{c}" for c in same)]
        if max(sum(sizes["l"].values()), sum(sizes["r"].values())) > most:
            (l, r), key = _split_cells(l, r, most, key, ["l_object_id", "l_min_x", "l_min_y"], ["r_object_id", "r_min_x", "r_min_y"]), [*key, "_part"]
        pairs = l.join(r, key)
        for axis in ("x", "y"):
            pairs = pairs.filter((F.col(f"l_min_{axis}") <= F.col(f"r_max_{axis}")) & (F.col(f"r_min_{axis}") <= F.col(f"l_max_{axis}")))
            pairs = pairs.filter(F.col(f"_c{axis}") == F.floor(F.greatest(f"l_min_{axis}", f"r_min_{axis}") / F.pow(F.lit(2.0), F.col("_lv"))))
        # where all are boxes, the plan says so and has no kernels
        return pairs.select(*[F.lit(True).alias(c) if boxes.get(c) else c for p in "lr" for c in sides[p].columns])

    found = [p for p in (joined("l", "r", False), joined("r", "l", True)) if p is not None]
    if not found:
        return sides["l"].crossJoin(sides["r"]).limit(0)  # one side is empty
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _lies_in(q: str, p: str) -> Column:
    """Whether q's bounds lie in p's."""
    return (F.col(f"{q}_min_x") >= F.col(f"{p}_min_x")) & (F.col(f"{q}_max_x") <= F.col(f"{p}_max_x")) & (F.col(f"{q}_min_y") >= F.col(f"{p}_min_y")) & (F.col(f"{q}_max_y") <= F.col(f"{p}_max_y"))


def _in_clear_cell(q: str, p: str) -> Column:
    """True if q lies inside p for sure, false if it lies outside, null if only a kernel can tell:
    by the clear cell of p that q's bounds lie in."""
    holds = F.filter(f"{p}_cover", lambda c: (c["x0"] <= F.col(f"{q}_min_x")) & (c["x1"] >= F.col(f"{q}_max_x")) & (c["y0"] <= F.col(f"{q}_min_y")) & (c["y1"] >= F.col(f"{q}_max_y")))
    return F.get(holds, F.lit(0))["inside"]


def _open(known: Column, kernel, a: str, b: str) -> Column:
    """known, or where it is null what the kernel says; it isn't given the other rows' shapes."""
    told = F.coalesce(known, kernel(F.when(known.isNull(), F.col(a)), F.when(known.isNull(), F.col(b))))
    return F.when(_both_boxes(), known).otherwise(told)


def _both_boxes() -> Column:
    return F.coalesce(F.col("l_is_box") & F.col("r_is_box"), F.lit(False))


def _intersects() -> Column:
    return _open(F.when(_both_boxes(), F.lit(True)).otherwise(F.coalesce(_in_clear_cell("r", "l"), _in_clear_cell("l", "r"))), polygons_intersect, "l_wkb", "r_wkb")


def _overlaps() -> Column:
    """Share of the left shape's area."""
    both = lambda axis: F.least(f"l_max_{axis}", f"r_max_{axis}") - F.greatest(f"l_min_{axis}", f"r_min_{axis}")
    whole = (F.col("l_max_x") - F.col("l_min_x")) * (F.col("l_max_y") - F.col("l_min_y"))
    no_area = F.substring("l_wkb", 2, 1).isin(F.unhex(F.lit("01")), F.unhex(F.lit("02")))
    clear = F.when(no_area, 0.0).when(_in_clear_cell("l", "r"), 1.0).when(~_in_clear_cell("l", "r") | ~_in_clear_cell("r", "l"), 0.0)
    return _open(F.when(_both_boxes(), both("x") * both("y") / whole).otherwise(clear), overlap_share, "l_wkb", "r_wkb")


def _within(q: str, p: str) -> Column:
    """Whether q lies in p; rows whose bounds don't are to be filtered first."""
    return _open(F.when(_both_boxes(), F.lit(True)).otherwise(_in_clear_cell(q, p)), lies_within, f"{q}_wkb", f"{p}_wkb")


def _shapes(df: DataFrame, same: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(shapes, members): a row per distinct shape, as with_bounds() makes it, with its hash as
    object_id, its number n of rows and the least id; and (shape, object_id) of all rows, null where
    a row has no shape. Rows that differ in the columns `same` have different shapes."""
    parts = [F.hex("wkb"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in same)]
    named = df.withColumn("shape", F.when(F.col("wkb").isNotNull(), F.sha2(F.concat_ws("|", *parts), 256)))
    firsts = [F.first(c).alias(c) for c in ("wkb", "min_x", "min_y", "max_x", "max_y", "is_box", *(c for c in same if c != "object_id"))]
    shapes = named.filter("shape IS NOT NULL").groupBy("shape").agg(*firsts, F.count(F.lit(1)).alias("n"), F.min("object_id").alias("least"))
    return shapes.withColumnRenamed("shape", "object_id"), named.select("shape", "object_id")


#: Pairs that a task makes of members of shapes, about.
PAIRS_A_TASK = 4_000_000


def _member_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, most: int = MOST_IN_CELL) -> DataFrame:
    """(anchor_id, object_id and pairs' further columns) for pairs of shapes(l_object_id, r_object_id,
    l_n, r_n, ...): all pairs of their members, but none with itself. The tasks are as many as the
    counted pairs ask for, so that none makes much more than its share."""
    pairs = stored(pairs, "pairs")
    more = [c for c in pairs.columns if c not in ("l_object_id", "r_object_id", "l_n", "r_n")]
    total = pairs.agg(F.sum(F.col("l_n") * F.col("r_n"))).first()[0] or 0
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PAIRS_A_TASK))
    l = pairs.join(left.select(F.col("shape").alias("l_object_id"), F.col("object_id").alias("anchor_id")), "l_object_id")
    l = l.select(F.col("r_object_id").alias("shape"), "anchor_id", *more)
    r, key = right.filter("shape IS NOT NULL"), ["shape"]
    if pairs.filter(F.greatest("l_n", "r_n") > most).limit(1).count() or l.groupBy("shape").count().filter(F.col("count") > most).limit(1).count():
        (l, r), key = _split_cells(l, r, most, key, ["anchor_id"], ["object_id"]), ["shape", "_part"]
    out = l.repartition(tasks, *key).join(r.repartition(tasks, *key), key).filter("anchor_id <> object_id")
    return out.select("anchor_id", "object_id", *more)


def intersection_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(anchor_id, object_id) of the shapes that share a point, none with itself. Equal shapes are
    compared once."""
    (a, members), (b, others) = _shapes(left), _shapes(right)
    return _member_pairs(box_pairs(a, b).filter(_intersects()).select("l_object_id", "r_object_id", "l_n", "r_n"), members, others)


def overlap_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(anchor_id, object_id, share) with share of the anchor's area >= least. Equal shapes are
    compared once."""
    (a, members), (b, others) = _shapes(left), _shapes(right)
    pairs = box_pairs(a, b).select("l_object_id", "r_object_id", "l_n", "r_n", _overlaps().alias("share")).filter(F.col("share") >= least)
    return _member_pairs(pairs, members, others)


METRICS = StructType([StructField("topologically_equal", BooleanType()), *(StructField(c, DoubleType()) for c in ("minimum_distance_m", "current_area_m2", "candidate_area_m2"))])


@pandas_udf(METRICS)
def geometry_metrics(current: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    """What a reviewer of two geometries (WKB) sees; null where one is absent."""
    rows = []
    for x, y in zip(current, candidate, strict=True):
        if x is None or y is None:
            rows.append((None, None, None, None))
            continue
        a, b = G.from_wkb(bytes(x)), G.from_wkb(bytes(y))
        rows.append((G.within(a, b) and G.within(b, a), G.distance_m(a, b), G.area_m2(a), G.area_m2(b)))
    return pd.DataFrame(rows, columns=METRICS.names)


PREDICATES = ("INTERSECTS", "WITHIN", "CONTAINS", "NEAREST", "OVERLAP_RATIO")


def spatial_candidates(sources: DataFrame, targets: DataFrame, predicate: str, max_distance: float | None = None, min_overlap: float | None = None, same: Sequence[str] = ()) -> DataFrame:
    """(anchor_id, object_id, distance_m) of the pairs that a predicate holds for; both sides come
    from with_bounds() and agree in the columns `same`. Only NEAREST has distances. A source is its own candidate if it is among
    the targets."""
    if predicate not in PREDICATES:
        raise ValueError("SPATIAL_PREDICATE_UNSUPPORTED")
    if predicate == "NEAREST":
        if max_distance is None:
            raise ValueError("SPATIAL_MAX_DISTANCE_REQUIRED")
        up = F.lit(max_distance / 110_000)
        side = up / F.greatest(F.cos(F.radians(F.greatest(F.abs("min_y"), F.abs("max_y")) + up)), F.lit(0.01))
        sources = sources.withColumns({"min_x": F.col("min_x") - side, "max_x": F.col("max_x") + side, "min_y": F.col("min_y") - up, "max_y": F.col("max_y") + up})
    if predicate == "OVERLAP_RATIO" and min_overlap is None:
        raise ValueError("SPATIAL_MIN_OVERLAP_REQUIRED")
    pairs, distance = box_pairs(sources, targets, same=same), F.lit(None).cast("double")
    if predicate == "INTERSECTS":
        pairs = pairs.filter(_intersects())
    elif predicate == "WITHIN":
        pairs = pairs.filter(_lies_in("l", "r")).filter(_within("l", "r"))
    elif predicate == "CONTAINS":
        pairs = pairs.filter(_lies_in("r", "l")).filter(_within("r", "l"))
    elif predicate == "OVERLAP_RATIO":
        pairs = pairs.filter(_overlaps() >= min_overlap)
    else:
        distance = distance_between("l_wkb", "r_wkb")
    out = pairs.select(F.col("l_object_id").alias("anchor_id"), F.col("r_object_id").alias("object_id"), distance.alias("distance_m"))
    return out.filter(F.col("distance_m") <= max_distance) if predicate == "NEAREST" else out


def spatial_relate(sources: DataFrame, targets: DataFrame, predicate: str, max_distance: float | None = None, min_overlap: float | None = None, margin: float | None = None, self_loops: bool = False, same: Sequence[str] = ()) -> DataFrame:
    """A row per source: anchor_id, outcome, object_id, candidates.

    One candidate is MATCHED, none SPATIAL_NO_MATCH, several SPATIAL_MULTIPLE_MATCHES unless the
    predicate is NEAREST and the second stays at least `margin` metres behind; a source that
    would match itself is SELF_LOOP_NOT_ALLOWED. If `same` names columns, candidates agree with
    the source in them. Pairs are made of distinct shapes, which know their number of rows and the
    least id, so that copies are counted and make no pairs.
    """
    (a, members), (b, _) = _shapes(sources, same), _shapes(targets, same)
    keys = ["_same"] if same else []
    if same:
        a, b = (df.withColumn("_same", F.to_json(F.struct(*(F.col("least" if c == "object_id" else c).alias(c) for c in same)))) for df in (a, b))
    a, b = stored(a, "shapes"), stored(b, "shapes")
    pairs = spatial_candidates(a, b, predicate, max_distance, min_overlap, keys).join(b.select("object_id", "n", "least"), "object_id")
    if predicate == "NEAREST" and margin is not None:
        nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy("distance_m", "least"))
        own = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
        gap = F.when(own(1, "n") > 1, 0.0).otherwise(own(2, "distance_m") - own(1, "distance_m"))
        best = pairs.withColumn("_n", nth).groupBy("anchor_id").agg(F.sum("n").alias("candidates"), own(1, "least").alias("object_id"), gap.alias("_gap"))
        sure = F.col("_gap").isNull() | (F.col("_gap") >= margin)
    else:
        best = pairs.groupBy("anchor_id").agg(F.sum("n").alias("candidates"), F.min("least").alias("object_id"))
        sure = F.col("candidates") == 1
    rows = members.select("shape", F.col("object_id").alias("anchor_id")).join(best.withColumnRenamed("anchor_id", "shape"), "shape", "left")
    loop = F.lit(not self_loops) & (F.col("object_id") == F.col("anchor_id"))
    outcome = F.when(F.col("candidates").isNull(), "SPATIAL_NO_MATCH").when(~sure, "SPATIAL_MULTIPLE_MATCHES").when(loop, "SELF_LOOP_NOT_ALLOWED").otherwise("MATCHED")
    return rows.select("anchor_id", outcome.alias("outcome"), F.when(outcome == "MATCHED", F.col("object_id")).alias("object_id"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


def choose_nearest(pairs: DataFrame, margin: float, metric: str = "distance_m") -> DataFrame:
    """Per anchor (anchor_id, outcome, object_id, metric): the nearest, or MULTIPLE_MATCHES if
    the second is within the margin. Only each anchor's best two are gathered."""
    w = Window.partitionBy("anchor_id").orderBy(metric, "object_id")
    two = pairs.withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    best = two.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct(metric, "object_id"))).alias("b"))
    gap = F.when(F.size("b") > 1, F.col("b")[1][metric] - F.col("b")[0][metric])
    sure = gap.isNull() | (gap >= margin)
    return best.select("anchor_id", F.when(sure, "MATCHED").otherwise("SPATIAL_MULTIPLE_MATCHES").alias("outcome"), F.when(sure, F.col("b")[0]["object_id"]).alias("object_id"), F.col("b")[0][metric].alias(metric))


def store_geometries(incoming: DataFrame, kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new revisions, observations) for incoming(handoff_id, object_id, role, ewkb, source_crs,
    transformation, normalisation): a geometry is known by object, hash and normalisation, so
    equal ones are stored once, by the first handoff; every handoff observes its geometry."""
    keys = ["object_id", "geometry_hash", "normalisation"]
    line = F.concat_ws("|", F.lower("ewkb"), "source_crs", "transformation", "role")
    seen = incoming.withColumn("geometry_hash", F.sha2(line, 256))
    new = seen.groupBy(*keys).agg(F.min(F.struct("handoff_id", "role", "ewkb", "source_crs", "transformation")).alias("g")).select(*keys, "g.*")
    return new if kept is None else new.join(kept.select(*keys), keys, "left_anti"), seen.select("handoff_id", *keys)


def pair_distances(pairs: DataFrame, points: DataFrame, left: str, right: str, distance: str = "sphere") -> DataFrame:
    """pairs with distance_m between the active points(object_id, lon, lat) of two objects; null
    where one has none."""
    out = pairs
    for p, c in (("a", left), ("b", right)):
        out = out.join(points.select(F.col("object_id").alias(c), F.col("lon").alias(f"_{p}x"), F.col("lat").alias(f"_{p}y")), c, "left")
    here = [F.col(c) for c in ("_ax", "_ay", "_bx", "_by")]
    metres = F.when(F.col("_ax").isNotNull() & F.col("_bx").isNotNull(), haversine(*here) if distance == "sphere" else spheroid(*here))
    return out.select(*pairs.columns, metres.alias("distance_m"))


def served_geometries(geometries: DataFrame, labels: Sequence[str], now: Column) -> DataFrame:
    """(object_id, geometries, primary, hidden): the visible current geometries of an object by
    role, of geometries(object_id, role, geojson, canonical, provenance, label, valid_from,
    valid_to); the PRIMARY one again by itself, and the roles withheld, for the audit."""
    from .access import valid_at

    live = geometries.filter(valid_at(F.col("valid_from"), F.col("valid_to"), now))
    seen = F.coalesce(F.col("label").isin(*labels) if labels else F.lit(False), F.lit(False))
    item = F.struct("role", "geojson", "canonical", "provenance")
    out = live.groupBy("object_id").agg(F.sort_array(F.collect_list(F.when(seen, item))).alias("geometries"), F.sort_array(F.collect_list(F.when(~seen, F.col("role")))).alias("hidden"))
    return out.select("object_id", "geometries", F.get(F.filter("geometries", lambda g: g["role"] == "PRIMARY"), F.lit(0)).alias("primary"), "hidden")


def decide_geometries(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """(issue_id, outcome, geometry) for decisions(issue_id, expected, chosen, actor, reason) on
    issues(issue_id, state, previous, candidate, current, decided_geometry, decided_actor,
    decided_reason): REASON_REQUIRED; CONFLICT where the choice isn't one of exactly this pair or
    the current geometry has moved; REPLAYED for the same decision again; else DECIDED."""
    rows = decisions.join(issues, "issue_id", "left")
    blank = F.coalesce(F.trim("reason"), F.lit("")) == ""
    pair = F.col("chosen").isin(F.col("previous"), F.col("candidate")) & (F.col("expected") == F.col("previous"))
    again = F.col("chosen").eqNullSafe(F.col("decided_geometry")) & F.col("actor").eqNullSafe(F.col("decided_actor")) & F.col("reason").eqNullSafe(F.col("decided_reason"))
    fresh = (F.col("state") == "OPEN") & (F.col("previous") == F.col("current"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    outcome = F.when(blank | (F.length("reason") > 2000), "REASON_REQUIRED").when(~yes(pair), "CONFLICT").when(F.col("decided_geometry").isNotNull(), F.when(again, "REPLAYED").otherwise("CONFLICT")).when(yes(fresh), "DECIDED").otherwise("CONFLICT")
    return rows.select("issue_id", outcome.alias("outcome"), F.when(outcome.isin("DECIDED", "REPLAYED"), F.col("chosen")).alias("geometry"))


def arbitrate(rows: DataFrame, order: Sequence[str], now: Column) -> DataFrame:
    """rows of an incoming geometry (source_id, observed_at, valid_from, valid_to, geometry_hash)
    beside the current one (cur_*), with action: FUTURE, HISTORICAL_ONLY, ADVANCE, RETAIN or
    REVIEW_REQUIRED."""
    from .canonical import authority_rank

    mine, theirs = authority_rank(F.col("source_id"), order), authority_rank(F.col("cur_source_id"), order)
    same_source = F.col("source_id") == F.col("cur_source_id")
    action = (
        F.when(F.col("valid_from") > now, "FUTURE")
        .when(F.col("valid_to") <= now, "HISTORICAL_ONLY")
        .when(F.col("cur_source_id").isNull(), "ADVANCE")
        .when(same_source & (F.col("observed_at") < F.col("cur_observed_at")), "HISTORICAL_ONLY")
        .when(F.col("geometry_hash") == F.col("cur_geometry_hash"), "RETAIN")
        .when(same_source | (mine < theirs), "ADVANCE")
        .when(mine > theirs, "HISTORICAL_ONLY")
        .otherwise("REVIEW_REQUIRED")
    )
    return rows.withColumn("action", action)


def projected(df: DataFrame, pipeline: str, geojson: str = "geojson", swap: bool = False, grids: Sequence[str] = ()) -> DataFrame:
    """df with project_status and projected (WKB): OK, or why not. The pipeline is checked first."""
    steps = G.parse_pipeline(pipeline, grids)

    @pandas_udf("project_status string, projected binary")
    def run(s: pd.Series) -> pd.DataFrame:
        def one(text: str) -> tuple[str, bytes | None]:
            try:
                kind, c = G.from_geojson(text)
                go = lambda p: list(G.run_pipeline(steps, *(reversed(p) if swap else p)))
                deep = lambda v: go(v) if not isinstance(v[0], list) else [deep(x) for x in v]
                flat = lambda v: [v] if not isinstance(v[0], list) else [p for x in v for p in flat(x)]
                if any(abs(x) > 180 or abs(y) > 90 for x, y in (reversed(p) if swap else p for p in flat(c))):
                    return "RANGE", None
                out = deep(c)
                if any(not math.isfinite(v) or abs(v) > 1e9 for p in flat(out) for v in p):
                    return "NOT_FINITE", None
                return "OK", G.to_wkb(kind, out)
            except LookupError:
                return "SPATIAL_TRANSFORM_UNAVAILABLE", None
            except ValueError as e:
                return str(e), None

        return pd.DataFrame([one(t) for t in s], columns=["project_status", "projected"])

    return df.withColumn("_p", run(F.col(geojson))).select(*df.columns, "_p.*")
