from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from pathglow.functions import geo
from pathglow.operators import areas, cells, layers, mapdata, metrics


def plane():
    return F.sqrt((F.col("lx") - F.col("rx")) ** 2 + (F.col("ly") - F.col("ry")) ** 2)


def points(spark, n, seed, names):
    rng = np.random.default_rng(seed)
    data = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-300, 300, (n, 2)).round(1).tolist())]
    return spark.createDataFrame(data, f"{names[0]} long, {names[1]} double, {names[2]} double"), data


def test_near_pairs_like_all_pairs(spark):
    left, a = points(spark, 120, 1, ("lid", "lx", "ly"))
    right, b = points(spark, 150, 2, ("rid", "rx", "ry"))
    got = {(r["lid"], r["rid"]) for r in cells.near_pairs(left, right, 40.0, plane()).collect()}
    assert got == {(i, j) for i, x, y in a for j, u, v in b if math.hypot(x - u, y - v) <= 40}
    near = {r["lid"]: r["rid"] for r in cells.nearest_by_ladder(left, right, (10.0, 30.0, 90.0), plane(), "lid", "rid").collect()}
    best = {i: min((math.hypot(x - u, y - v), j) for j, u, v in b) for i, x, y in a}
    assert near == {i: j for i, (d, j) in best.items()}
    assert cells.nearest_by_ladder(left, right.limit(0), (10.0, 30.0), plane(), "lid", "rid").count() == 0
    kept, removed = cells.farther_than(left, right, 25.0, plane(), "lid", "rid")
    assert {r["lid"] for r in kept.collect()} == {i for i, (d, _) in best.items() if d > 25}
    assert removed.count() + kept.count() == len(a)


def test_nearest_of_all_like_all_pairs(spark, monkeypatch):
    """Far points, a crowd at one place, rings of equal distance, boxes of any size, missing coordinates."""
    monkeypatch.setattr(cells, "CROWD", 20)
    rng = np.random.default_rng(8)
    boxes = [(i, x, y, x + w, y + h) for i, (x, y, w, h) in enumerate((rng.normal(size=(150, 4)) * [40, 40, 3, 3]).round(2).tolist())]
    boxes = [(i, min(a, c), min(b, d), max(a, c), max(b, d)) for i, a, b, c, d in boxes] + [(200 + i, 7.0, 7.0, 7.0, 7.0) for i in range(60)] + [(300, -1e6, 5.0, -1e6, 6.0), (301, None, 1.0, 2.0, 3.0)]
    spots = [(i, *p) for i, p in enumerate((rng.normal(size=(60, 2)) * 300).round(1).tolist())] + [(100, 1e5, -1e5), (101, -9e5, 0.0), (102, 7.0, 7.0), (103, None, 1.0)]
    points, objects = spark.createDataFrame(spots, "id long, px double, py double"), spark.createDataFrame(boxes, "box int, x1 double, y1 double, x2 double, y2 double")
    dist = F.sqrt(F.greatest(F.col("x1") - F.col("px"), F.col("px") - F.col("x2"), F.lit(0.0)) ** 2 + F.greatest(F.col("y1") - F.col("py"), F.col("py") - F.col("y2"), F.lit(0.0)) ** 2)
    got = {r["id"]: r["box"] for r in cells.nearest_of_all(points, objects, "id", "box", dist, 5.0).collect()}
    gap = lambda x, y, a, b, c, d: math.sqrt(max(a - x, x - c, 0.0) ** 2 + max(b - y, y - d, 0.0) ** 2)
    assert got == {i: min((gap(x, y, *box), k) for k, *box in boxes if box[0] is not None)[1] for i, x, y in spots if x is not None}


def test_boxes_and_empty_sides(spark):
    pts, a = points(spark, 100, 3, ("id", "px", "py"))
    boxes = spark.createDataFrame([(k, k * 40.0 - 200, -50.0, k * 40.0 - 120, 60.0) for k in range(8)], "way int, x1 double, y1 double, x2 double, y2 double")
    got = {(r["id"], r["way"]) for r in cells.near_boxes(pts, boxes, 10, 50).collect()}
    assert got == {(i, k) for i, x, y in a for k in range(8) if k * 40 - 210 <= x <= k * 40 - 110 and -60 <= y <= 70}
    assert cells.near_boxes(pts.limit(0), boxes, 10, 50).count() == 0


def test_polygon_parity_like_winding(spark):
    ring = [(0.0, 0.0), (8.0, 2.0), (6.0, 9.0), (4.0, 4.0), (0.0, 7.0)]
    edges = spark.createDataFrame([(1, *p, *q) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)], "ring int, x1 double, y1 double, x2 double, y2 double")
    spots = [(i, x + 0.37, y + 0.21) for i, (x, y) in enumerate((x, y) for x in range(-1, 9) for y in range(-1, 10))]
    df = spark.createDataFrame(spots, "spot long, px double, py double")
    got = {r["spot"] for r in areas.placed_points(df, areas.covering(edges, "ring"), "ring").where("inside").collect()}

    def winding(x, y):
        turn = 0.0
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
            t = math.atan2(d - y, c - x) - math.atan2(b - y, a - x)
            turn += (t + math.pi) % (2 * math.pi) - math.pi
        return abs(turn) > math.pi

    assert got == {i for i, x, y in spots if winding(x, y)}


def test_scalars(spark):
    one = spark.range(1)
    x, y = geo.lonlat_to_tile(F.lit(2.65), F.lit(39.57), 14)
    assert one.select(x, y).first()[:] == (8312, int((1 - math.asinh(math.tan(math.radians(39.57))) / math.pi) / 2 * 16384))
    assert abs(one.select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))).first()[0] - 6371000 * math.pi / 180) < 1e-6
    assert one.select(geo.axis_angle(*map(F.lit, (1.0, 0.0, -1.0, 1.0)))).first()[0] - 45 < 1e-9
    assert one.select(geo.axis_angle(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))).first()[0] is None
    assert one.select(geo.segment_distance(*map(F.lit, (3.0, 4.0, 0.0, 0.0, 0.0, 0.0)))).first()[0] == 5
    assert one.select(geo.line_width(F.lit(2.5), F.lit(1.0))).first()[0] == 5  # halves to even


def test_even_sample_like_linspace(spark):
    for n, most in ((5, 10), (37, 10), (200, 16), (11, 2)):
        df = spark.range(n).select(F.lit("k").alias("k"), "id")
        got = sorted(r["id"] for r in metrics.even_sample(df, "k", F.col("id"), most).collect())
        assert got == (list(range(n)) if n <= most else sorted({round(v) for v in np.linspace(0, n - 1, most).tolist()}))


def test_farthest_points(spark):
    data = [("a", i, float(x), 0.0) for i, x in enumerate((0, 1, 2, 50, 100))] + [("b", 9, 1.0, 1.0)]
    df = spark.createDataFrame(data, "g string, id long, x double, y double")
    got = {(r["g"], r["id"], r["rank"]) for r in layers.farthest_points(df, "g", F.lit(3)).collect()}
    assert got == {("a", 0, 1), ("a", 4, 2), ("a", 3, 3), ("b", 9, 1)}


def test_farthest_points_of_large_groups_like_a_loop(spark):
    rng = np.random.default_rng(5)
    data = [(g, i, float(x), float(y)) for g, n in (("a", 6000), ("b", 2500), (None, 7)) for i, (x, y) in enumerate(rng.integers(0, 400, (n, 2)).tolist())]

    def loop(own, quota):
        chosen = [min(own, key=lambda p: (p[2], p[3], p[1]))]
        while len(chosen) < min(quota, len(own)):
            left = [p for p in own if p not in chosen]
            chosen.append(max(left, key=lambda p: (min((p[2] - c[2]) ** 2 + (p[3] - c[3]) ** 2 for c in chosen), p[1])))
        return {(p[0], p[1], n) for n, p in enumerate(chosen, 1)}

    df = spark.createDataFrame(data, "g string, id long, x double, y double")
    quota = F.when(F.col("g") == "a", 13).otherwise(9)
    got = {tuple(r) for r in layers.farthest_points(df, "g", quota).collect()}
    assert got == set().union(*(loop([p for p in data if p[0] == g], q) for g, q in (("a", 13), ("b", 9), (None, 9))))
    assert layers.farthest_points(df.limit(0), "g", quota).count() == 0


def test_tiles_of_area(spark):
    every = mapdata.tiles_of_area(3, 5, 6, 9, spark).collect()
    assert len(every) == 20 and [r["y"] for r in every[:2]] == [9, 8]
    parts = [{(r["x"], r["y"]) for r in mapdata.tiles_of_area(3, 5, 6, 9, spark, o).collect()} for o in range(4)]
    assert len(set().union(*parts)) == sum(map(len, parts)) == 20


def test_far_search_counts_finely_only_what_is_asked_for(spark, monkeypatch):
    """Objects that no point may need are counted in wide cells alone, and the points of a wide cell go down together."""
    monkeypatch.setattr(cells, "CROWD", 20)
    made = {}
    monkeypatch.setattr(cells, "written", lambda df, name, f=cells.written: made.setdefault(name, []).append(t := f(df, name)) or t)
    rng = np.random.default_rng(3)
    spots = [(i, 1e4 * (i // 50) + x, y) for i, (x, y) in enumerate(rng.uniform(0, 39, (500, 2)).round(3).tolist())]
    asked = [(i, 1e4 + x, 60.0) for i, x in enumerate(rng.uniform(0, 39, 30).round(3).tolist())]
    objects = spark.createDataFrame([(i, x, y, x, y) for i, x, y in spots], "box int, x1 double, y1 double, x2 double, y2 double")
    dist = F.sqrt((F.col("px") - F.col("x1")) ** 2 + (F.col("py") - F.col("y1")) ** 2)
    got = {r["id"]: r["box"] for r in cells.nearest_of_all(spark.createDataFrame(asked, "id int, px double, py double"), objects, "id", "box", dist, 5.0).collect()}
    assert got == {i: min((math.hypot(px - x, py - y), k) for k, x, y in spots)[1] for i, px, py in asked}
    assert [t.count() for t in made["cells"]] == [10]  # one cell of 40 for each of ten crowds
    assert made["asked"] and max(t.count() for t in made["asked"]) == 50  # of 500
