"""Areas near points by class, and nearest objects by class and rank, against all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from pathglow.operators import cells, nearby

BOXED = "box long, kind string, x1 double, y1 double, x2 double, y2 double"


def to_box(x: float, y: float, b: tuple) -> float:
    return math.hypot(max(b[2] - x, x - b[4], 0), max(b[3] - y, y - b[5], 0))


@pytest.mark.parametrize("most", [1, 4])
@pytest.mark.parametrize("crowd", [2, 1024])
def test_nearest_by_class_and_rank_like_all_pairs(spark, monkeypatch, most, crowd):
    monkeypatch.setattr(cells, "CROWD", crowd)
    rng = random.Random(most * crowd)
    boxes = []
    for i in range(220):
        x, y, w = rng.choice([0, 1e4]) + rng.uniform(0, 300), rng.uniform(0, 300), rng.choice([0, 0, 2, 40])
        boxes.append((i, "abcd"[rng.choice([0, 0, 1, 1, 2])], x, y, x + w, y + w))
    boxes += [(900, "c", 5.0, 5.0, 5.0, 5.0), (901, "c", 5.0, 5.0, 5.0, 5.0), (902, "a", None, 1.0, 1.0, 1.0), (903, "a", float("nan"), 1.0, 1.0, 1.0)]
    points = [(i, k, rng.uniform(-2e4, 2e4), rng.uniform(-400, 400)) for i in range(40) for k in "abce"] + [(50, "a", None, 1.0), (51, "a", float("nan"), 1.0), (52, "c", 5.0, 5.0)]
    p, o = spark.createDataFrame(points, "id long, kind string, px double, py double"), spark.createDataFrame(boxes, BOXED)
    dist = F.sqrt(F.greatest(F.col("x1") - F.col("px"), F.col("px") - F.col("x2"), F.lit(0.0)) ** 2 + F.greatest(F.col("y1") - F.col("py"), F.col("py") - F.col("y2"), F.lit(0.0)) ** 2)
    got = cells.nearest_of_all(p, o, "id", "box", dist, 20.0, by=["kind"], most=most).collect()
    expected = set()
    for i, k, x, y in points:
        if x is not None and not math.isnan(x):
            ranked = sorted((to_box(x, y, b), b[0]) for b in boxes[:-2] if b[1] == k)[:most]
            expected |= {(i, k, b) if most == 1 else (i, k, b, r + 1) for r, (_, b) in enumerate(ranked)}
    assert {(r["id"], r["kind"], r["box"]) if most == 1 else (r["id"], r["kind"], r["box"], r["rank"]) for r in got} == expected and len(got) == len(expected)


def test_boxes_of_any_extent_meet_each_point_once(spark):
    rng = random.Random(2)
    boxes = [(i, "k", x, y, x + w, y + rng.choice([0.0, w])) for i in range(60) for x, y, w in [(rng.uniform(-900, 900), rng.uniform(-900, 900), rng.choice([0.0, 3.0, 90.0, 5e6]))]]
    boxes += [(70, "k", None, 0.0, 1.0, 1.0), (71, "k", 0.0, 0.0, float("inf"), 1.0)]
    points = [(i, rng.uniform(-1e3, 1e3), rng.uniform(-1e3, 1e3)) for i in range(200)] + [(999, None, 1.0)]
    p, b = spark.createDataFrame(points, "id long, px double, py double"), spark.createDataFrame(boxes, BOXED)
    met = cells.near_boxes(p, b, 10, 20)
    assert sorted((r["id"], r["box"]) for r in met.collect()) == sorted((i, k[0]) for i, x, y in points if x is not None for k in boxes[:60] if k[2] - 10 <= x <= k[4] + 10 and k[3] - 10 <= y <= k[5] + 10)
    assert met.columns == [*p.columns, *b.columns]
    kinds = p.withColumn("kind", F.when(F.col("id") % 2 == 0, "k").otherwise("l"))
    assert {r["id"] % 2 for r in cells.near_boxes(kinds, b, 10, 20, on=["kind"]).collect()} == {0}


def test_areas_by_class_fall_back_to_the_far_radius(spark):
    """A park near by, a pitch far off, a beach beyond reach; a line as an area; points inside and without a place."""
    square = lambda k, c, x, y, s: [(k, c, *map(float, e)) for e in ((x, y, x + s, y), (x + s, y, x + s, y + s), (x + s, y + s, x, y + s), (x, y + s, x, y))]
    edges = square(1, "park", 0, 0, 100) + square(2, "park", 300, 0, 50) + square(3, "pitch", 1500, 0, 40) + square(4, "beach", 9000, 0, 10) + [(5, "sand", 0.0, 200.0, 100.0, 200.0)]
    shapes = nearby.area_shapes(spark.createDataFrame(edges, "area int, area_class string, x1 double, y1 double, x2 double, y2 double"))
    points = spark.createDataFrame([(1, 50.0, 50.0), (2, 200.0, 50.0), (3, 50.0, 200.5), (4, None, 1.0), (5, 60000.0, 0.0)], "id int, px double, py double")
    got = {(r["id"], r["area_class"]): tuple(r)[2:] for r in nearby.nearest_by_class(points, shapes, ["park", "pitch", "beach", "sand"], "id").collect()}
    assert got[1, "park"] == (1, 0.0, True, 250.0) and got[2, "park"] == (1, 100.0, False, 250.0)
    assert got[1, "pitch"] == (3, 1450.034482, False, 2000.0) and (1, "beach") not in got
    assert got[3, "sand"] == (5, 0.5, True, 250.0) and got[1, "sand"] == (5, 150.0, False, 250.0)
    assert {k for k, _ in got} == {1, 2, 3}
    near = {r["id"]: tuple(r)[1:] for r in nearby.nearest_of_any(points, shapes, "id").collect()}
    assert near[1] == (1, 0.0, True, 250.0) and near[5] == (4, 50990.0, False, None) and 4 not in near
    assert nearby.nearest_by_class(points, shapes.limit(0), ["park"], "id").count() == nearby.nearest_of_any(points, shapes.limit(0), "id").count() == 0


def test_distances_to_edges_are_computed_once_a_pair(spark):
    """Functions over an area's edges are interpreted, so no plan calls them again for each column that follows from a distance."""
    edges = spark.createDataFrame([(1, "park", 0.0, 0.0, 9.0, 0.0), (1, "park", 9.0, 0.0, 0.0, 9.0), (1, "park", 0.0, 9.0, 0.0, 0.0)], "area int, area_class string, x1 double, y1 double, x2 double, y2 double")
    pairs = spark.createDataFrame([(1, 1.0, 1.0), (2, 12.0, 9.0), (3, 4.5, 4.5)], "id int, px double, py double").crossJoin(nearby.area_shapes(edges))
    best = nearby._best(pairs, ["id"], "area", "px", "py")
    assert best._jdf.queryExecution().optimizedPlan().toString().count("transform(edges") == 1
    assert sorted(tuple(r)[1:] for r in best.collect()) == sorted([(1, 0.0, True), (1, round(math.dist((12, 9), (6, 3)), 6), False), (1, 0.0, True)])
