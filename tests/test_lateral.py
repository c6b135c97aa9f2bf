"""Heat beside candidates: directions, tangents and steps along lines against plain computations."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathglow.operators import lateral


def at(line, s):
    """The point at measure ``s`` of a line."""
    for (x1, y1), (x2, y2) in zip(line, line[1:], strict=False):
        d = math.dist((x1, y1), (x2, y2))
        if s <= d:
            return x1 + s / d * (x2 - x1), y1 + s / d * (y2 - y1)
        s -= d
    return line[-1]


def segments(lines):
    return [(w, i, *map(float, a), *map(float, b)) for w, line in enumerate(lines) for i, (a, b) in enumerate(zip(line, line[1:], strict=False))]


SEGMENT = "way_id long, pos int, x1 double, y1 double, x2 double, y2 double"


def test_directions_are_those_of_the_covariance(spark):
    rng = random.Random(5)
    cells = [(k, rng.randrange(12), rng.randrange(12)) for k in range(40) for _ in range(6)] + [(99, 3, 3), (98, 0, 0), (98, 0, 1), (98, 1, 0), (98, 1, 1)]
    x, y = lateral.direction()
    found = {r["k"]: r for r in spark.createDataFrame(cells, "k int, r int, c int").groupBy("k").agg(*lateral.moments()).select("k", x, y).collect()}
    assert found[99]["ax"] is None and found[98]["ax"] is None  # one cell and a square have no direction
    for k in range(40):
        points = np.array([(c, -r) for g, r, c in cells if g == k], float)
        values, vectors = np.linalg.eigh(np.cov(points.T))
        if values[1] - values[0] > 1e-6:
            assert abs(vectors[:, 1] @ (found[k]["ax"], found[k]["ay"])) == pytest.approx(1)


def test_tangents_span_the_window_around_the_nearest_place(spark):
    lines = [[(0, 0), (10, 0), (10, 50)], [(0, 0), (0.4, 0)], [(0, 0), (0, 0), (5, 5)]]
    ways = lateral.measured(spark.createDataFrame(segments(lines), SEGMENT))
    asked = [(i, w, s) for i, (w, s) in enumerate([(0, 0.0), (0, 8.0), (0, 31.0), (0, 60.0), (1, 0.2), (2, 3.0)])]
    pairs = spark.createDataFrame(asked, "id int, way_id long, along double").join(ways.select("way_id", "total").distinct(), "way_id")
    found = {r["id"]: (r["tx"], r["ty"]) for r in lateral.tangents(pairs, ways, ["id"]).collect()}
    assert 4 not in found  # shorter than a metre
    for i, w, s in asked:
        if i == 4:
            continue
        total = sum(math.dist(a, b) for a, b in zip(lines[w], lines[w][1:], strict=False))
        half = min(20, total / 2)
        a, b = at([p for n, p in enumerate(lines[w]) if not n or p != lines[w][n - 1]], max(0, s - half)), at(lines[w], min(total, s + half))
        assert found[i] == pytest.approx((b[0] - a[0], b[1] - a[1]))


def test_steps_follow_each_part_inside_the_tile(spark):
    lines = {0: [(-5, 3), (4, 3), (4, 30), (12, 30), (12, -2)], 1: [(30, 30), (40, 40)], 2: [(2, 2), (2.4, 2)], 3: [(19.2, 5), (25, 5)], 4: [(0, 0), (19, 19), (0, 19), (19, 0), (0, 5)]}
    rows = [(k, i, float(a[1]), float(a[0]), float(b[1]), float(b[0])) for k, line in lines.items() for i, (a, b) in enumerate(zip(line, line[1:], strict=False))]
    got = {}
    for r in lateral.points_on_lines(spark.createDataFrame(rows, "k int, place int, r1 double, c1 double, r2 double, c2 double"), ["k"], 20, 80).orderBy("k", "i").collect():
        got.setdefault(r["k"], []).append((r["r"], r["c"]))

    def steps(part):
        total = sum(math.dist(a, b) for a, b in zip(part, part[1:], strict=False))
        n = min(80, max(2, math.ceil(round(total, 6)) + 1))
        spots = [at(part, total * i / (n - 1)) for i in range(n)]
        return [(round(round(y, 6)), round(round(x, 6))) for x, y in spots if round(round(y, 6)) < 20 and round(round(x, 6)) < 20]

    assert got[0] == steps([(0, 3), (4, 3), (4, 20)]) + steps([(12, 20), (12, 0)])  # it leaves the tile and comes back
    assert 1 not in got
    assert got[2] == [(2, 2), (2, 2)]
    assert got[3] == [(5, 19)]  # the far end rounds to a cell outside
    assert got[4] == steps(lines[4])[:80] and len(got[4]) == 80


def test_candidates_without_ways_have_no_cover(spark):
    cells = [(0, 1, r, 4, 120) for r in range(3, 12)] + [(0, 2, 15, 15, 130)]
    heat = spark.createDataFrame([(t, r, c, v) for t, _, r, c, v in cells] + [(0, r, 6, 60) for r in range(0, 20)], "tile long, r int, c int, v int")
    own = spark.createDataFrame(cells, "tile long, comp long, r int, c int, v int")
    for lines, way in (([[(60, -400), (60, 400)]], 0), ([[(9000, 0), (9000, 500)]], None)):
        found = lateral.lateral_metrics(own, spark.createDataFrame(segments(lines), SEGMENT), heat, F.lit(0.0), F.lit(0.0), 10.0, 20).orderBy("n").collect()
        single, long = found
        assert (single["n"], single["way_id"], single["cover250"]) == (1, None, 0)
        assert long["way_id"] == way and long["cover50"] == (0 if way is None else 1)
        assert (long["axis_n"], long["axis_mean"]) == (9, 120)
        if way is None:
            assert long["halo"] is None and long["votes"] == 0
        else:
            assert (long["d_median"], long["votes"], long["way_mean"], long["between_median"]) == (20, 9, 60, 60)
            assert long["halo"] == 0.5
    assert lateral.lateral_metrics(own.limit(0), spark.createDataFrame(segments(lines), SEGMENT), heat, F.lit(0.0), F.lit(0.0), 10.0, 20).count() == 0


def test_percentiles_of_large_groups_are_exact(spark):
    from pathglow.operators.quantiles import exact_quantiles

    rng = random.Random(3)
    rows = [(g, float(rng.choice((rng.randrange(30), rng.random() * 30)))) for g in ("a", "b", None) for _ in range(700)] + [("one", 4.0), ("a", None), ("none", None)]
    df, shares = spark.createDataFrame(rows, "g string, x double").repartition(7), (0.0, 0.1, 0.5, 0.9, 1.0)
    for held in (0, 10**6):
        found = {r["g"]: r for r in exact_quantiles(df, ["g"], "x", shares, held).collect()}
        assert set(found) == {"a", "b", None, "one", "none"}
        none = found.pop("none")
        assert (none["n"], none["low"], none["mean"], none["q"]) == (0, None, None, None)
        for g, r in found.items():
            own = [x for k, x in rows if k == g and x is not None]
            assert list(r["q"]) == pytest.approx(list(np.percentile(own, [100 * s for s in shares])))
            assert (r["n"], r["low"], r["high"], r["mean"]) == (len(own), min(own), max(own), pytest.approx(np.mean(own)))
        whole = exact_quantiles(df, [], "x", (0.5,), held).collect()
        assert whole[0]["q"] == pytest.approx([np.median([x for _, x in rows if x is not None])])
        assert exact_quantiles(df.limit(0), ["g"], "x", shares, held).count() == 0


def test_filled_polygons_hold_the_cells_inside(spark):
    from pathglow.operators.raster import fill_polygons

    shapes = {1: [(2, 2), (9, 3), (5, 5.5), (8, 9), (1, 8)], 2: [(-30, -30), (-30, 4), (3.5, 3.5)], 3: [(25, 25), (30, 25), (30, 30)], 4: [(12, 12), (12, 12)], 5: [(13, 10), (15, 14), (17, 10), (15, 40)]}
    edges = [(0, k, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for k, s in shapes.items() for a, b in zip(s, s[1:] + s[:1], strict=True)]
    heat = [(t, r, c, 9) for t in (0, 1) for r in range(20) for c in range(20)]
    left = fill_polygons(spark.createDataFrame(heat, "tile int, r int, c int, v int"), spark.createDataFrame(edges, "tile int, shape int, r1 double, c1 double, r2 double, c2 double"), 20)

    def holds(r, c):
        return any(sum((r1 > r) != (r2 > r) and c < (c2 - c1) * (r - r1) / (r2 - r1) + c1 for _, k, r1, c1, r2, c2 in edges if k == s) % 2 for s in shapes)

    got = {(x["tile"], x["r"], x["c"]): x["v"] for x in left.collect()}
    assert got == {(t, r, c): 0 if t == 0 and holds(r, c) else 9 for t, r, c, _ in heat}
    assert 20 < sum(v == 0 for v in got.values()) < 200


def test_lines_without_length_have_no_points(spark):
    """A centre that lies on its way has nothing in between; a piece of no length does not part a line."""
    lines = [(1, 1, 5.0, 5.0, 5.0, 5.0), (2, 1, 2.0, 2.0, 2.0, 4.0), (2, 2, 2.0, 4.0, 2.0, 4.0), (2, 3, 2.0, 4.0, 2.0, 6.0)]
    found = lateral.points_on_lines(spark.createDataFrame(lines, "k int, place int, r1 double, c1 double, r2 double, c2 double"), ["k"], 20, 80)
    assert sorted((r["k"], r["r"], r["c"]) for r in found.collect()) == [(2, 2, c) for c in (2, 3, 4, 5, 6)]
