"""The ways nearest to points without a table of pairs."""

from __future__ import annotations

import math
import random

import pytest

import __spark_entry__ as entry
from pathglow.operators.lines import SLACK, near_lines

POINTS, SEGMENTS = "k int, px double, py double", "way_id int, pos int, x1 double, y1 double, x2 double, y2 double"


def away(px, py, x1, y1, x2, y2):
    length = (x2 - x1) ** 2 + (y2 - y1) ** 2
    t = max(0, min(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / length)) if length else 0
    return math.hypot(px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1))


@pytest.fixture(scope="module")
def rows():
    """Chains of short segments, long lines over many cells, lines without length; points in crowds, on lines, and nowhere."""
    rng, segments = random.Random(11), []
    for w in range(60):
        x, y = rng.uniform(-900, 900), rng.uniform(-900, 900)
        for p in range(4):
            u, v = x + rng.uniform(-60, 60), y + rng.uniform(-60, 60)
            segments.append((w, p, x, y, u, v))
            x, y = u, v
    segments += [(100, 1, -5000.0, -4000.0, 5000.0, 4500.0), (101, 1, -900.0, 20.0, 900.0, 20.0), (102, 1, 30.0, -900.0, 30.0, 900.0), (103, 1, 40.0, 40.0, 40.0, 40.0)]
    points = [(k, rng.uniform(-900, 900), rng.uniform(-900, 900)) for k in range(300)] + [(400 + k, 40.0, 40.0) for k in range(70)] + [(500 + k, -4600.0 + 900 * k, -3600.0 + 760 * k) for k in range(11)]
    return points, segments


def given(spark, rows):
    nowhere = [(900, None, 1.0), (901, float("nan"), 1.0)], [(900, 1, None, 0.0, 1.0, 1.0), (901, 1, 0.0, float("inf"), 1.0, 1.0)]
    return spark.createDataFrame(rows[0] + nowhere[0], POINTS), spark.createDataFrame(rows[1] + nowhere[1], SEGMENTS)


@pytest.mark.parametrize("most", [None, 1, 5])
@pytest.mark.parametrize("radius", [40, 150])
def test_ways_once(spark, rows, radius, most):
    want = set()
    for k, x, y in rows[0]:
        least = {}
        for w, _, *ends in rows[1]:
            least[w] = min(least.get(w, math.inf), away(x, y, *ends))
        limit = sorted(least.values())[most - 1] + SLACK if most else math.inf
        want |= {(k, w, round(d, 6)) for w, d in least.items() if d <= min(limit, radius)}
    found = [(r["k"], r["way_id"], round(r["d"], 6)) for r in near_lines(*given(spark, rows), radius, ["k"], [], most=most, once=True).collect()]
    assert len(found) == len(set(found)) and set(found) == want and len({k for k, *_ in want}) < len(rows[0])


@pytest.mark.parametrize("most", [1, 3])
def test_segments_of_the_nearest_ways(spark, rows, most):
    found = near_lines(*given(spark, rows), 150, ["k"], ["way_id", "pos"], most=most).collect()
    told = {}
    for r in found:
        told.setdefault((r["k"], r["way_id"]), {})[r["pos"]] = r["d"]
    for k, x, y in rows[0]:
        each = {}
        for w, p, *ends in rows[1]:
            each.setdefault(w, {})[p] = away(x, y, *ends)
        near = sorted((min(ps.values()), w) for w, ps in each.items())[:most]
        for d, w in near:
            if d <= 150:
                place = min(each[w], key=lambda p: (round(each[w][p], 6), p))
                assert told[k, w][place] == pytest.approx(each[w][place], abs=1e-9)


def test_empty_sides(spark, rows):
    points, segments = given(spark, rows)
    assert not near_lines(points, segments.limit(0), 50, ["k"], []).count() and not near_lines(points.limit(0), segments, 50, ["k"], []).count()


@pytest.mark.parametrize("name, joins", [("topk_near", 0), ("radius_fallback", 0), ("ferry_gate", 1), ("follow_parallel_metrics", 1)])
def test_pairs_are_no_table(spark, data, name, joins):
    """Of the pairs of points and segments only answers are rows: what is joined are tags of ways, or samples and their nearest segment."""
    plan = entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) == joins
