"""Vertices, and samples against the segments of ways."""

from __future__ import annotations

import math
import random

from helpers import duck_rows, spark_rows
from pathglow.operators import cells, mapdata, metrics
from pathglow.operators.shared import written
from pathglow.plans import catalog, query_spatial
from pathglow.plans.standins import VIEWS, view


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_vertices_are_shuffled_once_and_like_sql(spark, data):
    vertices = view(spark, data, "vertex")
    columns, rows = duck_rows(VIEWS["vertex"].format(lineitem="lineitem"), data)
    assert sorted(vertices.columns) == columns and spark_rows(vertices) == rows
    assert plan(mapdata.segments(vertices)).count("Exchange hashpartitioning") == 1


def test_preferred_radius_makes_the_pairs_once(spark):
    rows = [(1, 10.0), (1, 90.0), (2, 90.0), (2, 120.0), (3, None)]
    found = cells.preferred_radius(spark.createDataFrame(rows, "k int, dist double"), "k", 80)
    assert sorted(map(str, map(tuple, found.where("dist is not null").collect()))) == ["(1, 10.0)", "(2, 120.0)", "(2, 90.0)"]
    assert "Join" not in plan(found)


def test_nearest_segments_near_and_far(spark):
    rng = random.Random(5)
    segments = [(w, p, *(rng.uniform(0, 1500) for _ in range(2))) for w in range(40) for p in range(2)]
    segments = [(w, p, x, y, x + rng.uniform(-90, 90), y + rng.uniform(-90, 90)) for w, p, x, y in segments]
    samples = [(k, rng.uniform(0, 1500), rng.uniform(0, 1500), 1.0, 0.5) for k in range(150)]

    def away(px, py, x1, y1, x2, y2):
        t = max(0, min(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return round(math.hypot(px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1)), 6)

    want = {k: min((away(x, y, *s[2:]), s[0]) for s in segments) for k, x, y, *_ in samples}
    want = {k: v if v[0] <= 150 else (None, None) for k, v in want.items()}
    assert sum(1 for d, _ in want.values() if d is not None and d <= 37.5) and sum(1 for d, _ in want.values() if d is not None and d > 75) and (None, None) in want.values()
    found = metrics.nearest_segments(spark.createDataFrame(samples, "k int, px double, py double, ax double, ay double"), spark.createDataFrame(segments, "way_id int, pos int, x1 double, y1 double, x2 double, y2 double"), 150, ("k",))
    assert {r["k"]: (r["dist"], r["way_id"]) for r in found.collect()} == want


def test_covered_pairs_are_hashed(spark, data):
    """No string is among the sums of pairs of points and shapes, so they are not sorted for them; shapes are made once."""
    found = plan(catalog.QUERIES["area_cover"](spark, data))
    assert "SortAggregate" not in found and "ObjectHashAggregate" not in found


def test_segments_are_written_without_boxes(spark, data, monkeypatch):
    """The table of segments, which is read twice, holds a way and two ends; boxes follow from these."""
    tables = {}
    monkeypatch.setattr(query_spatial, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    query_spatial.nearest_map_object(spark, data)
    assert sorted(tables["segments"].columns) == ["way_id", "x1", "x2", "y1", "y2"] and "Join" not in plan(query_spatial._way_hits(spark, data, segs=tables["segments"], most=1))
