"""Open areas near candidates, class by class: within a near radius, else within a far one, else the nearest of all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathglow.functions.geo import crosses_ray
from pathglow.operators.areas import BOUNDARY, EDGE
from pathglow.operators.cells import near_boxes, nearest_of_all
from pathglow.operators.shared import written

#: How far the boxes of areas are looked for, and how near a line still holds a point.
NEAR, FAR, LINE_EPS = 250.0, 2000.0, 1.0


def area_shapes(edges: DataFrame, area: str = "area", area_class: str = "area_class") -> DataFrame:
    """One row an area: its class, box, edges, and whether they close, from edges (area, area_class, x1, y1, x2, y2).

    An area's edges are one value, as its geometry is; that they close is told by every corner being met an even number of times.
    """
    ends = edges.select(area, F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    closed = ends.groupBy(area, "p").agg((F.count("*") % 2 == 0).alias("even")).groupBy(area).agg(F.bool_and("even").alias("closed"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    shapes = edges.groupBy(area, area_class).agg(
        F.min(F.least("x1", "x2")).alias("x1"), F.min(F.least("y1", "y2")).alias("y1"), F.max(F.greatest("x1", "x2")).alias("x2"), F.max(F.greatest("y1", "y2")).alias("y2"),
        F.collect_list(F.struct(*EDGE, dx.alias("dx"), dy.alias("dy"), (dx * dx + dy * dy).alias("length"))).alias("edges"),
    )
    return written(shapes.join(closed, area), "area-shapes")


def edge_distance(px: Column, py: Column) -> Column:
    """Distance of a point from an area's edges. An edge's place nearest to the point is found once, and one root is taken in all."""
    def nearest_place(e: Column) -> Column:
        t = F.when(e["length"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - e["x1"]) * e["dx"] + (py - e["y1"]) * e["dy"]) / e["length"]))).otherwise(0.0)
        return F.struct(t.alias("t"), e.alias("e"))

    def away(p: Column) -> Column:
        e = p["e"]
        return F.struct((px - (e["x1"] + p["t"] * e["dx"])).alias("x"), (py - (e["y1"] + p["t"] * e["dy"])).alias("y"))

    squares = F.transform(F.transform(F.transform("edges", nearest_place), away), lambda d: d["x"] * d["x"] + d["y"] * d["y"])
    return F.sqrt(F.array_min(squares))


def to_area(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Adds dist, a point's distance from an area's edges, 0 inside, and inside, whether the area holds it; both are decided in the row.

    The functions over edges are interpreted, so each is called once a pair: what follows from them reads their columns.
    """
    px, py = F.col(x), F.col(y)
    odd = F.size(F.filter("edges", lambda e: crosses_ray(px, py, *[e[c] for c in EDGE]))) % 2 == 1
    told = pairs.withColumn("_d", edge_distance(px, py)).withColumn("_odd", F.col("closed") & odd).drop("edges")
    inside = F.when(F.col("closed"), F.col("_odd") | (F.col("_d") <= BOUNDARY)).otherwise(F.col("_d") <= LINE_EPS)
    told = told.withColumn("inside", inside)
    return told.withColumn("dist", F.round(F.when(F.col("closed") & F.col("inside"), 0.0).otherwise(F.col("_d")), 6)).drop("_d", "_odd")


def _best(pairs: DataFrame, keys: Sequence[str], area: str, x: str, y: str) -> DataFrame:
    """Of each key's areas one that holds the point, else the nearest; equal ones by the least area."""
    met = to_area(pairs, x, y)
    order = F.struct((~F.col("inside")).alias("out"), "dist", area)
    return met.groupBy(*keys).agg(F.min_by(F.struct(area, "dist", "inside"), order).alias("b")).select(*keys, f"b.{area}", "b.dist", "b.inside")


def _spread(points: DataFrame, key: str) -> DataFrame:
    """Points dealt by key over all tasks: their pairs, many more, are then made and grouped where the point is."""
    return points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def nearest_by_class(points: DataFrame, shapes: DataFrame, classes: Sequence[str], key: str, x: str = "px", y: str = "py", radii: Sequence[float] = (NEAR, FAR)) -> DataFrame:
    """key, area_class, area, dist, inside and radius: for each class the best area whose box lies within the first radius that has any.

    Points and classes that found none within a radius try the next; those that find none at all have no row. A point's
    classes are looked for together: one join by cells a radius.
    """
    listed = F.array(*map(F.lit, classes))
    todo = written(points.select(key, F.col(x).alias(x), F.col(y).alias(y)).withColumn("wanted", listed), "wanted")
    shapes, out = shapes.where(F.col("area_class").isin(*classes)), None
    for radius in radii:
        pairs = near_boxes(_spread(todo, key), shapes, radius, 2 * radius, x, y).where(F.array_contains("wanted", F.col("area_class")))
        found = written(_best(pairs, [key, "area_class"], "area", x, y).withColumn("radius", F.lit(float(radius))), "class-areas")
        out = found if out is None else out.unionByName(found)
        if radius != radii[-1]:
            has = found.groupBy(key).agg(F.collect_set("area_class").alias("has"))
            left = F.array_except("wanted", F.coalesce("has", F.array().cast("array<string>")))
            todo = written(todo.join(has, key, "left").select(key, x, y, left.alias("wanted")).where(F.size("wanted") > 0), "wanted")
    return out


def nearest_of_any(points: DataFrame, shapes: DataFrame, key: str, x: str = "px", y: str = "py", radius: float = NEAR) -> DataFrame:
    """key, area, dist, inside and radius: the best area of any class whose box lies within ``radius``, else the nearest of
    all, whose radius is null. Only without areas, or without a place, a point has none."""
    near = written(_best(near_boxes(_spread(points.select(key, x, y), key), shapes, radius, 2 * radius, x, y), [key], "area", x, y).withColumn("radius", F.lit(float(radius))), "near-areas")
    todo = points.select(key, x, y).join(near.select(key), key, "left_anti")
    # a point inside an area has it within the radius: what is far holds none, and its distance is that to the edges
    far = nearest_of_all(todo, shapes, key, "area", F.round(edge_distance(F.col(x), F.col(y)), 6), radius, x, y)
    return near.unionByName(far.select(key, "area", "dist", F.lit(False).alias("inside"), F.lit(None).cast("double").alias("radius")))
