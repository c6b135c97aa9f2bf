"""Assembling map geometry from nodes, ways and relations, and checks of map extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble_ways(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id and coords in the order of ``refs`` (way_id, pos, node_id); missing nodes are left out, short ways go."""
    met = refs.join(nodes.select("node_id", "x", "y"), "node_id")
    listed = met.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    return listed.where(F.size("p") >= 2).select("way_id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("coords"))


def envelope(coords: Column, pad: float = 0.01) -> list[Column]:
    """Bounds of coordinates, padded where they have no extent."""
    xs, ys = F.transform(coords, lambda p: p["x"]), F.transform(coords, lambda p: p["y"])
    a, b, c, d = F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
    px, py = F.when(a == c, pad).otherwise(0.0), F.when(b == d, pad).otherwise(0.0)
    return [(a - px).alias("x1"), (b - py).alias("y1"), (c + px).alias("x2"), (d + py).alias("y2")]


def segments(vertices: DataFrame, key: str = "way_id") -> DataFrame:
    """Consecutive vertices as segments, keeping the place of the first."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("pos")
    pairs = vertices.select(key, "pos", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return pairs.where("x2 is not null")


def dangling(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    return refs.join(nodes.select("node_id"), "node_id", "left_anti")


def relations_in_box(members: DataFrame, envelopes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Relations of which a member way meets the box, with how many do."""
    a, b, c, d = box
    meets = (F.col("x1") <= c) & (F.col("x2") >= a) & (F.col("y1") <= d) & (F.col("y2") >= b)
    return members.join(envelopes, "way_id").groupBy("relation_id").agg(F.count_if(meets).alias("inside"), F.count("*").alias("known")).where("inside > 0")


def merge_roots(elements: DataFrame, key: list[str], order: str) -> DataFrame:
    """Elements of several batches, the first of each id."""
    others = [c for c in elements.columns if c not in key]
    return elements.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in others])


def union_members(members: DataFrame, order: list[str]) -> DataFrame:
    """Members (relation_id, type, ref, role) of a relation that several batches brought, each once, at its first place."""
    first = F.min(F.struct(*order)).alias("_at")
    return members.groupBy("relation_id", "type", "ref", "role").agg(first).select("relation_id", "type", "ref", "role", "_at.*")


def shape_of(coords: Column) -> Column:
    """A closed line of four points or more is a polygon, any other a line."""
    closed = (F.size(coords) >= 4) & (F.element_at(coords, 1) == F.element_at(coords, -1))
    return F.when(closed, "polygon").otherwise("line")


def coordinate_extent(geometry: Column) -> list[Column]:
    """Bounds of all positions in a geometry's text, however deep they are nested."""
    number = r"-?[0-9.]+(?:[eE][-+]?[0-9]+)?"
    xs = F.regexp_extract_all(geometry, F.lit(rf"\[\s*({number})\s*,"), F.lit(1))
    ys = F.regexp_extract_all(geometry, F.lit(rf"\[\s*{number}\s*,\s*({number})"), F.lit(1))
    xs, ys = (F.transform(v, lambda n: n.cast("double")) for v in (xs, ys))
    return [F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")]


def tiles_of_area(x1: int, y1: int, x2: int, y2: int, spark, offset: int | None = None) -> DataFrame:
    """Tiles of a range, x ascending and y descending; an offset 0 to 3 keeps one of each 2 x 2."""
    xs = spark.range(x1, x2 + 1).select(F.col("id").alias("x"))
    out = xs.withColumn("y", F.explode(F.sequence(F.lit(y2), F.lit(y1), F.lit(-1)).cast("array<bigint>")))
    return out if offset is None else out.where((F.col("x") % 2 == offset % 2) & (F.col("y") % 2 == offset // 2))


def extract_checks(counts: DataFrame) -> DataFrame:
    """Verdict on extracts (objects, before, bytes, dangling): failures first, then warnings."""
    growth = F.col("objects") / F.nullif(F.col("before"), F.lit(0))
    verdict = F.when(F.col("dangling") > 0, "dangling").when(F.col("bytes") < 1, "empty").when(growth > 3, "grew too much").when(growth > 1.5, "warn: grew").otherwise("ok")
    return counts.withColumn("growth", F.round(growth, 4)).withColumn("verdict", verdict)


def is_current(source_etag: Column, stamp_etag: Column, source_size: Column, stamp_size: Column, source_time: Column, stamp_time: Column) -> Column:
    """Whether a stamp describes the source: equal tags, or else equal size and no newer time."""
    by_time = (source_size == stamp_size) & (source_time <= stamp_time)
    return F.when(source_etag.isNotNull() & stamp_etag.isNotNull(), source_etag == stamp_etag).otherwise(F.coalesce(by_time, F.lit(False)))


def tile_percentiles(heat: DataFrame, key: str = "tile") -> DataFrame:
    """Percentiles of the positive values of each tile, from the 10th to the 99th."""
    steps = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    q = heat.where("v > 0").groupBy(key).agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, steps))).alias("q"))
    return q.select(key, "n", *[F.round(F.col("q")[i], 6).alias(f"p{round(100 * s)}") for i, s in enumerate(steps)])


def advance(current: DataFrame, diffs: DataFrame) -> DataFrame:
    """For each region the diffs (sequence, made_at) that are newer than its state; an older one never takes it back."""
    return diffs.join(current, "region", "left").where(F.col("state_at").isNull() | (F.col("made_at") > F.col("state_at"))).groupBy("region").agg(F.count("*").alias("applied"), F.max("sequence").alias("sequence"), F.max("made_at").alias("state_at"))


def read_ring_text(text: Column) -> Column:
    """Points of a plain boundary file: lines of two numbers between a name and END."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s+[-+0-9.Ee]+\s+[-+0-9.Ee]+\s*$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda n: n.cast("double")))
