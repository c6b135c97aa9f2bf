"""From heat tiles, map and requested area to the candidates to be written: mask, peaks, gates, metrics, rules.

What a tile holds is bounded; ways meet tiles by their boxes, points meet areas and ways by cells. The metrics of the rules are
measured here, on each candidate's own cells: following and running parallel, ferries near by, heat on and beside the way that
runs along, and golf courses that hold it. Nothing is read from a column that stands in for a measurement.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathglow.functions import tags as tag_rules
from pathglow.functions.geo import segment_distance
from pathglow.operators import areas, lateral, metrics, raster
from pathglow.operators.cells import meeting_boxes, near_boxes
from pathglow.operators.labels import output_gate
from pathglow.operators.shared import written

#: Metres in which ways explain a sample, and in which ferries are looked for.
FOLLOW, FERRY = 250.0, 500.0


@dataclass(frozen=True)
class Frame:
    """Where a tile lies in the plane: expressions of the tile for the place of its cell (0, 0), a cell's width, and cells along a side."""

    left: Column
    top: Column
    pixel: float
    side: int


@dataclass(frozen=True)
class Rules:
    """What the detector goes by: least heat, cells that are too few, how far a way explains heat, and the rules that are on."""

    threshold: int = 100
    min_size: int = 3
    distance: float = 35.0
    parallel: bool = True
    ferry: bool = True
    halo: bool = True
    golf: bool = False


KEYS = ["tile", "comp"]
ENDS = ("x1", "y1", "x2", "y2")


def masked(heat: DataFrame, segments: DataFrame, fills: DataFrame, frame: Frame, distance: float) -> DataFrame:
    """``heat`` (tile, r, c, v) without what segments (way_id, x1, y1, x2, y2) explain within ``distance`` and areas (area, edges)
    cover; only tiles with heat meet anything."""
    extent = frame.side * frame.pixel
    tiles = heat.select("tile").distinct().select("tile", frame.left.alias("left"), frame.top.alias("top"))
    boxes = tiles.select("*", F.col("left").alias("tx1"), (F.col("top") - extent).alias("ty1"), (F.col("left") + extent).alias("tx2"), F.col("top").alias("ty2"))
    boxes, theirs = written(boxes, "tile-boxes"), ("tx1", "ty1", "tx2", "ty2")

    def in_tile(rows: DataFrame, pad: float, keep: list[str]) -> DataFrame:
        padded = [(F.least("x1", "x2") - pad).alias("bx1"), (F.least("y1", "y2") - pad).alias("by1"), (F.greatest("x1", "x2") + pad).alias("bx2"), (F.greatest("y1", "y2") + pad).alias("by2")]
        return meeting_boxes(rows.select(*keep, *ENDS, *padded), boxes, extent, ("bx1", "by1", "bx2", "by2"), theirs)

    def to_cells(rows: DataFrame, keep: list[str]) -> DataFrame:
        ends = [((F.col("top") - F.col(f"y{n}")) / frame.pixel).alias(f"r{n}") for n in (1, 2)] + [((F.col(f"x{n}") - F.col("left")) / frame.pixel).alias(f"c{n}") for n in (1, 2)]
        return rows.select("tile", *keep, *ends)

    width = int(2 * round(distance / frame.pixel) + 1)
    left = raster.burn_mask(heat, to_cells(in_tile(segments, distance, []), []), float(width), side=frame.side)
    around = fills.groupBy("area").agg(F.min(F.least("x1", "x2")).alias("x1"), F.min(F.least("y1", "y2")).alias("y1"), F.max(F.greatest("x1", "x2")).alias("x2"), F.max(F.greatest("y1", "y2")).alias("y2"))
    met = in_tile(around, 0.0, ["area"]).select("tile", "left", "top", "area").join(fills.select("area", *ENDS), "area")
    return raster.fill_polygons(left, to_cells(met, ["area"]), frame.side, "area")


def candidates(heat: DataFrame, frame: Frame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """The peaks of masked heat with their places px, py, and their cells (tile, comp, r, c, v)."""
    cells = written(raster.labelled_cells(heat, rules.threshold).where("comp >= 0"), "labelled")
    found = raster.peaks(cells, rules.min_size).select(*KEYS, "r", "c", "peak", "size", "index_in_tile")
    found = written(found.select("*", (frame.left + F.col("c") * frame.pixel).alias("px"), (frame.top - F.col("r") * frame.pixel).alias("py")), "peaks")
    return found, cells.join(found.select(*KEYS), KEYS, "left_semi").select(*KEYS, "r", "c", "v")


def ways_about(found: DataFrame, segments: DataFrame, frame: Frame, pad: float) -> DataFrame:
    """The segments of all ways that come within ``pad`` of a tile with a candidate: whole ways, as tangents and lengths need them."""
    extent = frame.side * frame.pixel
    tiles = found.select("tile").distinct().select(frame.left.alias("left"), frame.top.alias("top"))
    boxes = written(tiles.select((F.col("left") - pad).alias("tx1"), (F.col("top") - extent - pad).alias("ty1"), (F.col("left") + extent + pad).alias("tx2"), (F.col("top") + pad).alias("ty2")), "tile-boxes")
    boxed = segments.select("way_id", F.least("x1", "x2").alias("bx1"), F.least("y1", "y2").alias("by1"), F.greatest("x1", "x2").alias("bx2"), F.greatest("y1", "y2").alias("by2"))
    met = meeting_boxes(boxed, boxes, extent + 2 * pad, ("bx1", "by1", "bx2", "by2"), ("tx1", "ty1", "tx2", "ty2"))
    return written(segments.join(written(met.select("way_id").distinct(), "ways-about"), "way_id", "left_semi"), "segments-about")


def follow(cells: DataFrame, segments: DataFrame, frame: Frame) -> DataFrame:
    """tile, comp and the distribution of the distances and angles of the candidate's samples to the nearest ways."""
    _, samples = lateral.region_samples(cells, frame.left, frame.top, frame.pixel, KEYS)
    near = metrics.nearest_segments(samples.select(*KEYS, "r", "c", "px", "py", "ax", "ay"), segments, FOLLOW, (*KEYS, "r", "c"))
    return metrics.follow_metrics(near.withColumn("key", F.struct(*KEYS)), "key").select("key.*", "d_min", "d_median", "follow50", "follow75", "follow100", "parallel15", "parallel30")


def ferry_distance(found: DataFrame, ferries: DataFrame) -> DataFrame:
    """tile, comp, ferry_dist: the nearest ferry line within ``FERRY`` metres of the peak."""
    boxed = ferries.select(*[F.col(c).alias("s" + c) for c in ENDS], F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"), F.greatest("x1", "x2").alias("x2"), F.greatest("y1", "y2").alias("y2"))
    dist = segment_distance(*(F.col(c) for c in ("px", "py", "sx1", "sy1", "sx2", "sy2")))
    return near_boxes(found.select(*KEYS, "px", "py"), boxed, FERRY, 2 * FERRY).groupBy(*KEYS).agg(F.min(dist).alias("ferry_dist")).where(F.col("ferry_dist") <= FERRY)


def inside_golf(found: DataFrame, cells: DataFrame, courses: DataFrame, frame: Frame) -> DataFrame:
    """tile, comp, golf: whether a golf course (area, edges) holds the peak and at least nine tenths of the cells, and is not crossed."""
    cover = written(areas.covering(courses.select("area", *ENDS), "area"), "courses")
    spots = cells.select(*KEYS, F.lit(False).alias("is_centre"), (frame.left + F.col("c") * frame.pixel).alias("px"), (frame.top - F.col("r") * frame.pixel).alias("py"))
    counted = areas.placed_points(spots, cover, "area", boundary=True).where("inside").groupBy(*KEYS, "area").agg(F.count("*").alias("held"))
    centre = areas.placed_points(found.select(*KEYS, "px", "py"), cover, "area", boundary=True).where("inside").select(*KEYS, "area")
    # a course that holds every cell is one that the candidate does not cross
    whole = counted.join(centre, [*KEYS, "area"]).join(cells.groupBy(*KEYS).agg(F.count("*").alias("n")), KEYS)
    return whole.groupBy(*KEYS).agg(F.bool_or(F.col("held") == F.col("n")).alias("golf"))


def detect(heat: DataFrame, segments: DataFrame, kinds: DataFrame, area_edges: DataFrame, requested: DataFrame, prior: DataFrame, frame: Frame, candidate_id: Column, layer: Column, rules: Rules = Rules()) -> DataFrame:
    """One row for each peak that is large enough and in the requested area, with its metrics, the rules that suppress it and written: whether
    it is to be written.

    ``heat`` (tile, r, c, v), absent cells 0; ``segments`` (way_id, pos, x1, y1, x2, y2) of the ways that explain heat; ``kinds`` (way_id,
    ferry); ``area_edges`` (area, golf, fill, x1, y1, x2, y2); ``requested`` edges (area, x1, y1, x2, y2), no row meaning no limit; ``prior``
    (candidate_id, status). ``candidate_id`` and ``layer`` are expressions of tile, r and c. A metric that cannot be measured suppresses nothing.
    """
    heat, segments = written(heat.select("tile", "r", "c", "v"), "heat"), written(segments, "segments")
    left = masked(heat, segments.select("way_id", *ENDS), area_edges.where("fill").select("area", *ENDS), frame, rules.distance)
    every, cells = candidates(left, frame, rules)
    limits = requested.select(F.lit(1).alias("limit"), "area", *ENDS)
    gated = areas.in_area(every.withColumn("limit", F.lit(1)), limits, "limit").where("in_area").drop("limit", "in_area")
    found = written(gated.withColumn("candidate_id", candidate_id).withColumn("layer", layer), "found")
    cells = written(cells.join(found.select(*KEYS), KEYS, "left_semi"), "found-cells")

    # what the metrics look at: ways that come near a candidate's tile, and the tile's heat
    segments = ways_about(found, segments, frame, max(FOLLOW, FERRY, lateral.SEARCH) + frame.pixel)
    heat = heat.join(found.select("tile").distinct(), "tile", "left_semi")
    along = lateral.lateral_metrics(cells, segments, heat, frame.left, frame.top, frame.pixel, frame.side)
    first = cells.groupBy(*KEYS).agg(F.min(F.struct("r", "c")).alias("f")).select(*KEYS, F.col("f.r").alias("fr"), F.col("f.c").alias("fc"))
    along = along.select("tile", F.col("r").alias("fr"), F.col("c").alias("fc"), F.col("way_id").alias("along_way"), "cover150", "cover250", "votes", "own_p90", "way_p90", "between_median", "between_ratio", "ratio_p90", "halo")
    rows = found.join(follow(cells, segments, frame), KEYS, "left").join(first, KEYS).join(along, ["tile", "fr", "fc"], "left").drop("fr", "fc")
    rows = rows.join(ferry_distance(found, segments.join(kinds.where("ferry").select("way_id"), "way_id", "left_semi")), KEYS, "left")
    rows = rows.join(inside_golf(found, cells, area_edges.where("golf"), frame), KEYS, "left")

    off = F.lit(False)
    rows = rows.withColumn("by_parallel", tag_rules.parallel_rule(F.col("follow100"), F.col("parallel15")) if rules.parallel else off)
    rows = rows.withColumn("by_ferry", tag_rules.ferry_rule(F.col("ferry_dist")) if rules.ferry else off)
    rows = rows.withColumn("by_halo", tag_rules.halo_rule(F.col("between_ratio")) if rules.halo else off)
    rows = rows.withColumn("by_golf", tag_rules.golf_rule(F.col("layer"), F.col("golf")) if rules.golf else off)
    suppressed = F.col("by_parallel") | F.col("by_ferry") | F.col("by_halo") | F.col("by_golf")
    # an id stands for a place in all layers, so it may occur several times
    gate = output_gate(rows.select("candidate_id").distinct(), prior, "candidate_id", F.lit(False))
    kept = gate.groupBy("candidate_id").agg(F.bool_or("warn_done").alias("warn_done"), F.lit(True).alias("open"))
    told = rows.withColumn("suppressed", suppressed).join(kept, "candidate_id", "left")
    return told.withColumn("written", ~F.col("suppressed") & F.coalesce("open", F.lit(False))).drop("open")
