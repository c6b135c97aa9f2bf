"""The detector over files: heat tiles, a map extract and a requested area in, a sequence of candidates out."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathglow.functions.geo import MERCATOR_RADIUS, lat_to_y, lon_to_x, x_to_lon, y_to_lat
from pathglow.functions.tags import open_area_class
from pathglow.functions.text import candidate_id
from pathglow.operators.areas import ring_edges
from pathglow.operators.detector import Frame, Rules, detect
from pathglow.operators.mapdata import segments, shape_of
from pathglow.operators.shared import written
from pathglow.sources.extracts import Extract, read_extract, relation_areas
from pathglow.sources.features import read_area
from pathglow.sources.mapfiles import read_tiles
from pathglow.sources.sinks import write_sequence

PROPERTIES = ["id", "layer", "size", "maximum", "threshold"]


def tile_frame(zoom: int, side: int) -> Frame:
    """The frame of map tiles of a zoom; tile is struct (layer, z, x, y)."""
    whole = 2 * math.pi * MERCATOR_RADIUS
    extent = whole / (1 << zoom)
    return Frame(F.col("tile.x") * F.lit(extent) - whole / 2, F.lit(whole / 2) - F.col("tile.y") * F.lit(extent), extent / side, side)


def extract_segments(extract: Extract) -> tuple[DataFrame, DataFrame]:
    """Segments of the ways that match, and which ways are ferries. Lines that only a relation needs explain heat by its area."""
    ways = extract.ways.where("matches")
    vertices = ways.select("way_id", F.posexplode("coords").alias("pos", "p")).select("way_id", "pos", "p.x", "p.y")
    return segments(vertices), ways.select("way_id", (F.coalesce(F.col("tags")["route"], F.lit("")) == "ferry").alias("ferry"))


def extract_areas(extract: Extract) -> DataFrame:
    """area, golf, fill, x1, y1, x2, y2: closed ways and rings of relations that are open areas; they are filled in masks if
    they count as areas that explain heat, and are looked at as golf courses."""
    kind = open_area_class(lambda k: F.col("tags")[k])
    closed = extract.ways.where("matches").where(shape_of(F.col("coords")) == "polygon")
    own = closed.select(F.concat(F.lit("w"), "way_id").alias("area"), "tags", F.transform("coords", lambda p: p["x"]).alias("xs"), F.transform("coords", lambda p: p["y"]).alias("ys"))
    rings = relation_areas(extract).where("closed").select(F.concat_ws("/", F.concat(F.lit("r"), "relation_id"), "ring").alias("area"), "tags", "xs", "ys")
    both = own.unionByName(rings).where(kind.isNotNull()).select("area", kind.alias("kind"), F.posexplode(F.arrays_zip("xs", "ys")).alias("pos", "p"))
    edges = ring_edges(both.select("area", "kind", F.lit(0).alias("part"), F.lit(0).alias("ring"), "pos", F.col("p.xs").alias("x"), F.col("p.ys").alias("y")), ["area", "kind"])
    return edges.select("area", (F.col("kind") == "golf_course").alias("golf"), F.col("kind").isin("pitch", "sports_centre").alias("fill"), "x1", "y1", "x2", "y2")


def requested_edges(spark: SparkSession, path: str | None) -> DataFrame:
    """The requested area's edges in the plane; none without a path, and so no limit."""
    if path is None:
        return spark.createDataFrame([], "area string, x1 double, y1 double, x2 double, y2 double")
    rings = read_area(spark, path).withColumn("area", F.lit("requested"))
    return ring_edges(rings.withColumn("x", lon_to_x(F.col("x"))).withColumn("y", lat_to_y(F.col("y"))), ["area"])


def detect_files(spark: SparkSession, tiles: str, extract: str, area: str | None, out: str, prior: DataFrame | None = None, zoom: int = 14, side: int = 512, rules: Rules = Rules()) -> DataFrame:
    """Writes the sequence of candidates to ``out`` and returns all of them with their metrics and verdicts.

    Damaged tiles are left out. The written features carry id, layer, size, maximum and threshold.
    """
    heat = read_tiles(spark, tiles).where(f"error is null and z = {zoom}").select(F.struct("layer", "z", "x", "y").alias("tile"), "r", "c", "v")
    objects = read_extract(spark, extract)
    lines, kinds = extract_segments(objects)
    settled = prior if prior is not None else spark.createDataFrame([], "candidate_id string, status string")
    name = candidate_id(F.col("tile.z"), F.col("tile.x"), F.col("tile.y"), F.col("r"), F.col("c"))
    found = detect(heat, lines, kinds, extract_areas(objects), requested_edges(spark, area), settled, tile_frame(zoom, side), name, F.col("tile.layer"), rules)
    placed = found.withColumn("lon", x_to_lon(F.col("px"))).withColumn("lat", y_to_lat(F.col("py")))
    placed = written(placed.withColumnRenamed("peak", "maximum").withColumn("threshold", F.lit(rules.threshold)).withColumn("id", F.col("candidate_id")), "detected")
    write_sequence(placed.where("written").orderBy("id"), out, "lon", "lat", PROPERTIES)
    return placed
