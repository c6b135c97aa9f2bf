"""Readers of map extracts and heat tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathglow.operators.raster import tile_rows

#: Given schemas: with a single child the reader would infer a struct where there must be an array.
TAG = "tag array<struct<_k string, _v string>>"
NODE = f"_id long, _lat double, _lon double, {TAG}"
WAY = f"_id long, nd array<struct<_ref long, _lat double, _lon double>>, {TAG}"
RELATION = f"_id long, member array<struct<_type string, _ref long, _role string, nd array<struct<_lat double, _lon double>>>>, {TAG}"


def _tags(c: str = "tag"):
    """Tags as a map; of repeated keys the first counts."""
    pairs = F.coalesce(c, F.array().cast("array<struct<_k string, _v string>>"))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["_k"]), p["_k"]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["_k"], p["_v"])))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "node").schema(NODE).load(path)
    return rows.select(F.col("_id").alias("node_id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), _tags().alias("tags"))


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """way_id, tags, refs, and coords where the extract carries them inline."""
    rows = spark.read.format("xml").option("rowTag", "way").schema(WAY).load(path)
    inline = F.filter(F.transform("nd", lambda n: F.struct(n["_lon"].alias("x"), n["_lat"].alias("y"))), lambda p: p["x"].isNotNull())
    return rows.select(F.col("_id").alias("way_id"), _tags().alias("tags"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), inline.alias("coords"))


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """relation_id, tags, and members (type, ref, role) in order."""
    rows = spark.read.format("xml").option("rowTag", "relation").schema(RELATION).load(path)
    return rows.select(F.col("_id").alias("relation_id"), _tags().alias("tags"), F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))).alias("members"))


def way_refs(ways: DataFrame) -> DataFrame:
    return ways.select("way_id", F.posexplode("refs").alias("pos", "node_id"))


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """layer, z, x, y, r, c, v, error of PNG tiles kept as .../layer/z/x/y.png; files without bytes are empty tiles."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    cells = tile_rows(files)
    part = lambda i: F.regexp_extract("path", r"([^/]+)/(\d+)/(\d+)/(\d+)\.png$", i)
    return cells.select(part(1).alias("layer"), *[part(i).try_cast("int").alias(n) for i, n in ((2, "z"), (3, "x"), (4, "y"))], "r", "c", "v", "error")
