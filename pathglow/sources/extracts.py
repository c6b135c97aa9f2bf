"""A map extract in one call: relations, then the ways that count or belong to one, then the nodes that these need.

Three scans follow one another, each told by the one before what is needed: ids go as Bloom filters into the scans of ways and
nodes, which drop nearly all that nobody needs before anything is shuffled; exact joins follow. So a region's extract is read with
shuffles the size of what explains heat in it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathglow.functions.geo import lat_to_y, lon_to_x
from pathglow.functions.tags import is_relevant, open_area_class
from pathglow.operators.bloom import bloom_filter, may_hold
from pathglow.operators.mapdata import assemble_ways
from pathglow.operators.rings import merge_rings
from pathglow.operators.shared import written
from pathglow.sources.mapfiles import read_nodes, read_relations, read_ways, way_refs


@dataclass(frozen=True)
class Extract:
    """ways: way_id, tags, coords, and matches (false for those that only a relation needs); relations: relation_id, tags; lines:
    relation_id, pos, role, way_id, coords, the member ways of relations in order."""

    ways: DataFrame
    relations: DataFrame
    lines: DataFrame


def explains_heat(tags: Column) -> Column:
    """Whether an object's tags make it a way or an area that candidates are compared with."""

    def tag(key: str) -> Column:
        return tags[key]

    return is_relevant(tag) | open_area_class(tag).isNotNull() | F.coalesce(tag("construction") != "", F.lit(False))


def read_extract(spark: SparkSession, path: str, wanted: Callable[[Column], Column] = explains_heat, x: Callable[[Column], Column] = lon_to_x, y: Callable[[Column], Column] = lat_to_y) -> Extract:
    """The objects of an XML extract that ``wanted`` says yes to, with their points in the plane.

    Missing nodes are left out of lines, and lines of fewer than two points go; so do members that the extract lacks.
    Elements are taken to be distinct, as ``mapdata.merge_roots`` makes them.
    """
    relations = written(read_relations(spark, path).where(wanted(F.col("tags"))), "relations")
    members = relations.select("relation_id", F.posexplode("members").alias("pos", "m")).where("m.type = 'way'").select("relation_id", "pos", "m.role", F.col("m.ref").alias("way_id"))
    needed = members.select("way_id")

    ways = read_ways(spark, path).select("way_id", "tags", "refs", F.coalesce(wanted(F.col("tags")), F.lit(False)).alias("matches"))
    ways = may_hold(ways, "way_id", bloom_filter(needed, "way_id"), besides=F.col("matches"))
    exact = needed.distinct().withColumn("member", F.lit(True))
    kept = written(ways.join(exact, "way_id", "left").where("matches or member").drop("member"), "ways")

    refs = way_refs(kept)
    nodes = may_hold(read_nodes(spark, path).select("node_id", "lon", "lat"), "node_id", bloom_filter(refs, "node_id"))
    placed = nodes.where("lon is not null and lat is not null").select("node_id", x(F.col("lon")).alias("x"), y(F.col("lat")).alias("y"))
    lines = written(assemble_ways(refs, placed), "way-lines")
    whole = kept.select("way_id", "tags", "matches").join(lines, "way_id")
    return Extract(whole, relations.select("relation_id", "tags"), members.join(lines, "way_id").select("relation_id", "pos", "role", "way_id", "coords"))


def outer_lines(lines: DataFrame) -> DataFrame:
    """The outer member lines of each relation, those without a role among them; all lines of a relation that has none of these."""
    outer = F.col("role").isin("outer", "")
    has = lines.groupBy("relation_id").agg(F.bool_or(F.coalesce(outer, F.lit(False))).alias("_has"))
    return lines.join(has, "relation_id").where(~F.col("_has") | F.coalesce(outer, F.lit(False))).drop("_has")


def relation_areas(extract: Extract) -> DataFrame:
    """relation_id, tags, ring, points, closed, xs, ys: the outer rings of the relations."""
    lines = outer_lines(extract.lines).select("relation_id", "pos", F.transform("coords", lambda p: p["x"]).alias("xs"), F.transform("coords", lambda p: p["y"]).alias("ys"))
    return merge_rings(lines).join(extract.relations, "relation_id").select("relation_id", "tags", "ring", "points", "closed", "xs", "ys")
