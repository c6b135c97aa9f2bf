"""Readers of geographic features: GeoJSON in its several shapes, area polygons, and records of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathglow.sources.sequences import SPLIT_BYTES, read_records

#: A feature with a point; other geometry keeps its coordinates as text.
FEATURE = "struct<type string, id string, geometry struct<type string, coordinates string>, properties map<string,string>>"
DOCUMENT = "type string, id string, geometry struct<type string, coordinates string>, properties map<string,string>, features array<" + FEATURE + ">"
RECORD_MARK = "\x1e"


def read_features(spark: SparkSession, path: str, mode: str = "lenient", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """ord, place, id, lon, lat, properties of point features; ord is the record's first byte in its file.

    Reads sequences with or without record marks, a feature or collection a line, and whole documents; a sequence is
    read in ranges of ``split_bytes``, a document feature by feature. A byte order mark is ignored. ``strict`` raises on
    anything that is no feature, and on features without id and place; ``lenient`` leaves it out.
    """
    lines = read_records(spark, path, split_bytes).select(F.col("at").alias("ord"), F.col("record").alias("line"))
    lists = F.from_json("line", f"array<{FEATURE}>")
    parsed = lines.withColumn("d", F.from_json("line", DOCUMENT)).withColumn("l", F.when(F.trim("line").startswith("["), lists))
    as_one = F.struct(F.lit("Feature").alias("type"), F.col("d.id").alias("id"), F.col("d.geometry").alias("geometry"), F.col("d.properties").alias("properties"))
    found = F.when(F.col("l").isNotNull(), F.col("l")).when(F.col("d.type") == "FeatureCollection", F.col("d.features")).when(F.col("d.type") == "Feature", F.array(as_one))
    if mode == "strict":
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("not a feature: "), F.substring("line", 1, 60))))
    features = parsed.select("ord", F.posexplode(found).alias("place", "f"))
    at = F.from_json("f.geometry.coordinates", "array<double>")
    p = F.col("f.properties")
    out = features.select(
        "ord", "place", F.coalesce(F.nullif(p["id"], F.lit("")), F.nullif(p["candidate_id"], F.lit("")), F.col("f.id")).alias("id"),
        F.coalesce(F.get(at, F.lit(0)), p["longitude"].try_cast("double")).alias("lon"), F.coalesce(F.get(at, F.lit(1)), p["latitude"].try_cast("double")).alias("lat"), p.alias("properties"),
    )
    if mode == "strict":
        bad = F.col("id").isNull() | F.col("lon").isNull() | F.col("lat").isNull()
        return out.withColumn("id", F.when(bad, F.raise_error(F.lit("feature without id or place"))).otherwise(F.col("id")))
    return out.where("id is not null")


def read_area(spark: SparkSession, path: str) -> DataFrame:
    """part, ring (0 is the outer one), pos, x, y of the polygons of a document; holes are kept, other geometry is not."""
    text = spark.read.text(path, wholetext=True)
    one = F.from_json("value", DOCUMENT)
    bare = F.from_json("value", "type string, coordinates string")
    shapes = F.when(one["type"] == "FeatureCollection", F.transform(one["features"], lambda f: f["geometry"])).when(one["type"] == "Feature", F.array(one["geometry"])).otherwise(F.array(bare))
    g = text.select(F.explode(shapes).alias("g"))
    polygon = F.array(F.from_json("g.coordinates", "array<array<array<double>>>"))
    many = F.from_json("g.coordinates", "array<array<array<array<double>>>>")
    parts = g.select(F.when(F.col("g.type") == "Polygon", polygon).when(F.col("g.type") == "MultiPolygon", many).alias("p")).where("p is not null")
    rings = parts.select(F.posexplode("p").alias("part", "rings")).select("part", F.posexplode("rings").alias("ring", "points"))
    return rings.select("part", "ring", F.posexplode("points").alias("pos", "q")).select("part", "ring", "pos", F.col("q")[0].alias("x"), F.col("q")[1].alias("y"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as text columns, blanks as null; a byte order mark before the first name is dropped."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="", emptyValue="")
    return rows.toDF(*[c.removeprefix("﻿") for c in rows.columns])


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """section, key, value of an INI file; what follows '#' is a comment."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("ord", "line"))
    clean = text.select("ord", F.trim(F.regexp_replace("line", "#.*", "")).alias("line")).where("line <> ''")
    from pyspark.sql import Window

    head = F.regexp_extract("line", r"^\[(.*)\]$", 1)
    # one small file: its lines are numbered within it
    named = clean.withColumn("section", F.last(F.nullif(head, F.lit("")), ignorenulls=True).over(Window.orderBy("ord")))
    return named.where(head == "").select("section", F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.regexp_extract("line", "=(.*)", 1)).alias("value"))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """key and value of lines 'key=value'; the first '=' parts them; blank lines and comments are skipped."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#') and contains(value, '=')")
    return lines.select(F.trim(F.substring_index("value", "=", 1)).alias("key"), F.trim(F.regexp_extract("value", "=(.*)", 1)).alias("value"))


#: What an updater's log tells, and where.
LOG_FIELDS = {"mode": r"mode[:=]\s*(\w+)", "status": r"status[:=]\s*(\w+)", "nodes_before": r"nodes[:=]?\s*(\d+)\s*->", "nodes_after": r"nodes[:=]?\s*\d+\s*->\s*(\d+)", "ways_before": r"ways[:=]?\s*(\d+)\s*->", "ways_after": r"ways[:=]?\s*\d+\s*->\s*(\d+)"}


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The fields that a log tells, null where it does not."""
    text = spark.read.text(path, wholetext=True)
    return text.select(*[F.nullif(F.regexp_extract("value", "(?mi)" + p, 1), F.lit("")).alias(n) for n, p in LOG_FIELDS.items()])


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a known form; those that cannot be read give a row of nulls with the text in _corrupt."""
    return spark.read.schema(schema + ", _corrupt string").json(path, multiLine=True, columnNameOfCorruptRecord="_corrupt")
