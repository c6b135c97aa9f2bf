from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pathglow.functions import text
from pathglow.sources import features, mapfiles, sinks


def feature(i, lon=1.5, lat=2.5):
    return {"type": "Feature", "geometry": {"type": "Point", "coordinates": [lon, lat]}, "properties": {"id": i, "x": "y"}}


VARIANTS = {
    "marked": "\x1e" + json.dumps({"type": "FeatureCollection", "features": [feature("a")]}) + "\n\x1e" + json.dumps({"type": "FeatureCollection", "features": [feature("b")]}) + "\n",
    "lines": json.dumps(feature("a")) + "\n" + json.dumps(feature("b")) + "\n",
    "document": json.dumps({"type": "FeatureCollection", "features": [feature("a"), feature("b")]}, indent=1),
    "list": json.dumps([feature("a"), feature("b")]),
    "mark of order": "﻿" + json.dumps({"type": "FeatureCollection", "features": [feature("a"), feature("b")]}),
}


@pytest.mark.parametrize("kind", VARIANTS)
def test_feature_variants(spark, tmp_path, kind):
    (tmp_path / "f.json").write_text(VARIANTS[kind])
    rows = features.read_features(spark, str(tmp_path / "f.json")).collect()
    assert sorted((r["id"], r["lon"], r["lat"]) for r in rows) == [("a", 1.5, 2.5), ("b", 1.5, 2.5)]


def test_empty_and_unsupported_features(spark, tmp_path):
    (tmp_path / "e.json").write_text("")
    (tmp_path / "u.json").write_text('{"type": "Topology"}')
    assert features.read_features(spark, str(tmp_path / "e.json")).count() == 0
    assert features.read_features(spark, str(tmp_path / "u.json")).count() == 0
    with pytest.raises(Exception, match="not a feature"):
        features.read_features(spark, str(tmp_path / "u.json"), "strict").collect()


def test_sequence_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("14/1/2/3/4", 1.25, 2.5, 35, None), ("14/1/2/3/5", 1.0, -2.5, 40, 7)], "id string, lon double, lat double, size int, peak int")
    sinks.write_sequence(rows, str(tmp_path / "out"), "lon", "lat", ["id", "size", "peak"])
    back = features.read_features(spark, str(tmp_path / "out"), "strict").orderBy("id").collect()
    assert [(r["id"], r["lon"], r["lat"], r["properties"]["size"], r["properties"]["peak"]) for r in back] == [("14/1/2/3/4", 1.25, 2.5, "35", ""), ("14/1/2/3/5", 1.0, -2.5, "40", "7")]


def test_collection_is_one_document_over_all_files(spark, tmp_path):
    rows = [(f"k{i % 60:02d}", float(i % 60), 2.5, None if i % 3 else i % 60) for i in range(120)] + [(None, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "id string, lon double, lat double, size int").repartition(5)
    for name, own in (("all", df), ("one", df.where("id = 'k07'")), ("none", df.limit(0))):
        sinks.write_collection(own, str(tmp_path / name), "id", "lon", "lat", ["id", "size"])
        found = json.loads("".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*"))))
        ids = [f["properties"]["id"] for f in found["features"]]
        assert found["type"] == "FeatureCollection" and ids == {"all": [f"k{i:02d}" for i in range(60)], "one": ["k07"], "none": []}[name]
        assert all(f["geometry"]["coordinates"] == [int(f["properties"]["id"][1:]), 2.5] for f in found["features"])


def test_area_keeps_holes(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [2, 1], [2, 2], [1, 1]]
    shapes = [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [square, hole]}}, {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0]}}]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": shapes}))
    rows = features.read_area(spark, str(tmp_path / "a.json"))
    assert rows.count() == 5 + 4 + 10 and rows.where("ring = 1").count() == 4


XML = """<osm><node id="1" lat="1.0" lon="2.0"/><node id="2" lat="1.5" lon="2.5"><tag k="name" v="x"/><tag k="name" v="second"/></node>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="99"/><tag k="highway" v="path"/></way><way id="11"><nd ref="2"/></way>
<relation id="20"><member type="way" ref="10" role="outer"/><tag k="type" v="multipolygon"/></relation></osm>"""


def test_map_extract(spark, tmp_path):
    (tmp_path / "m.xml").write_text(XML)
    path = str(tmp_path / "m.xml")
    nodes = {r["node_id"]: (r["lon"], r["lat"], r["tags"]) for r in mapfiles.read_nodes(spark, path).collect()}
    assert nodes == {1: (2.0, 1.0, {}), 2: (2.5, 1.5, {"name": "x"})}
    ways = {r["way_id"]: (r["refs"], r["tags"]) for r in mapfiles.read_ways(spark, path).collect()}
    assert ways == {10: ([1, 2, 99], {"highway": "path"}), 11: ([2], {})}
    relation = mapfiles.read_relations(spark, path).first()
    assert relation["members"][0][:] == ("way", 10, "outer") and relation["tags"] == {"type": "multipolygon"}
    from pathglow.operators import mapdata

    refs = mapfiles.way_refs(mapfiles.read_ways(spark, path))
    plane = mapfiles.read_nodes(spark, path).select("node_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    assert [(r["way_id"], len(r["coords"])) for r in mapdata.assemble_ways(refs, plane).collect()] == [(10, 2)]
    assert [r["node_id"] for r in mapdata.dangling(refs, plane).collect()] == [99]


def test_small_files(spark, tmp_path):
    (tmp_path / "r.conf").write_text("[one]\nname = A B # note\nzoom=14\n\n[two]\nname=C=D\n")
    assert [r[:] for r in features.read_settings(spark, str(tmp_path / "r.conf")).collect()] == [("one", "name", "A B"), ("one", "zoom", "14"), ("two", "name", "C=D")]
    (tmp_path / "s.txt").write_text("# x\n\na=1\nb = c=d\nnothing\n")
    assert [r[:] for r in features.read_state(spark, str(tmp_path / "s.txt")).collect()] == [("a", "1"), ("b", "c=d")]
    (tmp_path / "l.txt").write_text("mode: full\nnodes: 10 -> 12\n")
    log = features.read_log(spark, str(tmp_path / "l.txt")).first()
    assert (log["mode"], log["nodes_before"], log["nodes_after"], log["status"]) == ("full", "10", "12", None)
    (tmp_path / "t.csv").write_text('﻿id,note\n1,"a, ""b"""\n2,\n')
    assert [r[:] for r in features.read_table(spark, str(tmp_path / "t.csv")).collect()] == [("1", 'a, "b"'), ("2", None)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", 1.5), (1, "a", 1.5)], "candidate_id int, x string, y double")
    sinks.write_table(rows, str(tmp_path / "t"), ["y", "candidate_id"])
    assert sorted(map(tuple, features.read_table(spark, str(tmp_path / "t")).collect()), key=str) == [("1.5", "1"), ("1.5", "1"), (None, "2")]
    sinks.write_tasks(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    backups = spark.createDataFrame([("r", f"b{i}", i) for i in range(5)], "region string, name string, made_at int")
    assert {r["name"] for r in sinks.backups_to_drop(backups).collect()} == {"b0", "b1"}


def test_status_spellings(spark):
    issue = ["2", "Not_An_Issue", "Not_an_Issue", "false_positive", "not-an issue"]
    other = ["1", "5", "6", "3", "0", "Fixed", "Already_Fixed", "Too_Hard", "Skipped", "Created", "", None]
    df = spark.createDataFrame([(s,) for s in issue + other], "s string").select(text.is_not_an_issue(F.col("s")).alias("x"), text.canonical_status(F.col("s")).alias("c"))
    got = df.collect()
    assert [r["x"] for r in got] == [True] * 5 + [False] * 12
    assert [r["c"] for r in got][5:8] == ["Fixed", "Already_Fixed", "Too_Hard"]


def test_annotate(spark):
    row = spark.range(1).select(text.annotate(F.create_map(F.lit("id"), F.lit("a"), F.lit("layer"), F.lit("old")), {"id": F.lit("z"), "kind": F.lit("k")}, {"layer": F.lit("new")}).alias("m")).first()
    assert row["m"] == {"id": "a", "kind": "k", "layer": "new"}


def test_formats(spark):
    one = spark.range(1)
    f = lambda c: one.select(c).first()[0]
    assert [f(text.fixed_digits(F.lit(v), 3)) for v in (1.5, 2.0, -0.0001, 10.0, 0.12345)] == ["1.5", "2", "0", "10", "0.123"]
    assert f(text.percent(F.lit(1), F.lit(8))) == "12.5%" and f(text.percent(F.lit(1), F.lit(0))) == ""
    assert f(text.duration(F.lit(3725))) == "01:02:05"
    assert [f(text.infer_layer(F.lit(n))) for n in ("Mallorca Ride", "x run y", "an all", "x api test ride", "none")] == ["ride", "run", "all", None, None]


def test_task_names_and_boundary_text(spark):
    from pathglow.operators.mapdata import read_ring_text

    tasks = ['{"name": " a "}', '{"taskName": "b"}', '{"geometries": {"features": [{"properties": {"x": "1"}}, {"properties": {"candidate_id": "c", "name": "d"}}]}}', '{"geometries": [{"properties": {"id": "e"}}]}', "{}", "broken"]
    df = spark.createDataFrame([(t,) for t in tasks], "t string")
    assert [r[0] for r in df.select(text.task_candidate_id(F.col("t"))).collect()] == ["a", "b", "c", "e", None, None]
    ring = spark.range(1).select(read_ring_text(F.lit("name\n1\n   2.5  39.5\n   2.6E+00 39.6\nEND\nEND\n"))).first()[0]
    assert ring == [[2.5, 39.5], [2.6, 39.6]]


def test_reasons_follow_categories(spark):
    from pathglow.functions import tags

    df = spark.createDataFrame([("close_to_existing_osm", 12.5, None), ("other", None, 0.25)], "category string, peak_dist double, follow100 double")
    df = df.withColumn("tunnel", F.lit("yes"))
    for c in ("parallel15", "parallel30", "ferry_dist", "constr_dist"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    got = [r[0] for r in df.select(tags.remaining_reason(F.col("category"))).collect()]
    assert got == ["peak_dist=12.5", "peak_dist=, follow100=0.25, parallel15="]
