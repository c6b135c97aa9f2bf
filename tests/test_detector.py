"""The detector from files to written candidates, and its parts on plain tables."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathglow.functions import geo
from pathglow.operators import detector, mapdata
from pathglow.operators.detector import Rules
from pathglow.plans import catalog
from pathglow.plans.detection import detect_files, tile_frame
from pathglow.plans.standins import view
from pathglow.sources.features import read_features

SIDE, X, Y = 64, 8300, 6200


def png(grid: np.ndarray) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in grid)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", grid.shape[1], grid.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """A tile with seven traces: one on a way, one that nothing explains, one beside a hot way, one by a ferry, one on a golf course, one
    outside the requested area, one on a pitch, and one that is too small; and a damaged tile."""
    root = tmp_path_factory.mktemp("detector")
    grid = np.zeros((SIDE, SIDE), np.uint8)
    grid[5:7, 5:25] = 200  # on the way at row 5
    grid[20:22, 5:25] = 180  # unexplained
    grid[45:57, 40:46] = 150  # by the ferry
    grid[30:33, 50:60] = 170  # on the golf course
    grid[60:63, 2:9] = 160  # outside the requested area
    grid[40:43, 5:12] = 190  # on the pitch
    grid[10, 50:52] = 220  # too small
    grid[14:16, 40:60] = 140  # unexplained, and settled by a task
    for layer in ("all", "ride"):
        folder = root / "tiles" / layer / "14" / str(X)
        folder.mkdir(parents=True)
        (folder / f"{Y}.png").write_bytes(png(grid))
    (root / "tiles" / "all" / "14" / str(X) / f"{Y + 1}.png").write_bytes(b"no png")
    frame = tile_frame(14, SIDE)
    tile = F.struct(F.lit("all").alias("layer"), F.lit(14).alias("z"), F.lit(X).alias("x"), F.lit(Y).alias("y"))
    left, top = spark.range(1).select(tile.alias("tile")).select(frame.left, frame.top).first()

    def lonlat(r: float, c: float) -> tuple[float, float]:
        return spark.range(1).select(geo.x_to_lon(F.lit(left + c * frame.pixel)), geo.y_to_lat(F.lit(top - r * frame.pixel))).first()

    lines = {  # way: tags and places (row, column)
        10: ({"highway": "path"}, [(5.5, 0), (5.5, 30)]), 11: ({"route": "ferry"}, [(50, 50), (63, 63)]), 12: ({"highway": "track"}, [(24, 0), (24, 30)]), 13: ({"highway": "services"}, [(20, 0), (20, 30)]),
        20: ({"leisure": "golf_course"}, [(27, 46), (27, 63), (36, 63), (36, 46), (27, 46)]), 21: ({"leisure": "pitch"}, [(38, 3), (38, 14), (45, 14), (45, 3), (38, 3)]),
    }
    nodes, ways, n = [], [], 0
    for way, (tags, places) in lines.items():
        refs = []
        for r, c in places:
            n += 1
            lon, lat = lonlat(r, c)
            nodes.append(f'<node id="{n}" lat="{lat!r}" lon="{lon!r}"/>')
            refs.append(f'<nd ref="{n}"/>')
        ways.append(f'<way id="{way}">' + "".join(refs) + "".join(f'<tag k="{k}" v="{v}"/>' for k, v in tags.items()) + "</way>")
    (root / "map.xml").write_text("<osm>" + "".join(nodes + ways) + "</osm>")
    corner = [lonlat(*p) for p in ((-5, -5), (-5, 70), (58, 70), (58, -5))]
    (root / "area.json").write_text(json.dumps({"type": "Polygon", "coordinates": [[list(p) for p in [*corner, corner[0]]]]}))
    return root, frame.pixel


def name(r: int, c: int) -> str:
    return f"14/{X}/{Y}/{r}/{c}"


def test_from_files_to_written_candidates(spark, files):
    root, pixel = files
    free, ferry, golf, settled = name(20, 5), name(45, 40), name(30, 50), name(14, 40)
    prior = spark.createDataFrame([(settled, "Not_An_Issue"), (golf, "Fixed"), (name(9, 9), "Fixed")], "candidate_id string, status string")
    rows = detect_files(spark, str(root / "tiles"), str(root / "map.xml"), str(root / "area.json"), str(root / "out"), prior, side=SIDE, rules=Rules(distance=pixel, golf=True)).collect()
    by = {(r["layer"], r["candidate_id"]): r for r in rows}
    assert {k for _, k in by} == {free, ferry, golf, settled} and len(rows) == 8  # explained, filled, outside and small ones are none
    assert by["all", free]["size"] == 40 and by["all", free]["maximum"] == 180 and by["all", free]["written"]
    assert by["all", ferry]["by_ferry"] and not by["all", ferry]["written"] and 400 < by["all", ferry]["ferry_dist"] <= 500
    assert by["all", golf]["by_golf"] and not by["ride", golf]["by_golf"] and by["ride", golf]["written"] and by["ride", golf]["warn_done"]
    assert not by["all", settled]["suppressed"] and not by["all", settled]["written"]
    # metrics are measured on the candidate's own cells: the track runs along three cells below, no heat on it or in between
    f = by["all", free]
    assert f["d_min"] == pytest.approx(3 * pixel, rel=1e-5) and f["parallel15"] == 1.0 and f["follow100"] == 0.0 and not f["by_parallel"]
    assert f["along_way"] == 12 and f["way_p90"] == 0.0 and f["between_ratio"] is not None and f["by_halo"] == (f["between_ratio"] >= 1)
    assert by["all", settled]["d_min"] is None and by["all", settled]["along_way"] is None
    back = read_features(spark, str(root / "out"), "strict").collect()
    assert sorted((r["properties"]["layer"], r["id"]) for r in back) == sorted([("all", free), ("ride", free), ("ride", golf)])
    shown = next(r for r in back if r["id"] == free)
    assert abs(shown["lon"] - f["lon"]) < 1e-9 and shown["properties"]["threshold"] == "100"


def test_metrics_look_at_ways_about_candidates_only(spark):
    """Of a map the metrics read the ways that come near a candidate's tile, and these whole."""
    frame = detector.Frame(F.col("tile") * 100.0, F.lit(50.0), 5.0, 10)
    found = spark.createDataFrame([(3, 7), (3, 8)], "tile int, comp long")  # the square 300 to 350, 0 to 50
    rows = [(1, 0, 0.0, 0.0, 285.0, 0.0), (1, 1, 285.0, 0.0, 292.0, 5.0), (2, 0, 0.0, 0.0, 280.0, 0.0), (3, 0, 361.0, 20.0, 400.0, 20.0), (4, 0, 250.0, 55.0, 400.0, 58.0), (5, 0, 250.0, 61.0, 400.0, 62.0), (6, 0, 310.0, 10.0, 310.0, 10.0)]
    segments = spark.createDataFrame(rows, "way_id long, pos int, x1 double, y1 double, x2 double, y2 double")
    about = detector.ways_about(found, segments, frame, 10.0).collect()
    assert sorted(map(tuple, about)) == [r for r in rows if r[0] in (1, 4, 6)]


def test_the_detector_hands_its_metrics_near_ways(spark, data, monkeypatch):
    seen = {}
    monkeypatch.setattr(detector.lateral, "lateral_metrics", lambda cells, segments, heat, *a, f=detector.lateral.lateral_metrics: seen.update(segments=segments, heat=heat) or f(cells, segments, heat, *a))
    found = catalog.QUERIES["detected_candidates"](spark, data)
    assert seen["segments"].count() < mapdata.segments(view(spark, data, "vertex")).count()
    assert seen["heat"].select("tile").distinct().count() == found.select("tile").distinct().count()
