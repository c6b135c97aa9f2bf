"""A map extract in one call against plain joins, and the Bloom filters in its scans."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pathglow.functions.tags import is_relevant
from pathglow.operators import bloom
from pathglow.sources import extracts


def test_bloom_filters_lose_nothing_and_let_little_pass(spark):
    rng = random.Random(1)
    for n in (0, 1, 300, 20_000):
        held = rng.sample(range(10**9), n)
        values = spark.createDataFrame([(v,) for v in held] + [(None,), *[(v,) for v in held[:5]]], "v long")
        made = bloom.bloom_filter(values, "v")
        rows = spark.createDataFrame([(v, True) for v in held] + [(v, False) for v in rng.sample(range(10**9, 2 * 10**9), 20_000)] + [(None, None)], "id long, held boolean")
        passed = {r["held"]: r["n"] for r in bloom.may_hold(rows, "id", made).groupBy("held").agg(F.count("*").alias("n")).collect()}
        assert passed.get(True, 0) == n and passed.get(False, 0) < 200
    small = bloom.bloom_filter(values, "v", most_bits=1 << 12)  # too small a filter is still right
    assert small[1] == 1 << 12 and bloom.may_hold(rows, "id", small).where("held").count() == 20_000


def extract_text(rng: random.Random) -> tuple[str, dict]:
    nodes = {i: (round(rng.uniform(2, 3), 6), round(rng.uniform(39, 40), 6)) for i in range(1, 400)}
    tags = [{"highway": "path"}, {"highway": "services"}, {"building": "yes"}, {"leisure": "park"}, {}, {"route": "ferry"}, {"construction": "track"}]
    ways = {i: (rng.choice(tags), [rng.randrange(1, 440) for _ in range(rng.randrange(1, 6))]) for i in range(1000, 1200)}
    relations = {i: (rng.choice(tags), [(rng.choice(["way", "way", "node"]), rng.randrange(1000, 1220), rng.choice(["outer", "inner", ""])) for _ in range(rng.randrange(0, 5))]) for i in range(5000, 5040)}
    kv = lambda t: "".join(f'<tag k="{k}" v="{v}"/>' for k, v in t.items())
    out = ["<osm>"] + [f'<node id="{i}" lat="{la}" lon="{lo}"/>' for i, (lo, la) in nodes.items()] + ['<node id="399999"/>']
    out += [f'<way id="{i}">' + "".join(f'<nd ref="{r}"/>' for r in refs) + kv(t) + "</way>" for i, (t, refs) in ways.items()]
    out += [f'<relation id="{i}">' + "".join(f'<member type="{k}" ref="{r}" role="{o}"/>' for k, r, o in m) + kv(t) + "</relation>" for i, (t, m) in relations.items()]
    return "\n".join([*out, "</osm>"]), {"nodes": nodes, "ways": ways, "relations": relations}


def test_an_extract_like_plain_joins(spark, tmp_path):
    text, plain = extract_text(random.Random(3))
    (tmp_path / "m.xml").write_text(text)
    same = lambda c: c
    got = extracts.read_extract(spark, str(tmp_path / "m.xml"), x=same, y=same)
    wanted = lambda t: t.get("highway") == "path" or t.get("leisure") == "park" or t.get("route") == "ferry" or bool(t.get("construction"))
    relations = {i: m for i, (t, m) in plain["relations"].items() if wanted(t)}
    members = {r for m in relations.values() for k, r, _ in m if k == "way"}
    line = {i: [plain["nodes"][r] for r in refs if r in plain["nodes"]] for i, (_, refs) in plain["ways"].items()}
    ways = {(i, wanted(t)) for i, (t, _) in plain["ways"].items() if (wanted(t) or i in members) and len(line[i]) >= 2}
    found = got.ways.collect()
    assert {(r["way_id"], r["matches"]) for r in found} == ways and len(found) == len(ways)
    assert all([tuple(p) for p in r["coords"]] == line[r["way_id"]] for r in found)
    assert {r["relation_id"] for r in got.relations.collect()} == set(relations)
    expected = sorted((i, pos, role, r) for i, m in relations.items() for pos, (k, r, role) in enumerate(m) if k == "way" and len(line.get(r, [])) >= 2)
    assert sorted((r["relation_id"], r["pos"], r["role"], r["way_id"]) for r in got.lines.collect()) == expected
    outer = sorted((r["relation_id"], r["pos"]) for r in extracts.outer_lines(got.lines).collect())
    has = {i for i, _, role, _ in expected if role != "inner"}
    assert outer == sorted((i, pos) for i, pos, role, _ in expected if role != "inner" or i not in has)


def test_unneeded_nodes_go_before_the_shuffle(spark, tmp_path, monkeypatch):
    """The scan of nodes hands on little more than the nodes of wanted ways."""
    n = 4000
    nodes = "".join(f'<node id="{i}" lat="1" lon="2"/>' for i in range(n))
    ways = "".join(f'<way id="{i}"><nd ref="{i}"/><nd ref="{i + 1}"/>' + ('<tag k="highway" v="path"/>' if i % 100 == 0 else "") + "</way>" for i in range(n - 1))
    (tmp_path / "m.xml").write_text(f"<osm>{nodes}{ways}</osm>")
    seen = []
    monkeypatch.setattr(extracts, "may_hold", lambda rows, column, *a, **k: seen.append((column, bloom.may_hold(rows, column, *a, **k))) or seen[-1][1])
    got = extracts.read_extract(spark, str(tmp_path / "m.xml"))
    assert got.ways.count() == 40 and got.lines.count() == 0
    passed = {column: df.count() for column, df in seen}
    assert passed["way_id"] == 40 and 80 <= passed["node_id"] < 120


def test_areas_of_relations(spark, tmp_path):
    """Two members make the outer ring, an inner one is left out; a relation without an outer member takes all."""
    corners = {1: (0, 0), 2: (0, 1), 3: (1, 1), 4: (1, 0)}
    text = "".join(f'<node id="{i}" lat="{a}" lon="{b}"/>' for i, (a, b) in corners.items())
    text += '<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/></way><way id="11"><nd ref="1"/><nd ref="4"/><nd ref="3"/></way><way id="12"><nd ref="2"/><nd ref="4"/></way>'
    park = '<tag k="type" v="multipolygon"/><tag k="leisure" v="park"/></relation>'
    text += '<relation id="20"><member type="way" ref="10" role="outer"/><member type="way" ref="11" role=""/><member type="way" ref="12" role="inner"/>' + park
    text += '<relation id="21"><member type="way" ref="11" role="inner"/><member type="way" ref="10" role="inner"/>' + park
    (tmp_path / "m.xml").write_text(f"<osm>{text}</osm>")
    found = extracts.relation_areas(extracts.read_extract(spark, str(tmp_path / "m.xml"))).collect()
    assert sorted((r["relation_id"], r["points"], r["closed"], r["tags"]["leisure"]) for r in found) == [(20, 5, True, "park"), (21, 5, True, "park")]


def test_an_empty_extract(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<osm></osm>")
    got = extracts.read_extract(spark, str(tmp_path / "m.xml"), lambda t: is_relevant(lambda k: t[k]))
    assert got.ways.count() == got.relations.count() == got.lines.count() == 0
