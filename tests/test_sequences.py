"""The splittable source of feature sequences."""

from __future__ import annotations

import io
import json
import random
import re

import pyarrow as pa
import pytest

from pathglow.sources import features, sequences


class Bytes(io.BytesIO):
    pass


def plain_records(data: bytes) -> list[tuple[int, bytes]]:
    return [(m.start(), m[0]) for m in re.finditer(rb"[^\n\x1e]+", data)]


@pytest.mark.parametrize("seed", range(6))
def test_ranges_of_any_size_own_each_record_once(seed, monkeypatch):
    rng = random.Random(seed)
    data = b"".join(rng.choice([b"\n", b"\x1e", b"\x1e\n", b"", b"ab", b"{}", b"\xc3\xa9" * rng.randrange(9)]) for _ in range(rng.randrange(200)))
    monkeypatch.setattr(sequences, "READ_BYTES", rng.choice([1, 2, 7, 1 << 20]))
    for step in (1, 2, 5, 17, 1000):
        got = [r for a in range(0, len(data), step) for r in sequences.records(Bytes(data), a, min(a + step, len(data)))]
        assert got == plain_records(data)


@pytest.mark.parametrize("read", [1, 3, 64, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_documents_feature_by_feature(monkeypatch, read, indent):
    monkeypatch.setattr(sequences, "READ_BYTES", read)
    odd = {"type": "Feature", "properties": {"name": 'a "quoted" \\ {brace} [', "features": [1, {"x": 2}]}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    several = [odd, {"type": "Feature", "properties": {}, "geometry": None}, odd]
    for document, expected in (
        ({"type": "FeatureCollection", "bbox": [0, 0, 1, 1], "features": several, "more": [{"no": "feature"}]}, several), ({"type": "FeatureCollection", "features": []}, []),
        (several, several), ([], []), (odd, [odd]),
    ):
        data = json.dumps(document, indent=indent).encode()
        found = list(sequences.features(Bytes(data)))
        assert [json.loads(f) for _, f in found] == expected
        assert all(data[at : at + len(f)] == f for at, f in found)


def line(i: int) -> str:
    return json.dumps({"type": "Feature", "properties": {"id": f"é{i}", "note": "x" * (i % 300)}, "geometry": {"type": "Point", "coordinates": [i / 1000, -i / 500]}}, ensure_ascii=False)


@pytest.mark.parametrize("mark", ["\n", "\x1e", "\r\n"])
def test_a_sequence_is_read_in_many_tasks(spark, tmp_path, mark):
    n = 20_000
    text = "﻿" + (mark if mark == "\x1e" else "") + mark.join(map(line, range(n)))
    (tmp_path / "s.geojsonl").write_bytes(text.encode())
    expected = [(f"é{i}", i / 1000, -i / 500) for i in range(n)]
    rows = None
    for split in (100_000, 1 << 20, 1 << 30):
        df = features.read_features(spark, str(tmp_path / "s.geojsonl"), "strict", split)
        assert df.rdd.getNumPartitions() == -(-len(text.encode()) // split)
        found = sorted((tuple(r) for r in df.select("ord", "place", "id", "lon", "lat").collect()))
        assert [r[2:] for r in found] == expected and (rows is None or found == rows)
        rows = found


def test_folders_patterns_and_documents(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [json.loads(line(i)) for i in range(3)]}, indent=1))
    (tmp_path / "in" / "deep" / "b.json").write_text("\n\n".join([line(3), json.dumps({"type": "FeatureCollection", "features": [json.loads(line(4))]}), json.dumps([json.loads(line(5))])]))
    (tmp_path / "in" / "_SUCCESS").write_text("no json")
    (tmp_path / "in" / "empty.json").write_text("")
    got = features.read_features(spark, str(tmp_path / "in"), "strict", 50).collect()
    assert sorted(r["id"] for r in got) == [f"é{i}" for i in range(6)]
    assert sorted(r["id"] for r in features.read_features(spark, str(tmp_path / "in" / "*.json")).collect()) == ["é0", "é1", "é2"]
    with pytest.raises(FileNotFoundError):
        features.read_features(spark, str(tmp_path / "none" / "*.json"))


def test_other_stores_are_read_by_lines(spark, tmp_path, monkeypatch):
    """Where pyarrow does not reach, Spark's own reader of lines gives the same features."""
    (tmp_path / "s.json").write_text("\x1e" + "\n\x1e".join(map(line, range(50))))
    monkeypatch.setattr(sequences, "KNOWN", ())
    assert sorted(r["id"] for r in features.read_features(spark, str(tmp_path / "s.json"), "strict").collect()) == sorted(f"é{i}" for i in range(50))


def test_long_lines_are_taken_apart():
    many = {"type": "FeatureCollection", "features": [json.loads(line(i)) for i in range(9000)]}
    assert not sequences.is_sequence(pa.BufferReader(json.dumps(many).encode()))
    assert sequences.is_sequence(pa.BufferReader(line(1).encode() + b"\n" + line(2).encode()))
    assert not sequences.is_sequence(pa.BufferReader(json.dumps(many, indent=1).encode()))
