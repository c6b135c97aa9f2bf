"""Shards, WARC archives and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from pathglow.llm import sharding, warc
from pathglow.llm.common import shared_path, table


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_in_unit_steps(dims, bits):
    grid = np.indices((1 << bits,) * dims).reshape(dims, -1)
    index = sharding.hilbert_index(list(grid), bits)
    assert sorted(index.tolist()) == list(range(1 << (bits * dims)))
    assert (np.abs(np.diff(grid[:, np.argsort(index)], axis=1)).sum(0) == 1).all()


def check_shards(rows, docs: list, shards: int) -> None:
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs), key=str)
    by: dict = {s: [] for s in range(shards)}
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(v) for v in by.values()]
    assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("parts", [1, 7])
def test_shards(spark, data, odd_documents, no_documents, parts):
    docs = table(spark, data, "documents")
    for df in (docs, odd_documents):
        check_shards(sharding.assign_shards(df.repartition(parts)).collect(), [(r["doc_id"], r["text"]) for r in df.collect()], sharding.SHARDS)
    assert sharding.assign_shards(no_documents).count() == 0


def test_shards_run_along_the_curve(spark, data):
    rows = sharding.assign_shards(table(spark, data, "documents")).collect()
    order = [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    # what the curve is for: a shard holds fewer languages and sources than if rows were dealt at random
    kinds = {r["doc_id"]: (r["lang"], r["source"]) for r in table(spark, data, "documents").collect()}

    def met(shard_of: dict) -> int:
        return sum(len({(s, kinds[i][k]) for i, s in shard_of.items()}) for k in (0, 1))

    own = {r["doc_id"]: r["shard"] for r in rows}
    dealt = np.random.default_rng(1).permutation(list(own.values())).tolist()
    assert met(own) < 0.8 * met(dict(zip(own, dealt, strict=True)))


def test_written_shards(spark, data, tmp_path):
    docs = table(spark, data, "documents")
    sharding.write_shards(docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() and back.select("_shard").distinct().count() == 16


def plain_curve(axes: tuple[int, ...], bits: int) -> int:
    """Place on the curve by descent: in each cell the order of the halves follows from entry corner and direction."""
    n, entry, direction, place = len(axes), 0, 0, 0
    for bit in reversed(range(bits)):
        corner = sum((x >> bit & 1) << (n - 1 - i) for i, x in enumerate(axes))
        turn = direction + 1
        local = corner ^ entry
        local = (local >> turn | local << (n - turn)) & ((1 << n) - 1) if turn % n else local
        rank, shift = local, 1
        while shift < n:  # Gray code to rank
            rank ^= rank >> shift
            shift *= 2
        place = place << n | rank
        gray = lambda r: r ^ r >> 1
        first = gray(2 * ((rank - 1) // 2)) if rank else 0
        first = (first << turn | first >> (n - turn)) & ((1 << n) - 1) if turn % n else first
        entry ^= first
        low = lambda r: (~r & r + 1).bit_length() - 1  # noqa: E731  trailing ones
        step = 0 if not rank else low(rank - 1) if rank % 2 == 0 else low(rank)
        direction = (direction + step + 1) % n
    return place


@pytest.mark.parametrize(("dims", "bits"), [(2, 5), (3, 4), (4, 3)])
def test_curve_fills_every_cube_before_the_next(dims, bits):
    """What makes it a Hilbert curve beside unit steps: the cells of each aligned cube, of any size, are one run of places."""
    grid = np.indices((1 << bits,) * dims).reshape(dims, -1)
    index = sharding.hilbert_index(list(grid), bits)
    for k in range(1, bits):
        cube = np.ravel_multi_index(tuple(grid >> k), (1 << (bits - k),) * dims)
        for c in range(cube.max() + 1):
            mine = index[cube == c]
            assert mine.max() - mine.min() + 1 == len(mine)


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (2, 8)])
def test_curve_is_the_hilbert_curve_of_the_plane(dims, bits):
    """Against a recursive construction: the same up to one order of axes and reflection of the whole square."""
    from itertools import permutations

    rng = np.random.default_rng(dims + bits)
    points = rng.integers(0, 1 << bits, (dims, 400))
    own = sharding.hilbert_index(list(points), bits)
    top = (1 << bits) - 1
    for order in permutations(range(dims)):
        for flip in range(1 << dims):
            turned = [points[a] ^ (top if flip >> a & 1 else 0) for a in order]
            if [plain_curve(tuple(int(v) for v in c), bits) for c in zip(*turned, strict=True)] == own.tolist():
                return
    raise AssertionError("no turn of the plain curve gives the same places")


def test_order_of_shards_is_recomputed(spark, data):
    """Quantised dimensions, places and order of all rows, worked out row by row."""
    docs = table(spark, data, "documents")
    hashed = {r[0]: r[1:] for r in docs.select("doc_id", *[F.xxhash64(F.coalesce(c, F.lit("\x00"))) for c in ("lang", "source")]).collect()}
    rows = []
    for r in docs.collect():
        text = (r["text"] or "").encode()
        level = min(int(np.floor(np.log2(len(text) + 1) * 10)), 255)
        axes = [np.array([v]) for v in (hashed[r["doc_id"]][0] % 256, hashed[r["doc_id"]][1] % 256, level)]
        rows.append((int(sharding.hilbert_index(axes)[0]), zlib.crc32(text), r["doc_id"]))
    n = len(rows)
    expected = {}
    for rank, (curve, _, doc) in enumerate(sorted(rows)):
        shard = rank * sharding.SHARDS // n
        expected[doc] = (curve, shard, rank - -(-shard * n // sharding.SHARDS))
    assert {r["doc_id"]: (r["curve"], r["shard"], r["slot"]) for r in sharding.assign_shards(docs).collect()} == expected


def test_written_shards_keep_rows_that_share_an_id(spark, tmp_path):
    rows = [(1, "a", "en", "s", 1, 2), (1, "a", "en", "s", 1, 3), (2, None, None, None, 5, 5), (1, "b", "de", "t", 7, 7), (None, "c", "en", "s", 8, 8), (None, "c", "en", "s", 8, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _slot int, _shard int")
    folder = sharding.write_shards(docs, str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert folder not in docs.columns and sorted(map(tuple, back.select(*docs.columns).collect()), key=str) == sorted(rows, key=str)
    assert {r[0] for r in back.select(folder).distinct().collect()} == {0, 1}


def test_archives_inside_payloads(spark, tmp_path):
    """A stored gzip member of a WARC inside a payload is no record, whatever the split."""
    rng = np.random.default_rng(0)
    inner = b"".join(packed(warc._record(f"urn:page:{900 + i}", None, rng.bytes(30_000), None)) for i in range(3))
    rows = [(i, f"http://x/{i}", bytes(rng.bytes(40_000)) if i % 2 else inner) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary").coalesce(1)
    manifest = warc.write_warc(pages, str(tmp_path / "w"), min_bytes=1 << 40, level=0)
    assert manifest.agg(F.sum(F.size("marks"))).first()[0] >= 3
    for split in (50_000, 1_300_000, 8 << 20):
        found = warc.read_warc(manifest, str(tmp_path / "w"), split).collect()
        assert sorted((int(r["record_id"]), r["error"]) for r in found) == [(i, None) for i in range(60)]


def plain_archive(rows: list, min_bytes: int = 0) -> list:
    best: dict = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw, first = (h or "").encode(), best.get(h or "")
        again = first is not None and first != i and len(raw) >= min_bytes
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def odd_pages(spark, data):
    p = table(spark, data, "pages")
    more = [(900001, "u\nv", None), (900002, None, ""), (None, "x", "alone"), (None, "x", p.orderBy("page_id").first()["html"]), (900003, "é/ü?q=1 2", "ü" * 3_000_000), (900003, "é/ü?q=1 2", "ü" * 3_000_000)]
    return p.unionByName(p.where("page_id % 7 = 0").withColumn("page_id", F.col("page_id") + 100000)).unionByName(spark.createDataFrame(more, p.schema))


def test_archives_round_trip(spark, data):
    pages = odd_pages(spark, data).withColumn("payload", F.lit(1)).withColumn("original", F.lit("x"))
    rows = [tuple(r)[:3] for r in pages.collect()]
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()), key=str)
    assert got == plain_archive(rows)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, min_bytes=3000).collect()), key=str)
    assert got == plain_archive(rows, 3000)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_any_split_reads_each_record_once(spark, data):
    folder = shared_path(spark, "test-warc")
    manifest = warc.write_warc(odd_pages(spark, data), folder, file_bytes=40_000)
    assert manifest.count() > 2
    whole = None
    for split in (1 << 30, 50_000, 9_973):
        rows = sorted(((r["record_id"], r["record_type"], r["payload_digest"], r["payload"] and len(r["payload"])) for r in warc.read_warc(manifest, folder, split, with_payload=True).collect()), key=str)
        whole = whole or rows
        assert rows == whole
    assert len(whole) == manifest.agg(F.sum("records")).first()[0]
    fs, _ = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(manifest.first()["path"]) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\n")


def packed(record: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def read(data: bytes, step: int) -> list:
    return [m for s in range(0, len(data), step) for m in warc.members(pa.BufferReader(data), s, min(s + step, len(data)))]


def test_false_magic_and_damage():
    good = [packed(warc._record(warc._urn(i), "u", b"x" * i * 300, None)) for i in range(6)]
    broken = bytearray(good[3])
    broken[20:24] = b"\xff\xff\xff\xff"
    parts = [b"noise\x1f\x8b\x08", good[0], gzip.compress(b"not an archive"), good[1], bytes(broken), good[4], good[5][:-9]]
    data, places = b"".join(parts), np.cumsum([0, *map(len, parts)]).tolist()
    found = read(data, len(data))
    assert [warc._parsed(m)[1] for _, m, _ in found if m is not None] == ["0", "1", "4"]
    errors = [(at, e) for at, _, e in found if e]
    assert (0, "no member here") in errors and (places[2], "no member here") in errors and (places[6], "damaged or cut off") in errors
    assert {at for at, _ in errors} == {0, places[2], places[4], places[6]}
    for step in (1, 13, 100):
        assert read(data, step) == found


def test_gzip_heads_of_any_length():
    """A head may hold a name as long as it likes before the text begins."""
    raw = zlib.compressobj(1, zlib.DEFLATED, -15)
    text = warc._record(warc._urn("x"), None, b"abc", None)
    body = raw.compress(text) + raw.flush()
    long = b"\x1f\x8b\x08\x08" + bytes(6) + b"n" * 100_000 + b"\x00" + body + zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little")
    data = long + packed(warc._record(warc._urn("y"), None, b"", None)) + long
    for step in (len(data), 50_000, 999):
        assert [warc._parsed(m)[1] for _, m, e in read(data, step)] == ["x", "y", "x"]


def test_wrong_digests_and_lengths_are_rows():
    record = warc._record(warc._urn(1), "u", b"payload", None)
    assert warc._parsed(record)[6] is None
    assert warc._parsed(record.replace(b"payload\r\n\r\n", b"paylaod\r\n\r\n"))[6] == "payload does not have its digest"
    assert warc._parsed(record[:-8])[6] == "lengths do not hold"


def test_ids_and_addresses(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([("", None, "a"), (None, None, "b"), ("x/y z", None, "a"), ("<k>", "u", None)], "page_id string, url string, html string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()), key=str)
    assert got == sorted([("", "revisit", "x/y z"), (None, "response", None), ("x/y z", "response", None), ("<k>", "response", None)], key=str)
    for folder in (str(tmp_path / "a b"), f"file:{tmp_path}/c", f"file://{tmp_path}/d"):
        manifest = warc.write_warc(pages, folder)
        assert warc.read_warc(manifest, folder).where("error is null").count() == 4
    monkeypatch.setattr(warc, "pafs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=lambda u: u)))
    assert [warc._opened(u) for u in ("s3a://b/k", "s3n://b/k", "hdfs://n:1/k")] == ["s3://b/k", "s3://b/k", "hdfs://n:1/k"]


def test_pipeline(spark, data):
    """Each stage against what its operator says of the stage's own input."""
    import corpus_pipeline as pipeline
    from pathglow.llm.bpe import encoder
    from pathglow.llm.quality_rules import quality_verdicts
    from pathglow.llm.simhash import simhash_components
    from pathglow.llm.toxicity import toxicity_scores

    docs = table(spark, data, "documents")
    said = [
        lambda d: {r["doc_id"] for r in toxicity_scores(d, table(spark, data, "labels")).where("predicted = 0").collect()},
        lambda d: {r["doc_id"] for r in quality_verdicts(d).where("kept").collect()},
        lambda d: {r["component_id"] for r in simhash_components(d).collect()},
    ]
    rows = docs
    for (name, stage), expected in zip(pipeline.STAGES[:-1], said, strict=True):
        out = stage(spark, rows, data)
        assert out.columns == docs.columns
        path = shared_path(spark, "test-" + name.replace(" ", "-"))
        out.write.parquet(path)
        ids = [r["doc_id"] for r in spark.read.parquet(path).select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) == expected(rows) and 0 < len(ids) <= rows.count()
        rows = spark.read.parquet(path)
    pieces = pipeline.STAGES[-1][1](spark, rows, data)
    codec = encoder(pipeline.public_tokenizers.path(pipeline.TOKENIZER))
    total = sum(len(codec.encode(r["text"] or "")) // 4 + 1 for r in rows.collect())
    assert pieces.agg(F.sum("length")).first()[0] == total
    assert pipeline.run(spark, data).agg(F.sum("length")).first()[0] == total


def test_pipeline_on_odd_documents(spark, data, odd_documents, no_documents, tmp_path):
    import corpus_pipeline as pipeline

    for name in ("labels",):
        table(spark, data, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    for docs in (odd_documents, no_documents):
        rows = docs
        for _, stage in pipeline.STAGES:
            rows = stage(spark, rows, str(tmp_path))
        rows.collect()
