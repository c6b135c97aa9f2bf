from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from pathglow.operators import raster


def flood(mask: np.ndarray) -> np.ndarray:
    out = np.full(mask.shape, -1)
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start] >= 0:
            continue
        name, todo = start[0] * mask.shape[1] + start[1], [start]
        out[start] = name
        while todo:
            r, c = todo.pop()
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and out[p] < 0:
                    out[p] = name
                    todo.append(p)
    return out


@settings(max_examples=150, deadline=None)
@given(arrays(bool, st.tuples(st.integers(1, 12), st.integers(1, 12))))
def test_regions_like_flood_fill(mask):
    assert (raster.label_regions(mask) == flood(mask)).all()


def peel(grid: np.ndarray, threshold: int, min_size: int) -> tuple[list, int]:
    """Takes peaks one by one: each large one erases its warm blob, each small one its own region until then."""
    image, work, found, small = grid.copy(), grid.copy(), [], 0
    while work.max() >= threshold:
        r, c = np.unravel_index(work.argmax(), work.shape)
        own = flood(work >= threshold) == flood(work >= threshold)[r, c]
        if own.sum() <= min_size:
            small += 1
            work[own] = 0
            continue
        found.append((int(r), int(c), int(work[r, c]), int(own.sum())))
        warm = flood(image >= 1)
        image[warm == warm[r, c]] = 0
        work = image.copy()
    return found, small


@pytest.mark.parametrize("seed", range(4))
def test_peaks_like_peeling(spark, seed):
    rng = np.random.default_rng(seed)
    grids = {t: np.where(rng.random((14, 14)) < 0.35, 0, rng.integers(1, 256, (14, 14))) for t in range(6)}
    rows = [(t, r, c, int(g[r, c])) for t, g in grids.items() for r in range(14) for c in range(14)]
    cells = raster.labelled_cells(spark.createDataFrame(rows, "tile int, r int, c int, v int"), 150)
    got: dict = {}
    for x in raster.peaks(cells, 2).orderBy("tile", "index_in_tile").collect():
        got.setdefault(x["tile"], []).append((x["r"], x["c"], x["peak"], x["size"]))
    counts = {x["tile"]: (x["candidates"], x["small"]) for x in raster.detection_counts(cells, 2).collect()}
    for t, g in grids.items():
        found, small = peel(g, 150, 2)
        assert got.get(t, []) == found
        assert counts.get(t, (0, 0)) == (len(found), small)


def png(grid: np.ndarray, filters: list[int]) -> bytes:
    """A PNG written with the given filter for each line in turn."""
    height, width = grid.shape
    lines, above = [], np.zeros(width, np.int64)
    for y in range(height):
        kind, line = filters[y % len(filters)], grid[y].astype(np.int64)
        left = np.r_[0, line[:-1]]
        corner = np.r_[0, above[:-1]]
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        guess = [np.zeros(width, np.int64), left, above, (left + above) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_png_of_every_filter():
    grid = np.random.default_rng(1).integers(0, 256, (11, 9))
    assert (raster.decode_png(png(grid, [0, 1, 2, 3, 4])) == grid).all()


def test_tiles_from_files(spark, tmp_path):
    from pathglow.sources.mapfiles import read_tiles

    grid = np.zeros((4, 5), int)
    grid[1, 2], grid[3, 4] = 7, 200
    for name, data in (("1.png", png(grid, [4])), ("2.png", b""), ("3.png", b"nonsense")):
        folder = tmp_path / "ride" / "14" / "8300"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)
    rows = {(r["layer"], r["z"], r["x"], r["y"], r["r"], r["c"], r["v"], r["error"] is None) for r in read_tiles(spark, str(tmp_path)).collect()}
    assert rows == {("ride", 14, 8300, 1, 1, 2, 7, True), ("ride", 14, 8300, 1, 3, 4, 200, True), ("ride", 14, 8300, 3, -1, -1, 0, False)}


def test_tiles_are_labelled_together(spark, monkeypatch):
    """Many tiles of any size in one go, cut wherever a batch ends, each as if it were alone; no group of pandas a tile."""
    monkeypatch.setattr(raster, "TOGETHER", 40)
    rng = np.random.default_rng(12)
    grids = {t: np.where(rng.random((h, w)) < 0.65, rng.integers(1, 256, (h, w)), 0) for t, (h, w) in enumerate(zip(rng.integers(1, 12, 60), rng.integers(1, 12, 60), strict=True))}
    rows = [(t, int(r), int(c), int(g[r, c])) for t, g in grids.items() for r, c in zip(*np.nonzero(g), strict=True)]
    found = raster.labelled_cells(spark.createDataFrame(rows, "tile int, r int, c int, v int").repartition(7), 100)
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
    want = set()
    for t, g in grids.items():
        if g.max() >= 100:
            g = g[:, : np.nonzero(g)[1].max() + 1]  # a tile is as wide as its last cell
            blob, comp = flood(g >= 1), flood(g >= 100)
            want |= {(t, int(r), int(c), int(g[r, c]), int(blob[r, c]), int(comp[r, c])) for r, c in zip(*np.nonzero(g), strict=True)}
    got = found.collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
