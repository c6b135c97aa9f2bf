"""Connected regions of heat tiles, and the peaks that stand for them.

Tiles are independent: regions never cross a tile's border. Labelling runs in NumPy, many tiles at a time, tasks run in parallel;
everything after it, statistics, the choice of peaks and their order, is relational.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells that are labelled together.
TOGETHER = 1 << 16


def first_of_regions(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least place that links (a, b) reach: roots hook on to less ones, then all look up theirs."""
    label = np.arange(n)
    while True:
        p, q = label[a], label[b]
        apart = p != q
        if not apart.any():
            return label
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label != (up := label[label])).any():
            label = up


def label_cells(tile: np.ndarray, r: np.ndarray, c: np.ndarray, on: np.ndarray) -> np.ndarray:
    """4-connected regions of cells that are ``on``, of many tiles at once: at each such cell the least flat index of its region, else -1.

    Cells are sorted by tile, row and column, and each is there once; ``tile`` counts from 0. A tile is as wide as its last column.
    """
    label = np.full(len(tile), -1, np.int64)
    at = np.flatnonzero(on)
    if len(at):
        width, height = int(c.max()) + 2, int(r.max()) + 2  # an empty column and row keep tiles apart
        flat = (tile[at].astype(np.int64) * height + r[at]) * width + c[at]
        own, links = np.arange(len(at)), []
        for step in (1, width):
            to = np.minimum(np.searchsorted(flat, flat + step), len(at) - 1)
            met = flat[to] == flat + step
            links.append((own[met], to[met]))
        first = at[first_of_regions(len(at), *(np.concatenate(x) for x in zip(*links, strict=True)))]
        wide = np.maximum.reduceat(c, np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])) + 1
        label[at] = r[first].astype(np.int64) * wide[tile[first]] + c[first]
    return label


def label_regions(mask: np.ndarray) -> np.ndarray:
    """4-connected regions of a boolean grid: at each set cell the least flat index of its region, else -1."""
    r, c = np.indices(mask.shape).reshape(2, -1)
    return label_cells(np.zeros(mask.size, np.int64), r, c, mask.ravel()).reshape(mask.shape)


def labelled_cells(heat: DataFrame, threshold: int, keys: tuple[str, ...] = ("tile",)) -> DataFrame:
    """Adds blob (region of v >= 1) and comp (region of v >= ``threshold``) to cells keys, r, c, v with v >= 1.

    A tile's cells lie side by side in one task, and tiles are labelled some ``TOGETHER`` cells at a time; a tile has a fixed size, so
    that is bounded.
    """
    schema = ", ".join(f"{k} {heat.schema[k].dataType.simpleString()}" for k in keys) + ", r int, c int, v int, blob long, comp long"
    n = len(keys)

    def labelled(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        r, c, v, nth = (rows.column(n + k).to_numpy() for k in range(4))
        tile = np.cumsum(nth == 1) - 1
        new = np.r_[True, (tile[1:] != tile[:-1]) | (r[1:] != r[:-1]) | (c[1:] != c[:-1])]  # a cell that is there twice is one
        one, place = np.flatnonzero(new), np.cumsum(new) - 1
        value = np.maximum.reduceat(v, one)
        told = [label_cells(tile[one], r[one], c[one], value >= low)[place] for low in (1, threshold)]
        names = [*keys, "r", "c", "v", "blob", "comp"]
        yield from pa.Table.from_arrays([*rows.columns[: n + 3], *map(pa.array, told)], names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            starts = np.flatnonzero(batch.column(n + 3).to_numpy() == 1)
            cut = int(starts[-1]) if len(starts) else 0
            if len(starts) and size + cut >= TOGETHER:
                yield from labelled([*held, batch.slice(0, cut)])
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if size:
            yield from labelled(held)

    cells = heat.where("v >= 1").select(*keys, F.col("r").cast("int"), F.col("c").cast("int"), F.col("v").cast("int"))
    hot = cells.groupBy(*keys).agg(F.max("v").alias("_max")).where(F.col("_max") >= threshold).drop("_max")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("r", "c"))
    return cells.join(hot, list(keys), "left_semi").withColumn("_nth", nth).mapInArrow(run, schema)


def components(cells: DataFrame, keys: tuple[str, ...] = ("tile",)) -> DataFrame:
    """One row a hot region: its blob, size and peak (highest value, first in reading order)."""
    peak = F.min_by(F.struct("v", "r", "c"), F.struct(-F.col("v"), F.col("r"), F.col("c")))
    found = cells.where("comp >= 0").groupBy(*keys, "comp").agg(F.first("blob").alias("blob"), F.count("*").alias("size"), peak.alias("p"))
    return found.select(*keys, "comp", "blob", "size", F.col("p.v").alias("peak"), F.col("p.r").alias("r"), F.col("p.c").alias("c"))


def peaks(cells: DataFrame, min_size: int, keys: tuple[str, ...] = ("tile",)) -> DataFrame:
    """One candidate a blob: the large hot region whose peak comes first by value, then by place."""
    order = [F.desc("peak"), F.col("r"), F.col("c")]
    large = components(cells, keys).where(F.col("size") > min_size)
    best = large.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "blob").orderBy(*order))).where("_rn = 1").drop("_rn")
    return best.withColumn("index_in_tile", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def detection_counts(cells: DataFrame, min_size: int, keys: tuple[str, ...] = ("tile",)) -> DataFrame:
    """Per tile: candidates, and how often small regions are met again while candidates are taken one by one.

    A small region is met once before every candidate that comes after it, as long as no candidate has erased its blob,
    and once at the end if none ever does.
    """
    every = components(cells, keys)
    chosen = peaks(cells, min_size, keys).select(*keys, F.col("blob").alias("own"), F.col("index_in_tile").alias("step"), F.struct(-F.col("peak"), "r", "c").alias("at"))
    small = every.where(F.col("size") <= min_size).select(*keys, "comp", "blob", F.struct(-F.col("peak"), "r", "c").alias("small_at"))
    ends = chosen.select(*keys, F.col("own").alias("blob"), F.col("step").alias("erased"))
    pairs = small.join(ends, [*keys, "blob"], "left").join(chosen, list(keys), "left")
    met = F.when((F.col("small_at") < F.col("at")) & (F.col("erased").isNull() | (F.col("step") <= F.col("erased"))), 1).otherwise(0)
    again = pairs.groupBy(*keys, "comp").agg((F.sum(met) + F.max(F.when(F.col("erased").isNull(), 1).otherwise(0))).alias("n")).groupBy(*keys).agg(F.sum("n").alias("small"))
    counts = every.groupBy(*keys).agg(F.count("*").alias("regions")).join(chosen.groupBy(*keys).agg(F.count("*").alias("candidates")), list(keys), "left").join(again, list(keys), "left")
    counts = counts.fillna(0, ["candidates", "small"])
    return counts.select(*keys, "candidates", "small", (F.col("candidates") + F.col("small")).alias("raw"))


def intensity_stats(cells: DataFrame, keys: tuple[str, ...] = ("tile", "comp"), pixel: float = 1.0) -> DataFrame:
    """Corner, size, extent, diagonal, area and exact percentiles of each hot region; ``pixel`` is a cell's width."""
    q = F.percentile("v", F.array(*map(F.lit, (0.5, 0.75, 0.9, 0.95))))
    stats = cells.where("comp >= 0").groupBy(*keys).agg(
        F.min("r").alias("top"), F.min("c").alias("side"), F.count("*").alias("pixels"), (F.max("c") - F.min("c") + 1).alias("width"), (F.max("r") - F.min("r") + 1).alias("height"),
        F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.round(F.avg("v"), 6).alias("v_mean"), q.alias("q"),
    )
    span = F.round(F.hypot("width", "height") * pixel, 6).alias("diagonal"), (F.col("pixels") * float(pixel * pixel)).alias("area")
    return stats.select(*[c for c in stats.columns if c != "q"], *span, *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("v_median", "v_p75", "v_p90", "v_p95"))])


def principal_axes(cells: DataFrame, keys: tuple[str, ...] = ("tile", "comp"), most: float = 1e6) -> DataFrame:
    """Orientation in degrees [0, 180) and elongation from the 2 x 2 sample covariance, in closed form."""
    m = cells.where("comp >= 0").groupBy(*keys).agg(F.count("*").alias("n"), F.var_samp("c").alias("a"), F.covar_samp("c", -F.col("r")).alias("b"), F.var_samp("r").alias("d"))
    a, b, d = (F.col(x) for x in "abd")
    root = F.sqrt((a - d) * (a - d) / 4 + b * b)
    major, minor = (a + d) / 2 + root, F.greatest((a + d) / 2 - root, F.lit(0.0))
    turned = F.degrees(F.atan2(2 * b, a - d) / 2)
    angle = F.when(turned < 0, turned + 180).otherwise(turned)
    long: Column = F.when(minor <= 1e-12, F.lit(most)).otherwise(F.least(major / minor, F.lit(most)))
    return m.where("n >= 2").select(*keys, "n", "a", "b", "d", F.round(angle, 4).alias("orientation"), F.round(long, 4).alias("elongation"))


def burn_mask(heat: DataFrame, segments: DataFrame, width: float, keys: tuple[str, ...] = ("tile",), side: int | None = None) -> DataFrame:
    """Sets to 0 the cells within half of ``width`` cells of a segment (keys, r1, c1, r2, c2) of their tile.

    With ``side``, the cells of a tile along each side, what lies outside the tile is not looked at, so that long segments cost no more
    than the tile."""
    from pathglow.functions.geo import segment_distance

    half = width / 2
    near = segments.select(*keys, *("r1", "c1", "r2", "c2"))
    reach = {n: [F.floor(F.least(f"{n}1", f"{n}2") - half), F.ceil(F.greatest(f"{n}1", f"{n}2") + half)] for n in "rc"}
    if side is not None:
        reach = {n: [F.greatest(a, F.lit(0)), F.least(b, F.lit(side - 1))] for n, (a, b) in reach.items()}
        near = near.where((reach["r"][0] <= reach["r"][1]) & (reach["c"][0] <= reach["c"][1]))
    rows, cols = (F.sequence(*(v.cast("int") for v in reach[n])) for n in "rc")
    cells = near.withColumn("r", F.explode(rows)).withColumn("c", F.explode(cols))
    distance = segment_distance(F.col("c"), F.col("r"), F.col("c1"), F.col("r1"), F.col("c2"), F.col("r2"))
    burnt = cells.where(distance <= half).select(*keys, "r", "c").distinct().withColumn("_burnt", F.lit(True))
    return heat.join(burnt, [*keys, "r", "c"], "left").withColumn("v", F.when(F.col("_burnt"), 0).otherwise(F.col("v"))).drop("_burnt")


def fill_polygons(heat: DataFrame, edges: DataFrame, side: int, shape: str = "shape", keys: tuple[str, ...] = ("tile",)) -> DataFrame:
    """Sets to 0 the cells inside polygons (keys, shape, edges r1, c1, r2, c2) of their tile of ``side`` cells.

    A row of cells meets a polygon's edges in an even number of places; the cells between the first and the second, the
    third and the fourth and so on lie inside. A cell on an edge belongs to the polygon above or to its right; masks burn
    the edges as lines too. A shape gives no more than the tile's cells; parts outside the tile cost nothing.
    """
    first, last = F.greatest(F.lit(0), F.ceil(F.least("r1", "r2")).cast("int")), F.least(F.lit(side - 1), F.floor(F.greatest("r1", "r2")).cast("int"))
    met = edges.where(first <= last).withColumn("r", F.explode(F.sequence(first, last))).where((F.col("r1") > F.col("r")) != (F.col("r2") > F.col("r")))
    place = (F.col("c2") - F.col("c1")) * (F.col("r") - F.col("r1")) / (F.col("r2") - F.col("r1")) + F.col("c1")
    rows = met.groupBy(*keys, shape, "r").agg(F.array_sort(F.collect_list(F.least(F.lit(float(side)), F.greatest(F.lit(0.0), place)))).alias("x"))
    spans = F.transform(F.sequence(F.lit(0), F.size("x") - 2, F.lit(2)), lambda i: F.struct(F.ceil(F.get("x", i)).cast("int").alias("a"), (F.ceil(F.get("x", i + 1)) - 1).cast("int").alias("b")))
    inside = rows.where(F.size("x") >= 2).select(*keys, "r", F.explode(spans).alias("s")).where("s.a <= s.b").select(*keys, "r", F.explode(F.sequence("s.a", "s.b")).alias("c"))
    burnt = inside.distinct().withColumn("_burnt", F.lit(True))
    return heat.join(burnt, [*keys, "r", "c"], "left").withColumn("v", F.when(F.col("_burnt"), 0).otherwise(F.col("v"))).drop("_burnt")


def decode_png(data: bytes) -> np.ndarray:
    """Grey values of an 8-bit PNG without interlace: grey, grey with alpha, RGB or RGBA."""
    import struct
    import zlib

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("unsupported PNG")
    width, height, n = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    out, above = np.zeros((height, width * n), np.uint8), np.zeros(width * n, np.int64)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(width, n), axis=0).ravel() % 256
        elif kind == 2:
            line = (line + above) % 256
        elif kind in (3, 4):
            for x in range(width * n):
                left, up, corner = (line[x - n] if x >= n else 0), above[x], (above[x - n] if x >= n else 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line[x] = (line[x] + guess) % 256
        out[y], above = line, line
    pixels = out.reshape(height, width, n).astype(np.int64)
    if n < 3:
        return pixels[:, :, 0]
    return (pixels[:, :, 0] * 19595 + pixels[:, :, 1] * 38470 + pixels[:, :, 2] * 7471 + 0x8000) >> 16


def tile_rows(tiles: DataFrame) -> DataFrame:
    """Cells path, r, c, v with v > 0 of PNG tiles (path, content); a tile that cannot be decoded gives one row with error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                if not content:
                    continue  # known to be empty
                try:
                    grid = decode_png(bytes(content))
                except Exception as e:  # a damaged tile must not end the scan
                    yield pd.DataFrame({"path": [path], "r": [-1], "c": [-1], "v": [0], "error": [str(e)[:80] or type(e).__name__]})
                    continue
                r, c = np.nonzero(grid)
                yield pd.DataFrame({"path": path, "r": r, "c": c, "v": grid[r, c], "error": None})

    return tiles.select("path", "content").mapInPandas(run, "path string, r int, c int, v int, error string")
