"""The ways nearest to points, by one shuffle of points and segments: no pair of them is a row of a table unless it is an answer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglow.operators.cells import cell

#: Radii that a cell is wide, points taken together, pairs measured at once, and how far apart distances count as ties that the caller decides.
WIDE, TOGETHER, AT_ONCE, SLACK = 8, 48, 1 << 16, 1e-5
ENDS = ("x1", "y1", "x2", "y2")


def over_passed_cells(segments: DataFrame, pad: float, side: float) -> DataFrame:
    """A row for each cell (_cx, _cy) with places within ``pad`` of a segment: column by column along it, so as many as it is long."""
    x1, y1, x2, y2 = (F.col(c) for c in ENDS)
    columns = segments.withColumn("_cx", F.explode(F.sequence(cell(F.least(x1, x2) - pad, side), cell(F.greatest(x1, x2) + pad, side))))
    slope = (y2 - y1) / F.nullif(x2 - x1, F.lit(0.0))
    at = [y1 + slope * (F.greatest(F.least(x1, x2), F.least(F.greatest(x1, x2), x)) - x1) for x in (F.col("_cx") * side - pad, (F.col("_cx") + 1) * side + pad)]
    low, high = F.coalesce(F.least(*at), F.least(y1, y2)), F.coalesce(F.greatest(*at), F.greatest(y1, y2))
    return columns.withColumn("_cy", F.explode(F.sequence(cell(low - pad, side), cell(high + pad, side))))


def near_lines(points: DataFrame, segments: DataFrame, radius: float, keys: Sequence[str], keep: Sequence[str], way: str = "way_id", most: int | None = None, once: bool = False) -> DataFrame:
    """keys, keep and ``d``, the distance: for points (keys, px, py) the segments (way, x1, y1, x2, y2, keep) within ``radius``, of each way
    the nearest, and with ``most`` of so many nearest ways only.

    What is farther by less than ``SLACK`` is returned too, as a caller that rounds distances decides such ties by them. With ``once`` there
    is one row for each point and way, of any of its segments, with the exact least distance, none beyond ``radius``.

    A point stands in one cell, a segment in all that its neighbourhood passes. Rows are sorted by cells; a task reads those of a cell's
    segments and then its points. It holds the segments of one cell, eight radii wide, as arrays. Rows with a coordinate that is
    null or not finite meet nothing.
    """
    finite = lambda names: " and ".join(f"`{n}` between -1e300 and 1e300" for n in names)
    side, pad = float(WIDE * radius), radius + 1e-3
    kept = list(dict.fromkeys([way, *keep]))
    ours, theirs = {k: f"_k{i}" for i, k in enumerate(keys)}, {k: f"_s{i}" for i, k in enumerate(kept)}
    types = dict(points.dtypes) | dict(segments.dtypes)
    none = lambda names, of: [F.lit(None).cast(types[k]).alias(names[k]) for k in of]
    homes = points.where(finite(("px", "py"))).select(cell(F.col("px"), side).alias("_cx"), cell(F.col("py"), side).alias("_cy"), F.lit(1).alias("_kind"), *[F.col(c).cast("double").alias(n) for c, n in (("px", "_x1"), ("py", "_y1"))], *[F.lit(None).cast("double").alias(n) for n in ("_x2", "_y2")], *[F.col(k).alias(ours[k]) for k in keys], *none(theirs, kept))
    spread = over_passed_cells(segments.select(*dict.fromkeys([*kept, *ENDS])).where(finite(ENDS)), pad, side)
    spread = spread.select("_cx", "_cy", F.lit(0).alias("_kind"), *[F.col(c).cast("double").alias("_" + c) for c in ENDS], *none(ours, keys), *[F.col(k).alias(theirs[k]) for k in kept])
    n_keys, n_kept = len(keys), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, lines = None, [], None
        for batch in batches:
            cx, cy, kind = (batch.column(i).to_numpy() for i in range(3))
            starts = np.flatnonzero(np.r_[True, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1]) | (kind[1:] != kind[:-1])]) if len(cx) else []
            for a, b in zip(starts, [*starts[1:], len(cx)], strict=True):
                at = (cx[a], cy[a])
                if at != now:
                    now, held, lines = at, [], None
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append(part)
                elif held:
                    if lines is None:
                        lines = Lines(pa.Table.from_batches(held), n_keys)
                    for i, j, d in lines.near(part, radius, most, once):
                        columns = [part.column(7 + k).take(pa.array(i)) for k in range(n_keys)] + [lines.kept[k].take(pa.array(j)) for k in range(n_kept)]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(d)], names)

    names = [*ours.values(), *theirs.values(), "d"]
    schema = ", ".join([*[f"{ours[k]} {types[k]}" for k in keys], *[f"{theirs[k]} {types[k]}" for k in kept], "d double"])
    # a number of its own: the work of a task hangs on pairs, which the size of its rows does not tell
    spreads = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = spread.unionByName(homes).repartition(spreads, "_cx", "_cy").sortWithinPartitions("_cx", "_cy", "_kind")
    found = rows.mapInArrow(run, schema)
    return found.select(*[F.col(ours[k]).alias(k) for k in keys], *[F.col(theirs[k]).alias(k) for k in kept], "d")


class Lines:
    """The segments of a cell, those of a way side by side."""

    def __init__(self, rows: pa.Table, n_keys: int) -> None:
        code = rows.column(7 + n_keys).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        self.way = code[order]
        self.ends = [rows.column(3 + k).to_numpy()[order] for k in range(4)]
        self.kept = [rows.column(7 + n_keys + k).combine_chunks().take(pa.array(order)) for k in range(rows.num_columns - 7 - n_keys)]
        x1, y1, x2, y2 = self.ends
        self.box = np.minimum(x1, x2), np.minimum(y1, y2), np.maximum(x1, x2), np.maximum(y1, y2)

    def near(self, points: pa.RecordBatch, radius: float, most: int | None, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of points and of segments, and their distances; points are taken by squares that hold some ``TOGETHER``, with the segments about each."""
        px, py = (points.column(k).to_numpy() for k in (3, 4))
        side = radius * min(WIDE, max(0.5, WIDE * (TOGETHER / len(px)) ** 0.5))
        sx, sy = np.floor(px / side), np.floor(py / side)
        order = np.lexsort((sy, sx))
        cuts = np.flatnonzero(np.r_[True, (np.diff(sx[order]) != 0) | (np.diff(sy[order]) != 0)])
        found, size = [], 0
        for mine in np.split(order, cuts[1:]):
            pad, x, y = radius + SLACK, px[mine], py[mine]
            about = np.flatnonzero((self.box[0] - pad <= x.max()) & (self.box[2] + pad >= x.min()) & (self.box[1] - pad <= y.max()) & (self.box[3] + pad >= y.min()))
            if not len(about):
                continue
            step = max(1, AT_ONCE // len(about))
            for k in range(0, len(mine), step):
                i, j, d = self._measured(x[k : k + step], y[k : k + step], about, radius, most, once)
                found.append((mine[k : k + step][i], about[j], d))
                size += len(d)
            if size > AT_ONCE:
                yield tuple(np.concatenate(c) for c in zip(*found, strict=True))
                found, size = [], 0
        if size:
            yield tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _measured(self, x: np.ndarray, y: np.ndarray, about: np.ndarray, radius: float, most: int | None, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, (x1, y1, x2, y2), way = x[:, None], y[:, None], (e[about] for e in self.ends), self.way[about]
        dx, dy = x2 - x1, y2 - y1
        length = dx * dx + dy * dy
        some = length > 0
        t = np.where(some, np.clip(((x - x1) * dx + (y - y1) * dy) / np.where(some, length, 1.0), 0.0, 1.0), 0.0)
        ux, uy = x - (x1 + t * dx), y - (y1 + t * dy)
        d = np.sqrt(ux * ux + uy * uy)
        if most == 1 and not once:
            i, j = np.nonzero(d <= np.minimum(d.min(axis=1), radius)[:, None] + SLACK)
            return i, j, d[i, j]
        first = np.flatnonzero(np.r_[True, way[1:] != way[:-1]])
        least = np.minimum.reduceat(d, first, axis=1)
        limit = np.full(len(x), radius if once else radius + SLACK)
        if most is not None and len(first) > most:
            limit = np.minimum(limit, np.partition(least, most - 1, axis=1)[:, most - 1] + SLACK)
        if once:
            i, j = np.nonzero(least <= limit[:, None])
            return i, first[j], least[i, j]
        sizes = np.diff(np.r_[first, len(way)])
        i, j = np.nonzero(d <= np.minimum(limit[:, None], np.repeat(least, sizes, axis=1) + SLACK))
        return i, j, d[i, j]
