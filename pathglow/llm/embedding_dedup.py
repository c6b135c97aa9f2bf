"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated by a fixed random rotation and split into blocks of few dimensions. If two vectors lie within a
squared distance D, then in some block they lie within that block's share of D, which is proportional to its dimensions. So
every block is range-joined under its own budget, and the cosine of the union of candidates is verified exactly.

The rows of a label are dealt into parts, and each pair of parts is one tile: a task of bounded size. Inside a tile a block
cuts its rows at medians, as often as there are rows for it; a vector is at home in one cell and meets each cell that its
ball reaches. These replicas are indices in the task's memory. They are never shuffled, so a row crosses the network
once for each part of its label, four times at most up to half a million rows a label.

Equal vectors of a label are one node with a count. Rows so near to a common pivot that all must link with one another
are counted as a group, without forming their pairs. A tile returns, per node, a sum of links and one edge to the least node
that it connects it with, so the output grows with the nodes of the tile even where nearly all pairs link.

Defined cases: vectors that are null, empty or zero, or that hold null or non-finite components, and rows without a label
link with nothing and are components of their own; vectors of different lengths never link; components may be as large or as
small as a double allows; repeated rows count as other vectors; rows with a null id take part, and their component is null if
no row in it has an id; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathglow.llm.common import written
from pathglow.llm.components import connected_components

THRESHOLD, BLOCKS = 0.93, 8
#: A part of a label holds so many rows and so many bytes at most; up to four parts are smaller, so that tasks share the work.
PART_ROWS, PART_BYTES, SMALL_PART = 1 << 17, 128 << 20, 1 << 14
#: Rows that a cell of a block should hold at least.
CELL_ROWS = 256
#: Allowance for rounding in single precision: in a block's distance as it decides, and as it is screened.
SLACK, SCREEN = 1e-6, 1e-5
#: Distances that are taken at a time (they fit a core's cache), columns of them, and pairs that are verified at a time.
PRODUCTS, WIDE, PAIRS = 1 << 18, 2048, 100_000
PIVOTS, LEAST_GROUP = 64, 64


@lru_cache
def _layout(dims: int) -> tuple[np.ndarray, list[slice]]:
    """A rotation, the same in every process, and the blocks of rotated dimensions."""
    rotation, _ = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))
    edges = np.linspace(0, dims, min(BLOCKS, dims) + 1).astype(int).tolist()
    return rotation, [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _budgets(dims: int, threshold: float) -> np.ndarray:
    """Squared distance that each block may hold: its share, by dimensions, of that of the whole."""
    widths = np.array([b.stop - b.start for b in _layout(dims)[1]])
    return (2 - 2 * threshold) * widths / dims + SLACK


def _directions(raw: pa.Array, kind: str) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows or vanishes."""
    x = np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _as_bytes(vectors: DataFrame, kind: str) -> DataFrame:
    """Adds vec: the components' bytes, or null if the vector can link with nothing."""

    @F.arrow_udf("binary")
    def packed(column: pa.Array) -> pa.Array:
        out: list[bytes | None] = []
        offsets, flat = column.offsets.to_numpy(), column.values
        values = flat.to_numpy(zero_copy_only=False).astype(kind)  # null components become nan
        fine = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        for i, known in enumerate(column.is_valid().to_pylist()):
            a, b = offsets[i], offsets[i + 1]
            good = known and b > a and fine[b] == fine[a] and values[a:b].any()
            out.append((values[a:b] + 0.0).tobytes() if good else None)
        return pa.array(out, pa.binary())

    return vectors.withColumn("vec", packed(F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")))


def _parts_of(rows: Column, dims: Column, part_rows: int | None) -> Column:
    """Into how many parts the rows of a label are dealt."""
    if part_rows:
        return F.ceil(rows / part_rows)
    most = F.least(F.lit(PART_ROWS), F.greatest(F.lit(1024), F.floor(F.lit(PART_BYTES) / (12 * dims))))
    return F.greatest(F.ceil(rows / most), F.least(F.lit(4), F.ceil(rows / SMALL_PART)))


class Found:
    """The links of a tile: sums by row, and edges that connect all linked rows. Rows of the second side come after the first's."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.links = weight, np.zeros(len(weight), np.int64)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.links, a, self.weight[b])
        np.add.at(self.links, b, self.weight[a])
        self.left.append(a)
        self.right.append(b)

    def group(self, x: np.ndarray, y: np.ndarray, same: bool) -> None:
        """All rows of x link with all of y."""
        if same:
            self.links[x] += self.weight[x].sum() - self.weight[x]
        else:
            self.links[x] += self.weight[y].sum()
            self.links[y] += self.weight[x].sum()
        if len(x) and len(y):
            rows = np.r_[x, y]
            self.left.append(np.full(len(rows) - 1, rows[0]))
            self.right.append(rows[1:])

    def columns(self, node: np.ndarray) -> list[np.ndarray]:
        """node, links and least for the rows that have links here."""
        a, b = np.concatenate([*self.left, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*self.right, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(node)
        rank = np.empty(len(node), np.int64)
        rank[order] = np.arange(len(node))
        a, b, root = rank[a], rank[b], np.arange(len(node))
        while len(a):
            was, low = root.copy(), np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == was).all():
                break
        touched = np.zeros(len(node), bool)
        touched[a] = touched[b] = True
        return [node[order][touched], self.links[order][touched], node[order][root[touched]]]


def _groups(unit: np.ndarray, threshold: float) -> np.ndarray:
    """Number of the group of each row, or -1. Rows within half the radius of a pivot all lie within the radius of one another."""
    group = np.full(len(unit), -1)
    pivots = unit[:: max(1, len(unit) // PIVOTS)]
    least = 1 - (1 - threshold) / 4 + 1e-9
    inside = np.concatenate([unit[at : at + PAIRS] @ pivots.T >= least for at in range(0, len(unit), PAIRS)])
    for number in range(inside.shape[1]):
        sizes = inside.sum(0)
        best = int(sizes.argmax())
        if sizes[best] < LEAST_GROUP:
            break
        group[inside[:, best]] = number
        inside[inside[:, best]] = False
    return group


def _places(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few set cells of a mask whose rows are words of eight: words first, then the cells of those set."""
    words = np.flatnonzero(mask.reshape(-1).view(np.uint64))
    word, place = np.nonzero(mask.reshape(-1, 8)[words])
    return words[word] * 8 + place


def _near_in_block(x: np.ndarray, y: np.ndarray, budget: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that may lie within ``budget`` in a block, each once. With ``same`` x and y are the same rows."""
    cuts = min(x.shape[1], max(0, int(math.log2(max(1, min(len(x), len(y)) // CELL_ROWS)))))
    dims = np.argsort(-y.var(axis=0), kind="stable")[:cuts]
    middle = np.median(y[:, dims], axis=0) if cuts else np.zeros(0)
    power = 1 << np.arange(cuts)
    home, other = (x[:, dims] > middle) @ power, (y[:, dims] > middle) @ power
    order = np.argsort(home, kind="stable")
    starts = np.searchsorted(home[order], np.arange((1 << cuts) + 1))
    gap, above = ((y[:, dims] - middle) ** 2).astype(np.float32), y[:, dims] > middle
    left = np.c_[x, (x**2).sum(1) - np.float32(budget), np.ones(len(x))].astype(np.float32)
    right = np.c_[-2 * y, np.ones(len(y)), (y**2).sum(1)].astype(np.float32)
    bits = (np.arange(1 << cuts)[:, None] >> np.arange(cuts) & 1).astype(np.float32)
    left_rows, right_rows, held = [], [], 0
    base, turned = (gap * above).sum(1), gap * np.where(above, np.float32(-1), np.float32(1))
    for cell in range(1 << cuts):
        rows = order[starts[cell] : starts[cell + 1]]
        if not len(rows):
            continue
        # the squared gap between a row and the cell: that of the cuts on whose other side it lies
        reached = base + turned @ bits[cell] <= budget + SCREEN if cuts else np.ones(len(y), bool)
        near = np.flatnonzero(reached & (other >= cell) if same else reached)
        if not len(near):
            continue
        for first in range(0, len(near), WIDE):
            part = near[first : first + WIDE]
            width = -len(part) // 8 * -8
            facing = np.zeros((right.shape[1], width), np.float32)
            facing[:, : len(part)] = right[part].T
            facing[-1, len(part) :] = 1e9  # filled up to words of eight, which are near nothing
            step = max(1, PRODUCTS // width)
            for at in range(0, len(rows), step):
                i, j = np.divmod(_places(left[rows[at : at + step]] @ facing <= SCREEN), width)
                i, j = rows[at + i], part[j]
                if same:
                    once = (other[j] > cell) | (i < j)
                    i, j = i[once], j[once]
                left_rows.append(i)
                right_rows.append(j)
                held += len(i)
                if held >= PAIRS:
                    yield np.concatenate(left_rows), np.concatenate(right_rows)
                    left_rows, right_rows, held = [], [], 0
    if held:
        yield np.concatenate(left_rows), np.concatenate(right_rows)


def _join(found: Found, unit: np.ndarray, turned: np.ndarray, x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> None:
    """Adds the links between rows x and rows y. A pair counts in the first block that finds it."""
    dims = unit.shape[1]
    blocks, budgets = _layout(dims)[1], _budgets(dims, threshold)
    whole = 2 - 2 * threshold + SLACK
    for number, block in enumerate(blocks):
        after = np.ascontiguousarray(turned[:, blocks[(number + 1) % len(blocks)]])
        for i, j in _near_in_block(turned[x, block], turned[y, block], budgets[number], same):
            for at in range(0, len(i), PAIRS):
                a, b = x[i[at : at + PAIRS]], y[j[at : at + PAIRS]]
                # most candidates are already too far apart in the next block alone
                apart = after.take(a, axis=0) - after.take(b, axis=0)
                able = np.einsum("ij,ij->i", apart, apart) <= whole
                a, b = a[able], b[able]
                good = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                a, b = a[good], b[good]
                for earlier in range(number + 1):
                    if len(a):
                        apart = ((turned[a, blocks[earlier]].astype(np.float64) - turned[b, blocks[earlier]]) ** 2).sum(1)
                        keep = apart <= budgets[earlier] if earlier == number else apart > budgets[earlier]
                        a, b = a[keep], b[keep]
                if len(a):
                    found.pairs(a, b)


def tile_links(node: np.ndarray, weight: np.ndarray, side: np.ndarray, unit: np.ndarray, threshold: float) -> list[np.ndarray]:
    """node, links, least of a tile: all pairs of rows if ``side`` is 0 throughout, else those between its two sides."""
    found, same = Found(weight), not side.any()
    turned = (unit @ _layout(unit.shape[1])[0]).astype(np.float32)
    group = _groups(unit, threshold)
    todo = np.arange(len(node)) if same else np.flatnonzero(side == 0)
    across = todo if same else np.flatnonzero(side == 1)
    for number in np.unique(group[group >= 0]).tolist():
        found.group(todo[group[todo] == number], across[group[across] == number], same)
    loose = todo[group[todo] < 0]
    if same:
        # each group meets what comes after it: the later groups and the loose rows
        _join(found, unit, turned, loose, loose, True, threshold)
        for number in np.unique(group[group >= 0]).tolist():
            _join(found, unit, turned, np.flatnonzero(group == number), np.flatnonzero((group > number) | (group < 0)), False, threshold)
    else:
        _join(found, unit, turned, loose, across, False, threshold)
        for number in np.unique(group[group >= 0]).tolist():
            _join(found, unit, turned, todo[group[todo] == number], across[group[across] != number], False, threshold)
    return found.columns(node)


def _tiles(nodes: DataFrame, part_rows: int | None) -> tuple[DataFrame, int]:
    """Adds i, j and side, a row for each tile that a node is in, and returns how many tiles there are.

    A tile is a pair of parts i <= j of the rows of a label that have equal lengths; side tells in which of them the row is.
    """
    key = ["label", "dims"]
    sizes = nodes.groupBy(*key).agg(F.count("*").alias("rows")).select(*key, _parts_of(F.col("rows"), F.col("dims"), part_rows).cast("long").alias("parts"))
    sizes = written(sizes, "label-parts")
    tiles = sizes.agg(F.coalesce(F.sum(F.expr("parts * (parts + 1) div 2")), F.lit(0))).first()[0]
    own = nodes.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return met.select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "n", "vec"), tiles


def _links(nodes: DataFrame, threshold: float, part_rows: int | None, kind: str) -> DataFrame:
    """node, links, least; several rows a node."""
    key = ["label", "dims", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are sorted by tile; a tile may go on in the next batch
        now, rows = None, []
        for batch in batches:
            tiles = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
            starts = [k for k in range(len(tiles)) if not k or tiles[k] != tiles[k - 1]]
            for a, b in zip(starts, [*starts[1:], len(tiles)], strict=True):
                if tiles[a] != now:
                    yield from out(rows)
                    now, rows = tiles[a], []
                rows.append(batch.slice(a, b - a).select(["side", "node", "n", "vec"]))
        yield from out(rows)

    def out(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(r.num_rows for r in rows) < 2:
            return
        side, node, n = (np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("side", "node", "n"))
        unit = np.concatenate([_directions(r.column("vec"), kind) for r in rows])
        rows.clear()
        columns = tile_links(node, n, side, unit, threshold)
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "links", "least"])

    dealt, tiles = _tiles(nodes, part_rows)
    spread = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * tiles, 20_000))
    return dealt.repartition(spread, *key).sortWithinPartitions(*key).mapInArrow(run, "node long, links long, least long")


def embedding_components(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", part_rows: int | None = None) -> DataFrame:
    """``id_col``, n_links, component_id and kept, one row per vector. ``part_rows`` fixes the size of a label's parts."""
    slim = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"), F.col(label_col).cast("string").alias("label"))
    kind = "<f4" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "<f8"
    slim = written(_as_bytes(slim, kind).select("id", "label", F.when(F.col("label").isNotNull(), F.col("vec")).alias("vec")), "vectors")
    able = slim.where("vec is not null")
    dims = (F.octet_length("vec") / np.dtype(kind).itemsize).cast("int").alias("dims")
    nodes = able.groupBy("label", "vec").agg(F.min("id").alias("least_id"), F.count("*").alias("n")).select("*", dims, F.monotonically_increasing_id().alias("node"))
    nodes = written(nodes, "nodes")
    found = written(_links(nodes, threshold, part_rows, kind), "found")
    member = connected_components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    sums = found.groupBy(F.col("node").alias("counted")).agg(F.sum("links").alias("links"))
    known = nodes.select("node", "least_id", "n").join(sums, F.col("node") == F.col("counted"), "left").join(member.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    known = written(known.select("node", "least_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("root")), "linked")
    least = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(known.join(least, "root").select("node", "n_links", "component_id"), "named")
    joined = able.join(nodes.select("label", "vec", "node"), ["label", "vec"]).join(named, "node").select("id", "n_links", "component_id")
    alone = slim.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
