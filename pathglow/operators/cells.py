"""Spatial joins by grid cells: equi-joins that Spark can shuffle, with exact predicates behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathglow.operators.shared import written


def cell(x: Column, size: float | Column) -> Column:
    return F.floor(x / size).cast("long")


def covering_cells(x1: Column, y1: Column, x2: Column, y2: Column, size: float) -> Column:
    """All cells that a small box meets, as an array of (cx, cy); ``over_cells`` is for boxes of any size."""
    xs, ys = F.sequence(cell(x1, size), cell(x2, size)), F.sequence(cell(y1, size), cell(y2, size))
    return F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def over_cells(boxes: DataFrame, x1: Column, y1: Column, x2: Column, y2: Column, size: float | Column, cx: str, cy: str) -> DataFrame:
    """A row for each cell that a row's box meets, columns before cells: no array is longer than one side of the box."""
    columns = boxes.withColumn("_y", F.struct(cell(y1, size).alias("a"), cell(y2, size).alias("b"))).withColumn(cx, F.explode(F.sequence(cell(x1, size), cell(x2, size))))
    return columns.withColumn(cy, F.explode(F.sequence("_y.a", "_y.b"))).drop("_y")


def near_pairs(left: DataFrame, right: DataFrame, radius: float, distance: Column, lx: str = "lx", ly: str = "ly", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """Pairs of points within ``radius`` in the plane, with their distance, each pair once.

    Left points stand in one cell, right points in all that their neighbourhood meets, nine at most. Cells are as wide as
    the radius, so a crowded area spreads over many of them.
    """
    spread = right.withColumn("_c", F.explode(covering_cells(F.col(rx) - radius, F.col(ry) - radius, F.col(rx) + radius, F.col(ry) + radius, radius)))
    spread = spread.select("*", F.col("_c.cx").alias("_rcx"), F.col("_c.cy").alias("_rcy")).drop("_c")
    homes = left.withColumn("_lcx", cell(F.col(lx), radius)).withColumn("_lcy", cell(F.col(ly), radius))
    joined = homes.join(spread, (F.col("_lcx") == F.col("_rcx")) & (F.col("_lcy") == F.col("_rcy")))
    return joined.withColumn("dist", distance).where(F.col("dist") <= radius).drop("_lcx", "_lcy", "_rcx", "_rcy")


def near_boxes(points: DataFrame, boxes: DataFrame, radius: float, size: float, x: str = "px", y: str = "py", box: Sequence[str] = ("x1", "y1", "x2", "y2"), on: Sequence[str] = (), most_levels: int | None = None) -> DataFrame:
    """Points and boxes no farther apart than ``radius`` in either direction, each pair once; with ``on``, of equal columns.

    A box stands at the level whose cells, ``size`` wide and doubling from level to level, are half as wide as it is with its
    margin, so in nine cells at most, whatever its extent; a point looks at one cell a level. The driver learns the highest level, unless it
    is told that in ``most_levels``. Boxes with a bound that is null or not finite meet nothing.
    """
    a, b, c, d = (F.col(n) for n in box)
    able = boxes.where(" and ".join(f"`{n}` between -1e300 and 1e300" for n in box))
    extent = F.greatest(c - a, d - b) + 2 * radius
    level = F.greatest(F.ceil(F.log2(extent / (2 * size))), F.lit(0)).cast("int")
    if most_levels is None:
        most_levels = able.agg(F.max(level)).first()[0] or 0
    able = able.withColumn("_bl", F.least(level, F.lit(most_levels)))
    side = size * F.pow(F.lit(2.0), F.col("_bl"))
    spread = over_cells(able, a - radius, b - radius, c + radius, d + radius, side, "_bx", "_by")
    looks = F.array(*[F.struct(F.lit(k).alias("l"), cell(F.col(x), size * 2.0**k).alias("x"), cell(F.col(y), size * 2.0**k).alias("y")) for k in range(most_levels + 1)])
    homes = points.withColumn("_look", F.explode(looks))
    inside = F.col(x).between(a - radius, c + radius) & F.col(y).between(b - radius, d + radius)
    same = (F.col("_look.l") == F.col("_bl")) & (F.col("_look.x") == F.col("_bx")) & (F.col("_look.y") == F.col("_by"))
    if on:
        homes, spread = homes.alias("_homes"), spread.alias("_spread")
        for name in on:
            same = same & (F.col(f"_homes.{name}") == F.col(f"_spread.{name}"))
        joined = homes.join(spread, same & inside)
        return joined.select(*[F.col(f"_homes.{n}") for n in points.columns], *[F.col(f"_spread.{n}") for n in boxes.columns if n not in on])
    return homes.join(spread, same & inside).drop("_look", "_bl", "_bx", "_by")


def meeting_boxes(left: DataFrame, right: DataFrame, size: float, ours: Sequence[str], theirs: Sequence[str]) -> DataFrame:
    """Pairs of boxes that meet, each once: both stand in all cells that they meet, and a pair counts in the cell of the
    corner where its common part begins. ``size`` should be about the extent of the larger kind."""
    a, b = [F.col(n) for n in ours], [F.col(n) for n in theirs]
    x, y = over_cells(left, *a, size, "_lx", "_ly"), over_cells(right, *b, size, "_rx", "_ry")
    meet = (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])
    first = (F.col("_lx") == cell(F.greatest(a[0], b[0]), size)) & (F.col("_ly") == cell(F.greatest(a[1], b[1]), size))
    return x.join(y, (F.col("_lx") == F.col("_rx")) & (F.col("_ly") == F.col("_ry")) & meet & first).drop("_lx", "_ly", "_rx", "_ry")


def nearest(pairs: DataFrame, key: str, other: str, keep: Sequence[str] = ()) -> DataFrame:
    """The least distant partner of each key; ties go to the least partner. A partial aggregate, no window."""
    best = F.min_by(F.struct(other, "dist", *keep), F.struct("dist", other))
    return pairs.groupBy(key).agg(best.alias("_b")).select(key, f"_b.{other}", "_b.dist", *[f"_b.{k}" for k in keep])


def top_near(pairs: DataFrame, key: str, other: str, most: int) -> DataFrame:
    """The ``most`` least distant partners of each key, ranked from 1."""
    order = Window.partitionBy(key).orderBy("dist", other)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def nearest_by_ladder(left: DataFrame, right: DataFrame, radii: Sequence[float], distance: Column, key: str, other: str, coordinates: Sequence[str] = ("lx", "ly", "rx", "ry")) -> DataFrame:
    """The nearest partner, however far it is; only an empty right side leaves keys without one.

    Only keys that found none within a radius try the next, wider one. Those that find none in the last go down a quadtree.
    """
    lx, ly, rx, ry = coordinates
    found, todo = None, left
    for radius in radii:
        step = written(nearest(near_pairs(todo, right, radius, distance, *coordinates), key, other), "nearest")
        found = step if found is None else found.unionByName(step)
        todo = todo.join(step.select(key), key, "left_anti")
    # of equal points only the least takes part, so that a crowded place is one object
    distinct = right.groupBy(rx, ry).agg(F.min(other).alias(other)).select(other, rx, ry, *[F.col(c).alias(n) for n, c in zip(BOX, (rx, ry, rx, ry), strict=True)])
    far = nearest_of_all(todo, distinct, key, other, distance, radii[-1], lx, ly)
    return found.unionByName(far)


BOX = ("x1", "y1", "x2", "y2")
#: Cells of a cell along each side, objects that a cell of the finest level should hold at most, levels at most, and levels
#: between two written tables; pairs that are few, and objects a cell that are few whatever the number of pairs.
FAN, CROWD, MOST_LEVELS, WRITE_EVERY, PAIRS, MEAN = 8, 1024, 16, 4, 1 << 22, 32


def nearest_of_all(points: DataFrame, objects: DataFrame, key: str, other: str, distance: Column, size: float, x: str = "px", y: str = "py", slack: float = 1e-5, by: Sequence[str] = (), most: int = 1) -> DataFrame:
    """The ``most`` nearest objects of each point, without a limit of distance; ties within ``slack`` are decided by ``distance``.

    ``by`` names columns of points and objects that must be equal, such as a class: one descent then serves all classes, as
    cells are told apart by them too. Objects have a box (x1, y1, x2, y2) and stand in the cell of its centre. A quadtree of cells, each with the box around
    its objects and their number, is descended level by level: of a point's cells those stay whose box begins no
    farther than enough objects surely lie. A level is one equi-join with the cells of the next and a window over the
    few cells of a point. Down to cells ``FAN`` times ``size`` wide the points of such a cell go together, as one box. Objects are counted in cells of that
    width; in finer ones only those are that points still ask for, and only where these hold a crowd or make many pairs. So what is shuffled hangs on the
    cells that are asked for, not on all objects. The driver learns
    extents, crowds and numbers of pairs, and at most nine cells for each value of ``by``. Points without coordinates, or with ones that are not finite, and objects without such a box have no partner.
    With ``most`` above 1 there is a rank, from 1.
    """
    a, b, c, d = (F.col(n) for n in BOX)
    ids, kept = [key, *by], [key, *by, x, y]
    points = written(points.select(*kept).where(f"`{x}` between -1e300 and 1e300 and `{y}` between -1e300 and 1e300"), "far-points")
    objects = objects.where(" and ".join(f"{n} between -1e300 and 1e300" for n in BOX))
    ranked = [F.lit(None).cast("int").alias("rank")] if most > 1 else []
    empty = points.select(*ids).join(objects.select(other).limit(0), F.lit(False)).select(*ids, other, F.lit(None).cast("double").alias("dist"), *ranked)
    if not points.head(1):
        return empty
    u, v, wide = (a + c) / 2, (b + d) / 2, size * FAN
    around = F.min(a).alias("_a"), F.min(b).alias("_b"), F.max(c).alias("_c"), F.max(d).alias("_d"), F.count("*").alias("_n")

    def counted(rows: DataFrame, side: float) -> DataFrame:
        return rows.groupBy(*by, cell(u, side).alias("_cx"), cell(v, side).alias("_cy")).agg(*around)

    base = written(counted(objects, wide), "cells")
    extent = base.agg(*[f(n) for n in ("_cx", "_cy") for f in (F.min, F.max)]).first()
    if extent[0] is None:
        return empty

    def level(k: int) -> DataFrame:
        place = [F.floor(F.col(n) / FAN**k).alias(n) for n in ("_cx", "_cy")]
        return base.groupBy(*by, *place).agg(F.min("_a").alias("_a"), F.min("_b").alias("_b"), F.max("_c").alias("_c"), F.max("_d").alias("_d"), F.sum("_n").alias("_n")) if k else base

    levels = 0
    while levels < MOST_LEVELS and max(extent[1] - extent[0], extent[3] - extent[2]) >= 2 * FAN**levels:
        levels += 1

    def bounded(rows: DataFrame, who: Sequence[str], box: Sequence[str]) -> DataFrame:
        """The cells that the rows' points may need; ``who`` names a row's points and ``box`` the columns of the box around them."""
        pa, pb, pc, pd = (F.col(n) for n in box)
        zero = F.lit(0.0)
        near = F.sqrt(F.greatest(F.col("_a") - pc, pa - F.col("_c"), zero) ** 2 + F.greatest(F.col("_b") - pd, pb - F.col("_d"), zero) ** 2)
        far = F.sqrt(F.greatest(F.abs(pc - F.col("_a")), F.abs(pa - F.col("_c"))) ** 2 + F.greatest(F.abs(pd - F.col("_b")), F.abs(pb - F.col("_d"))) ** 2)
        mine = Window.partitionBy(*who)
        rows = rows.withColumn("_near", near).withColumn("_far", far)
        if most > 1:  # as far as so many objects surely lie; if there are not so many, everywhere
            rows = rows.withColumn("_sure", F.sum("_n").over(mine.orderBy("_far"))).withColumn("_far", F.when(F.col("_sure") >= most, F.col("_far")))
        rows = rows.withColumn("_reach", F.min("_far").over(mine) + slack)
        return rows.where("_reach is null or _near <= _reach").select(*dict.fromkeys([*who, *box]), "_cx", "_cy", "_n")

    # the points of a cell together, down to the cells that all objects are counted in
    home, places = (*by, "_qx", "_qy"), ("_pa", "_pb", "_pc", "_pd")
    homes = points.withColumn("_qx", cell(F.col(x), wide)).withColumn("_qy", cell(F.col(y), wide))
    groups = homes.groupBy(*home).agg(*[f(n).alias(p) for p, f, n in zip(places, (F.min, F.min, F.max, F.max), (x, y, x, y), strict=True)])
    top = level(levels).collect()
    cells_of = F.array(*[F.struct(*[F.lit(r[n]).alias(n) for n in ("_cx", "_cy", "_a", "_b", "_c", "_d", "_n")], *[F.lit(r[n]).alias(f"_of_{n}") for n in by]) for r in top])
    start = groups.withColumn("_cell", F.explode(cells_of)).select(*home, *places, "_cell.*")
    for n in by:
        start = start.where(F.col(n) == F.col(f"_of_{n}")).drop(f"_of_{n}")
    now = bounded(start, home, places)
    for k in range(levels - 1, -1, -1):
        children = level(k).withColumn("_px", F.floor(F.col("_cx") / FAN)).withColumn("_py", F.floor(F.col("_cy") / FAN))
        now = bounded(now.drop("_n").withColumnsRenamed({"_cx": "_px", "_cy": "_py"}).join(children, [*by, "_px", "_py"]), home, places)
        if k % WRITE_EVERY == 0 and k:
            now = written(now, "far-cells")
    asked = homes.join(now.select(*home, "_cx", "_cy"), list(home)).join(base, [*by, "_cx", "_cy"])
    now, side, before = written(bounded(asked, ids, (x, y, x, y)), "far-cells"), wide, None
    while True:
        crowd, pairs, n = now.agg(F.max("_n"), F.sum("_n"), F.count("*")).first()
        if crowd is None:
            return empty
        few = crowd <= max(CROWD, most) and pairs <= max(PAIRS, MEAN * n)
        if few or (crowd, pairs) == before or max(map(abs, extent)) * wide / side > 1 << 40:  # smaller cells would not part equal places
            break
        # finer cells of those objects only that points ask for
        cells_asked = written(now.select(*by, "_cx", "_cy").distinct(), "asked-cells")
        objects = written(objects.withColumn("_cx", cell(u, side)).withColumn("_cy", cell(v, side)).join(cells_asked, [*by, "_cx", "_cy"], "left_semi").drop("_cx", "_cy"), "asked")
        side, before = side / FAN, (crowd, pairs)
        children = counted(objects, side).withColumn("_px", F.floor(F.col("_cx") / FAN)).withColumn("_py", F.floor(F.col("_cy") / FAN))
        now = written(bounded(now.drop("_n").withColumnsRenamed({"_cx": "_px", "_cy": "_py"}).join(children, [*by, "_px", "_py"]), ids, (x, y, x, y)), "far-cells")
    held = objects.withColumn("_cx", cell(u, side)).withColumn("_cy", cell(v, side))
    met = now.drop("_n").join(held, [*by, "_cx", "_cy"]).withColumn("dist", distance)
    if most > 1:
        best = Window.partitionBy(*ids).orderBy("dist", other)
        return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select(*ids, other, "dist", "rank")
    return met.groupBy(*ids).agg(F.min_by(F.struct(other, "dist"), F.struct("dist", other)).alias("_b")).select(*ids, f"_b.{other}", "_b.dist")


def farther_than(left: DataFrame, right: DataFrame, radius: float, distance: Column, key: str, other: str) -> tuple[DataFrame, DataFrame]:
    """Left rows with no right row within ``radius``, and those removed with their nearest right row."""
    removed = nearest(near_pairs(left, right, radius, distance), key, other)
    return left.join(removed.select(key), key, "left_anti"), removed


def preferred_radius(pairs: DataFrame, key: str, inner: float) -> DataFrame:
    """Pairs within ``inner``, but all pairs of those keys that have none so near."""
    near = F.bool_or(F.col("dist") <= inner).over(Window.partitionBy(key))  # a window: a join would make the pairs twice
    return pairs.withColumn("_near", near).where(~F.col("_near") | (F.col("dist") <= inner)).drop("_near")
