"""Heat to the side of a candidate: ways that run along it, the heat on them, and the heat in between.

A candidate is a region of cells of one heat tile. Every step is a join on keys or grid cells and a grouping by sample or by
candidate; what a candidate holds is bounded by its tile, and at most ``MOST_SAMPLES`` of its cells look for ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathglow.functions.geo import axis_angle, segment_distance
from pathglow.operators.cells import cell, covering_cells
from pathglow.operators.lines import near_lines
from pathglow.operators.metrics import cover_metrics, even_sample, vote_winner
from pathglow.operators.shared import written

#: Metres: how far ways are looked for, half the window of a tangent, the surroundings that give a cell its direction, and
#: the least span of a tangent. Then: degrees that count as parallel, ways a sample looks at, cells that a direction needs,
#: samples of a region, and samples of heat on a line and between.
SEARCH, TANGENT_HALF, AROUND, LEAST_SPAN = 250.0, 20.0, 30.0, 1.0
PARALLEL, WIDE, MOST_WAYS, LEAST_CELLS, MOST_SAMPLES, ON_LINE, BETWEEN = 15, 30, 32, 5, 160, 80, 24

#: Digits of distances and angles; one less than those shown, so that a median halfway between two is exact.
DIGITS = 5


def moments(r: str = "r", c: str = "c") -> list[Column]:
    """Whole-number moments of cells, from which directions follow without rounding."""
    i, j = F.col(c).cast("long"), F.col(r).cast("long")
    n, si, sj = F.count("*"), F.sum(i), F.sum(j)
    return [n.alias("n"), si.alias("sc"), sj.alias("sr"), (n * F.sum(i * i) - si * si).alias("a"), (si * sj - n * F.sum(i * j)).alias("b"), (n * F.sum(j * j) - sj * sj).alias("d")]


def direction() -> list[Column]:
    """Main direction (ax, ay) of moments a, b, d, with y upwards; both null for cells that extend alike on all sides."""
    a, b, d = (F.col(x).cast("double") for x in "abd")
    root = F.sqrt((a - d) * (a - d) + 4 * b * b)
    x, y = F.when(a >= d, a - d + root).otherwise(2 * b), F.when(a >= d, 2 * b).otherwise(d - a + root)
    norm = F.sqrt(x * x + y * y)
    return [F.when(norm > 0, x / norm).alias("ax"), F.when(norm > 0, y / norm).alias("ay")]


def regions_of(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Each region's first cell, size, centre (r, c), direction, and mean and 90th percentile of its heat."""
    g = cells.groupBy(*keys).agg(*moments(), F.min(F.struct("r", "c")).alias("first"), F.avg("v").alias("own_mean"), F.percentile("v", F.lit(0.9)).alias("own_p90"))
    return g.select(*keys, "first", "n", (F.col("sr") / F.col("n")).alias("cr"), (F.col("sc") / F.col("n")).alias("cc"), *direction(), "own_mean", "own_p90")


def local_directions(samples: DataFrame, cells: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Gives samples (keys, r, c, ax, ay) the direction of their region's cells within ``reach`` cells, if these are enough."""
    around = covering_cells(F.col("c") - reach, F.col("r") - reach, F.col("c") + reach, F.col("r") + reach, reach)
    asked = samples.select(*keys, "r", "c", F.explode(around).alias("q")).select(*keys, "r", "c", "q.cx", "q.cy")
    held = cells.select(*keys, F.col("r").alias("nr"), F.col("c").alias("nc"), cell(F.col("c"), reach).alias("cx"), cell(F.col("r"), reach).alias("cy"))
    near = (F.col("nr") - F.col("r")) ** 2 + (F.col("nc") - F.col("c")) ** 2 <= reach * reach
    local = asked.join(held, [*keys, "cx", "cy"]).where(near).groupBy(*keys, "r", "c").agg(*moments("nr", "nc")).where(F.col("n") >= LEAST_CELLS)
    x, y = direction()
    joined = samples.join(local.select(*keys, "r", "c", x.alias("lx"), y.alias("ly")), [*keys, "r", "c"], "left")
    return joined.withColumn("ax", F.coalesce("lx", "ax")).withColumn("ay", F.when(F.col("lx").isNull(), F.col("ay")).otherwise(F.col("ly"))).drop("lx", "ly")


def measured(segments: DataFrame) -> DataFrame:
    """Segments (way_id, pos, ends) that have a length, numbered along their way, with where they begin and end on it."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = Window.partitionBy("way_id").orderBy("pos")
    rows = segments.withColumn("len", F.sqrt(dx * dx + dy * dy)).where("len > 0").withColumn("place", F.row_number().over(along)).withColumn("m2", F.sum("len").over(along))
    return rows.withColumn("m1", F.coalesce(F.lag("m2").over(along), F.lit(0.0))).withColumn("total", F.sum("len").over(Window.partitionBy("way_id"))).drop("pos")


def projected(px: str, py: str) -> Column:
    """How far along a segment (x1, y1, x2, y2, len) the place nearest to a point lies, from 0 to 1."""
    dot = (F.col(px) - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col(py) - F.col("y1")) * (F.col("y2") - F.col("y1"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / (F.col("len") * F.col("len"))))


def tangents(pairs: DataFrame, ways: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the direction (tx, ty) of the way about ``along`` to pairs (keys, way_id, along, total): from the point half a
    window before to the point half a window after, on the way. Pairs whose way is shorter than the least span go.
    """
    span = F.least(F.lit(TANGENT_HALF), F.col("total") / 2)
    cut = pairs.withColumn("s", F.greatest(F.lit(0.0), F.col("along") - span)).withColumn("e", F.least("total", F.col("along") + span)).where(F.col("e") - F.col("s") >= LEAST_SPAN)
    met = cut.join(ways.drop("total"), "way_id").where((F.col("m2") >= F.col("s")) & (F.col("m1") <= F.col("e")))

    def at(m: str) -> list[Column]:
        t = (F.col(m) - F.col("m1")) / F.col("len")
        return [F.col("x1") + t * (F.col("x2") - F.col("x1")), F.col("y1") + t * (F.col("y2") - F.col("y1"))]

    (sx, sy), (ex, ey) = at("s"), at("e")
    others = [F.first(c).alias(c) for c in pairs.columns if c not in (*keys, "way_id")]
    ends = met.groupBy(*keys, "way_id").agg(*others, F.min_by(F.struct(sx.alias("x"), sy.alias("y")), "place").alias("f"), F.max_by(F.struct(ex.alias("x"), ey.alias("y")), "place").alias("g"))
    return ends.withColumn("tx", F.col("g.x") - F.col("f.x")).withColumn("ty", F.col("g.y") - F.col("f.y")).drop("f", "g")


def parallel_ways(samples: DataFrame, ways: DataFrame, keys: list[str]) -> DataFrame:
    """For samples (keys, px, py, ax, ay): dist15, angle and way_id of the nearest parallel way, dist30 of the nearest widely
    parallel one; null where the ``MOST_WAYS`` nearest ways within ``SEARCH`` hold none. Ties go to the least way.
    """
    ends = ("x1", "y1", "x2", "y2")
    hits = near_lines(samples.select(*keys, "px", "py"), ways, SEARCH, [*keys, "px", "py"], ["way_id", "place", "m1", "len", "total", *ends]).drop("d")
    hits = hits.withColumn("dist", F.round(segment_distance(*(F.col(c) for c in ("px", "py", *ends))), DIGITS)).where(F.col("dist") <= SEARCH)
    hits = hits.withColumn("along", F.col("m1") + projected("px", "py") * F.col("len"))
    each = hits.groupBy(*keys, "way_id").agg(F.min_by(F.struct("dist", "along", "total"), F.struct("dist", "place")).alias("b")).select(*keys, "way_id", "b.*")
    ranked = each.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("dist", "way_id"))).where(F.col("_rn") <= MOST_WAYS).drop("_rn")
    turned = tangents(ranked, ways, keys).join(samples.select(*keys, "ax", "ay"), keys)
    angle = F.round(axis_angle(F.col("ax"), F.col("ay"), F.col("tx"), F.col("ty")), DIGITS)
    best = F.struct("dist", "way_id", "angle")
    near = F.min(F.when(F.col("angle") <= PARALLEL, best))
    found = turned.withColumn("angle", angle).groupBy(*keys).agg(near.alias("b"), F.min(F.when(F.col("angle") <= WIDE, F.col("dist"))).alias("dist30"))
    return samples.select(*keys).join(found, keys, "left").select(*keys, F.col("b.dist").alias("dist15"), "dist30", F.col("b.way_id").alias("way_id"), F.col("b.angle").alias("angle"))


def points_on_lines(lines: DataFrame, keys: list[str], side: int, most: int) -> DataFrame:
    """Even steps of at most one cell along the parts of lines inside a tile of ``side`` cells, as cells (keys, i, r, c).

    ``lines`` (keys, place, r1, c1, r2, c2) are the pieces of one line a key, in cells. A part that stays inside is stepped
    from end to end, with two points at least; of a key's points in the tile the first ``most`` count. A line without length has no points.
    """
    def reach(a: str, b: str) -> tuple[Column, Column]:
        step = F.col(b) - F.col(a)
        inside = F.col(a).between(0, side)
        u, v = (0 - F.col(a)) / F.nullif(step, F.lit(0.0)), (side - F.col(a)) / F.nullif(step, F.lit(0.0))
        return F.when(step == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(u, v)), F.when(step == 0, 1.0).otherwise(F.greatest(u, v))

    (ra, rb), (ca, cb) = reach("r1", "r2"), reach("c1", "c2")
    cut = lines.withColumn("ta", F.greatest(F.lit(0.0), ra, ca)).withColumn("tb", F.least(F.lit(1.0), rb, cb)).where("tb > ta")
    line = Window.partitionBy(*keys).orderBy("place")
    goes_on = (F.lag("place").over(line) == F.col("place") - 1) & (F.lag("tb").over(line) == 1) & (F.col("ta") == 0)
    cut = cut.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("_new").over(line))
    length = (F.col("tb") - F.col("ta")) * F.hypot(F.col("r2") - F.col("r1"), F.col("c2") - F.col("c1"))
    part, whole = Window.partitionBy(*keys, "part").orderBy("place"), Window.partitionBy(*keys, "part")
    # a piece of no length, such as from a centre on the way to the way, joins its neighbours but has no steps
    cut = cut.withColumn("len", length).where("len > 0").withColumn("to", F.sum("len").over(part)).withColumn("from", F.coalesce(F.lag("to").over(part), F.lit(0.0))).withColumn("last", F.lead("place").over(part).isNull()).withColumn("whole", F.max("to").over(whole))
    cut = cut.withColumn("steps", F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(F.round("whole", 6)) + 1)) - 1).withColumn("step", F.col("whole") / F.col("steps"))
    first, end = F.ceil(F.col("from") / F.col("step")), F.when(F.col("last"), F.col("steps")).otherwise(F.ceil(F.col("to") / F.col("step")) - 1)
    at = cut.where(first <= end).withColumn("i", F.explode(F.sequence(first, end)))
    t = F.col("ta") + (F.col("i") * F.col("step") - F.col("from")) / F.col("len") * (F.col("tb") - F.col("ta"))
    spots = at.select(*keys, "part", "i", *[_near(F.col(a) + t * (F.col(b) - F.col(a))).alias(n) for n, a, b in (("r", "r1", "r2"), ("c", "c1", "c2"))])
    inside = spots.where(F.col("r").between(0, side - 1) & F.col("c").between(0, side - 1))
    return inside.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("part", "i"))).where(F.col("i") <= most).drop("part")


def _near(place: Column) -> Column:
    return F.bround(F.round(place, 6)).cast("int")


def points_on_axis(cells: DataFrame, regions: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Steps along each region's direction through its centre, from its first cell to its last; one point if it is short."""
    t = (F.col("c") - F.col("cc")) * F.col("ax") - (F.col("r") - F.col("cr")) * F.col("ay")
    ends = cells.join(regions, keys).where("n >= 2 and ax is not null").groupBy(*keys).agg(F.min(t).alias("t0"), F.max(t).alias("t1"), *[F.first(x).alias(x) for x in ("cr", "cc", "ax", "ay")])
    span = F.col("t1") - F.col("t0")
    steps = F.when(F.round(span, 6) < 1, 0).otherwise(F.least(F.lit(ON_LINE), F.greatest(F.lit(2), _near(span) + 1)) - 1)
    at = ends.withColumn("steps", steps).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    s = F.when(F.col("steps") == 0, 0.0).otherwise(F.col("t0") + span * F.col("i") / F.col("steps"))
    spots = at.select(*keys, "i", _near(F.col("cr") - s * F.col("ay")).alias("r"), _near(F.col("cc") + s * F.col("ax")).alias("c"))
    return spots.where(F.col("r").between(0, side - 1) & F.col("c").between(0, side - 1))


def region_samples(cells: DataFrame, left: Column, top: Column, pixel: float, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The regions of cells (keys, r, c, v), and of each region at most ``MOST_SAMPLES`` cells, evenly along its axis: keys, r, c,
    place (px, py) and local direction (ax, ay)."""
    regions = written(regions_of(cells, keys), "regions")
    x, y = left + F.col("c") * pixel, top - F.col("r") * pixel
    order = F.round(F.col("c") * F.coalesce("ax", F.lit(0.0)) - F.col("r") * F.coalesce("ay", F.lit(0.0)), 6)
    spread = cells.join(regions.select(*keys, "ax", "ay"), keys).withColumn("_o", F.struct(order, "r", "c"))
    samples = even_sample(spread, F.struct(*keys), F.col("_o"), MOST_SAMPLES).select(*keys, "r", "c", "ax", "ay", x.alias("px"), y.alias("py"))
    return regions, written(local_directions(samples, cells, keys, AROUND / pixel), "samples")


def lateral_metrics(cells: DataFrame, segments: DataFrame, heat: DataFrame, left: Column, top: Column, pixel: float, side: int, tile: str = "tile", region: str = "comp") -> DataFrame:
    """One row a candidate: cover by parallel ways, the way that most samples chose, the heat along the candidate's axis, on
    that way and between the two, and the halo score: the weaker of the latter two by the candidate's own 90th percentile.

    ``cells`` (tile, region, r, c, v) are the candidates' cells, ``heat`` (tile, r, c, v) all cells, absent ones 0. ``left``
    and ``top`` are expressions of the tile for the place of its cell (0, 0); a cell is ``pixel`` wide, a tile ``side`` cells.
    A candidate without a parallel way has covers of 0 and nulls; regions without a direction have no parallel way. Segments
    without length are left out.
    """
    keys = [tile, region]
    regions, samples = region_samples(cells, left, top, pixel, keys)
    ways = written(measured(segments), "ways")
    met = written(parallel_ways(samples, ways, [*keys, "r", "c"]), "parallel-ways").withColumn("key", F.struct(*keys))
    cover = cover_metrics(met, "key")
    won = written(vote_winner(met.where("way_id is not null").withColumn("dist", F.col("dist15")), "key", "way_id").select("key.*", "way_id", "votes", "d_median", "d_min", "angle_median"), "winners")
    centres = won.select(*keys, "way_id").join(regions.select(*keys, "cr", "cc"), keys).select("*", (left + F.col("cc") * pixel).alias("px"), (top - F.col("cr") * pixel).alias("py"))
    pieces = centres.join(ways.select("way_id", "place", "x1", "y1", "x2", "y2", "len"), "way_id")
    to_cells = lambda a, b, n: [((top - b) / pixel).alias(f"r{n}"), ((a - left) / pixel).alias(f"c{n}")]
    on_way = pieces.select(*keys, "place", *to_cells(F.col("x1"), F.col("y1"), 1), *to_cells(F.col("x2"), F.col("y2"), 2))
    t = projected("px", "py")
    foot = F.struct((F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"))
    dist = F.round(segment_distance(*(F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2"))), DIGITS)
    feet = pieces.groupBy(*keys).agg(F.first("cr").alias("r1"), F.first("cc").alias("c1"), F.min_by(foot, F.struct(dist, "place")).alias("f"))
    between = feet.select(*keys, F.lit(1).alias("place"), F.col("r1"), F.col("c1"), *to_cells(F.col("f.x"), F.col("f.y"), 2))
    spots = points_on_axis(cells, regions, keys, side).withColumn("kind", F.lit("axis"))
    for kind, lines, most in (("way", on_way, ON_LINE), ("between", between, BETWEEN)):
        spots = spots.unionByName(points_on_lines(lines, keys, side, most).withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    seen = spots.join(heat.select(tile, "r", "c", "v"), [tile, "r", "c"], "left").withColumn("v", F.coalesce("v", F.lit(0)))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("v"))
    figures = [f(of(k)).alias(f"{k}_{n}") for k in ("axis", "way") for n, f in (("mean", F.avg), ("p90", lambda v: F.percentile(v, F.lit(0.9))), ("n", F.count))]
    stats = seen.groupBy(*keys).agg(*figures, F.median(of("between")).alias("between_median"))
    rows = regions.join(cover.select("key.*", *[c for c in cover.columns if c != "key"]), keys).join(won, keys, "left").join(stats, keys, "left")
    halo = F.least("way_p90", "between_median") / F.col("own_p90")
    shown = {c: F.col(c) for c in ("own_mean", "own_p90", "axis_mean", "axis_p90", "way_mean", "way_p90", "between_median")}
    shown |= {"ratio_mean": F.col("way_mean") / F.nullif("own_mean", F.lit(0.0)), "ratio_p90": F.col("way_p90") / F.nullif("own_p90", F.lit(0.0)), "between_ratio": F.col("between_median") / F.nullif("own_mean", F.lit(0.0))}
    shown["halo"] = F.when(F.col("way_p90").isNotNull() & F.col("between_median").isNotNull() & (F.col("own_p90") > 0), halo)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("votes", "axis_n", "way_n")]
    covers = [c for c in cover.columns if c != "key"]
    return rows.select(tile, "first.r", "first.c", "n", "way_id", "d_median", "d_min", "angle_median", *covers, *counts, *[F.round(e, 4).alias(n) for n, e in shown.items()])
