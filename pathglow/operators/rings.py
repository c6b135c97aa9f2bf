"""Rings from the member lines of relations, assembled over all relations at once.

The ends of lines that lie on one point are joined in pairs. A line that is closed is a ring alone. Where two ends meet
they are a pair. Where more meet, they pair in the order of the members: first with second, third with fourth; an end that is left over stays free. Each line
can be walked in two directions, and each walk is followed by one other at most, that of the line whose end is the pair of
its last. Rings are the cycles of this order, and what does not close is a chain. Both are found by pointer jumping: in round k
each walk knows the least member among the 2^k that follow, how far ahead it is, and the walk behind these; a round
joins these with one another. So rounds grow with the logarithm of the longest ring, a relation is never
gathered in one task, and only a ring's own lines meet, to become its geometry.

A walk that takes the first free member at each point, one ring after the other, gives the same rings wherever no point joins more than two ends;
where more meet, what is free there hangs on the walk before, while pairs are told by the point alone.

Defined cases: a ring begins with its least member in that member's own direction, a chain is one row in the direction of
its least member, not closed; a ring has four points or more; joints are given once; lines of fewer than two points, with a null
relation or null points, are left out; equal members are joined like any others; members with equal places are told apart by
their points, and equal ones by chance, which changes no ring. An empty table gives no rows. All ends on one point meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathglow.operators.shared import removed, written


def _walks(lines: DataFrame) -> DataFrame:
    """id, then, best and n for both walks of each open line: best is the least member from here on, n their number."""
    ends = lines.where("not alone").select("key", "line", "pos", F.explode(F.array(*[F.struct(F.lit(e).alias("end"), x.alias("x"), y.alias("y")) for e, x, y in ((0, F.col("x0"), F.col("y0")), (1, F.col("x1"), F.col("y1")))])).alias("e"))
    here = Window.partitionBy("key", "e.x", "e.y").orderBy("pos", "line", "e.end")
    walk = 2 * F.col("line") + F.col("e.end")  # of the line as entered at this end
    met = ends.select("line", "pos", "e.end", walk.alias("walk"), F.row_number().over(here).alias("place"), F.lead(walk).over(here).alias("after"), F.lag(walk).over(here).alias("before"))
    # a walk leaves by the other end than it entered
    entered = 2 * F.col("line") + 1 - F.col("end")
    then = F.when(F.col("place") % 2 == 1, F.col("after")).otherwise(F.col("before"))
    return met.select(entered.alias("id"), then.alias("then"), F.struct("pos", "line", (1 - F.col("end")).alias("way"), F.lit(0).cast("long").alias("off")).alias("best"), F.lit(1).cast("long").alias("n"))


def _settled(walks: DataFrame, most_rounds: int = 62) -> DataFrame:
    """Walks as after so many rounds that nothing changes: ``then`` is null on chains, on rings best is the ring's."""
    now = written(walks, "walks")
    for _ in range(most_rounds):
        other = now.select(F.col("id").alias("o_id"), F.col("then").alias("o_then"), F.col("best").alias("o_best"), F.col("n").alias("o_n"))
        met = now.join(other, F.col("then") == F.col("o_id"), "left")
        ahead = F.struct("o_best.pos", "o_best.line", "o_best.way", (F.col("n") + F.col("o_best.off")).alias("off"))
        nearer = F.col("o_id").isNotNull() & (F.struct("o_best.pos", "o_best.line") < F.struct("best.pos", "best.line"))
        changed = nearer | (F.col("then").isNotNull() & F.col("o_then").isNull())
        step = met.select("id", F.col("o_then").alias("then"), F.when(nearer, ahead).otherwise(F.col("best")).alias("best"), (F.col("n") + F.coalesce("o_n", F.lit(0))).alias("n"), changed.alias("changed"))
        spent, now = now, written(step, "walks")
        removed(spent)
        if not now.where("changed").head(1):
            return now.drop("changed")
    raise RuntimeError("rings did not settle")


def _joined(parts: Column, axis: str) -> Column:
    """The points of lines in order, without those that repeat the joint before."""
    first = F.get(F.transform(parts, lambda p: p[axis]), F.lit(0))
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.slice(p[axis], 2, F.size(p[axis])))
    return F.concat(first, F.flatten(rest))


def merge_rings(members: DataFrame, key: str = "relation_id") -> DataFrame:
    """``key``, ring, points, closed, xs and ys from member lines (key, pos, xs, ys); ring is the least member's place."""
    able = members.where(F.col(key).isNotNull() & (F.size("xs") > 1) & (F.size("xs") == F.size("ys")) & ~F.exists("xs", lambda v: v.isNull()) & ~F.exists("ys", lambda v: v.isNull()))
    at = [(F.element_at(a, i)).alias(n) for i, a, n in ((1, "xs", "x0"), (1, "ys", "y0"), (-1, "xs", "x1"), (-1, "ys", "y1"))]
    lines = able.select(F.col(key).alias("key"), F.col("pos").cast("long").alias("pos"), "xs", "ys", *at)
    # equal places are told apart by the points, so that the order does not hang on partitions
    lines = written(lines.withColumn("alone", (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))).withColumn("line", F.monotonically_increasing_id()), "lines")
    walks = _settled(_walks(lines))

    line, way = F.floor(F.col("id") / 2).cast("long"), (F.col("id") % 2).cast("int")
    back = walks.select(F.col("id").bitwiseXOR(F.lit(1).cast("long")).alias("id"), F.col("best").alias("back"))
    both = walks.join(back, "id")
    # behind a chain's walk lies what the walk back sees: the least of both is the chain's, turned if it comes from there
    behind = F.col("then").isNull() & (F.struct("back.pos", "back.line") < F.struct("best.pos", "best.line"))
    root = F.when(behind, F.struct("back.pos", "back.line", (1 - F.col("back.way")).alias("way"))).otherwise(F.struct("best.pos", "best.line", "best.way"))
    # places count down: to the end of a chain, or to the ring's first member, which itself comes before all
    left = F.when(F.col("then").isNull(), F.col("n")).when(F.col("best.off") == 0, F.lit((1 << 62))).otherwise(F.col("best.off"))
    walked = both.select(line.alias("line"), way.alias("way"), root.alias("root"), left.alias("left")).where("root.way = 0")
    alone = lines.where("alone").select("line", F.lit(0).alias("way"), F.struct("pos", "line", F.lit(0).alias("way")).alias("root"), F.lit(0).cast("long").alias("left"))
    placed = lines.select("key", "line", "xs", "ys").join(walked.unionByName(alone), "line")
    turned = [F.when(F.col("way") == 1, F.reverse(c)).otherwise(F.col(c)).alias(c) for c in ("xs", "ys")]
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("order"), *turned)))
    rings = placed.groupBy("key", "root").agg(ordered.alias("parts")).select("key", "root.pos", _joined(F.col("parts"), "xs").alias("xs"), _joined(F.col("parts"), "ys").alias("ys"))
    closed = (F.size("xs") >= 4) & (F.get("xs", F.lit(0)) == F.element_at("xs", -1)) & (F.get("ys", F.lit(0)) == F.element_at("ys", -1))
    return rings.select(F.col("key").alias(key), F.col("pos").alias("ring"), F.size("xs").alias("points"), closed.alias("closed"), "xs", "ys")
