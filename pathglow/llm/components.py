"""Connected components by alternating large-star and small-star rounds, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglow.llm.common import removed, shared_path, written_at


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round. Each node u learns m, its least neighbour (or itself) and hands m to its neighbours.

    The minimum is a partial aggregate and the hand-out an equi-join of sorted sides, so a hub is never gathered in one task and no
    list of nodes in the driver.
    """
    pairs = _both_ways(edges)
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = pairs.join(least.hint("merge"), "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.where(F.col("v") <= F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns node, component (least node reachable) for every node that has an edge.

    ``edges`` has long columns a and b in either direction; loops and repeats are harmless, and rows with a null
    end are ignored. An empty table gives no rows. Every round is written to the shared folder and the one before it is
    removed; the driver sees only two sums a round, which stop the loop when a round changes nothing.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = shared_path(edges.sparkSession, "links")
    now, seen = written_at(now, path), None
    for _ in range(max_rounds):
        # decimal sums cannot overflow; the hash sum tells apart sets of equal size
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        spent, path = path, shared_path(edges.sparkSession, "links")
        now = written_at(_star(_star(now, large=True), large=False), path)
        removed(edges.sparkSession, spent)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
