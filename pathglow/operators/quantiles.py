"""Exact percentiles of few, large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathglow.operators.shared import written

#: Different values of a group up to which one task may hold them all.
HELD = 1_000_000


FIGURES = ("n", "low", "high", "mean", "q")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: Sequence[float], held: int = HELD) -> DataFrame:
    """keys, n, low, high, mean and q: exact percentiles with interpolation, an array in the order of ``shares``.

    Equal values are counted first, map-side. Groups with at most about ``held`` different values, which one aggregate tells beforehand,
    are finished from these counts in one more, and nothing is written. Otherwise counts are written and sorted by range over all tasks, what lies before each task's share of a group is
    summed from one number a task, and only the rows at the wanted ranks are kept: no group is gathered, whatever its size.
    Nulls in ``value`` do not count; a group of nulls alone has n 0 and no figures. Null keys form a group. Without keys there
    is one row, for an empty table too. Keys may have any name but those of the figures, which raise.
    """
    if clash := set(keys) & set(FIGURES):
        raise ValueError(f"keys named like the figures: {sorted(clash)}")
    inner = [f"_key{i}" for i in range(len(keys))]
    found = _quantiles(rows.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, inner, strict=True)], F.col(value).cast("double").alias("v")), inner, shares, held)
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, inner, strict=True)], *FIGURES)


def _quantiles(rows: DataFrame, keys: list[str], shares: Sequence[float], held: int) -> DataFrame:
    counts = rows.groupBy(*keys, "v").agg(F.count("*").alias("k"))
    most = rows.groupBy(*keys).agg(F.approx_count_distinct("v").alias("m")).agg(F.max("m")).first()[0] or 0
    n = F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("k"))), F.lit(0))
    figures = [n.alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), (F.sum(F.col("v") * F.col("k")) / F.nullif(n, F.lit(0))).alias("mean")]
    if most <= held:
        return counts.groupBy(*keys).agg(*figures, F.percentile("v", F.array(*map(F.lit, shares)), F.col("k")).alias("q"))
    counts = written(counts, "counts")
    ranged = counts.where("v is not null").repartitionByRange(*keys, "v").withColumn("task", F.spark_partition_id())
    ranged = written(ranged.withColumn("upto", F.sum("k").over(Window.partitionBy(*keys, "task").orderBy("v"))), "ranged")
    before = Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "task").agg(F.sum("k").alias("all"))
    sums = sums.select(*keys, "task", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("skip"), F.sum("all").over(Window.partitionBy(*keys)).alias("n"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    placed = ranged.alias("a").join(sums.alias("b"), [*same, F.col("a.task") == F.col("b.task")]).select("a.*", "b.skip", "b.n")
    end = F.col("skip") + F.col("upto")
    places = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), f(p).cast("long").alias("rank"), F.lit(side).alias("side"), (p - F.floor(p)).alias("part")) for i, p in enumerate(places) for side, f in ((0, F.floor), (1, F.ceil))])
    hits = placed.withColumn("w", F.explode(F.filter(wanted, lambda w: (w["rank"] >= end - F.col("k")) & (w["rank"] < end))))
    ends = hits.groupBy(*keys, "w.i").agg(F.max(F.when(F.col("w.side") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("w.side") == 1, F.col("v"))).alias("b"), F.max("w.part").alias("part"))
    q = ends.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("v")))), lambda x: x["v"]).alias("q"))
    stats = counts.groupBy(*keys).agg(*figures)
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"q.{c}")) for c in keys]
    return stats.alias("s").join(q.alias("q"), same or F.lit(True), "left").select("s.*", "q.q")
