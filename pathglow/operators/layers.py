"""Comparing the layers of heat, and drawing samples for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathglow.operators.quantiles import exact_quantiles
from pathglow.operators.shared import written

THRESHOLDS = (10, 25, 50, 75, 100)


def histogram(rows: DataFrame, dist: str, edges: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Counts by half-open buckets (low, high]; the first holds all up to its edge, the last all beyond; empty ones show."""
    names = [f"<={edges[0]}", *[f"{a}-{b}" for a, b in zip(edges, edges[1:], strict=False)], f">{edges[-1]}"]
    bucket = F.when(F.col(dist) <= edges[0], 0)
    for i, e in enumerate(edges[1:], 1):
        bucket = bucket.when(F.col(dist) <= e, i)
    counted = rows.where(F.col(dist).isNotNull()).groupBy(bucket.otherwise(len(edges)).alias("place")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame(list(enumerate(names)), "place int, bucket string")
    return every.join(counted, "place", "left").select("place", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def top_values(rows: DataFrame, column: str, most: int) -> DataFrame:
    """The ``most`` most frequent values, with their counts and places; equal counts go by value, nulls do not count."""
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    first = counted.orderBy(F.desc("n"), "value").limit(most)  # merges sorted heads, no full sort
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "value")))


def within_counts(rows: DataFrame, dist: str, *keys: str, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    steps = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    g = rows.select(*keys, dist, steps).groupBy(*keys, "threshold").agg(F.count_if(F.col(dist) <= F.col("threshold")).alias("within"), F.count("*").alias("n"))
    return g.withColumn("percent", F.round(F.col("within") * 100.0 / F.col("n"), 4))


def distance_stats(rows: DataFrame, dist: str, *keys: str) -> DataFrame:
    names = ("p10", "p25", "median", "p75", "p90")
    g = exact_quantiles(rows.where(F.col(dist).isNotNull()), list(keys), dist, (0.1, 0.25, 0.5, 0.75, 0.9))
    return g.select(*keys, "n", F.round("low", 3).alias("low"), *[F.round(F.col("q")[i], 3).alias(n) for i, n in enumerate(names)], F.round("high", 3).alias("high"))


def overlap_categories(rows: DataFrame, first: str, second: str, *keys: str) -> DataFrame:
    """For each threshold, whether a row lies near the first other layer, the second, both or none."""
    t = F.col("threshold")
    a, b = F.coalesce(F.col(first) <= t, F.lit(False)), F.coalesce(F.col(second) <= t, F.lit(False))
    kind = F.when(a & b, "both").when(a, "first").when(b, "second").otherwise("only")
    steps = F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold")
    return rows.select(*keys, first, second, steps).groupBy(*keys, "threshold", kind.alias("category")).agg(F.count("*").alias("n"))


def same_corridor(forward: DataFrame, backward: DataFrame, low: float, high: float) -> DataFrame:
    """Nearest pairs (a, b, dist) between ``low`` and ``high`` metres from either side, each pair once, forward first."""
    both = forward.withColumn("side", F.lit(0)).unionByName(backward.withColumn("side", F.lit(1)))
    return both.where((F.col("dist") > low) & (F.col("dist") <= high)).groupBy("a", "b").agg(F.min_by("dist", "side").alias("dist"))


def farthest_points(rows: DataFrame, group: str, quota: Column, id_col: str = "id", x: str = "x", y: str = "y", every: int = 5) -> DataFrame:
    """A quota of rows a group, each the farthest from those chosen before; ties go to the greater id.

    The first is the one with the least x, then y, then id; ids are unique within a group. Each round updates every row's
    squared gap to the points chosen so far and takes the greatest of each group as a partial aggregate, so no group is
    gathered. The driver holds the chosen rows alone: groups times quota. After each ``every`` rounds the gaps are written.
    Rows with a null coordinate come last; rows without an id or with a null quota are never chosen.
    """
    spark, kinds = rows.sparkSession, {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = [F.col(group).alias("grp"), F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), quota.cast("int").alias("quota")]
    now = written(rows.select(*fields, F.lit(None).cast("double").alias("gap")).where("quota > 0 and id is not null"), "gaps")
    kind = f"grp {kinds[group]}, ids array<{kinds[id_col]}>, fresh array<struct<x: double, y: double>>"
    first = F.struct((F.col("x").isNull() | F.col("y").isNull()).alias("none"), "x", "y", "id")
    found = now.groupBy("grp").agg(F.min_by(F.struct("id", "x", "y"), first).alias("best"), F.max("quota").alias("quota")).collect()
    most, chosen, fresh = {r["grp"]: r["quota"] for r in found}, {}, {}
    while found:
        for r in found:
            chosen.setdefault(r["grp"], []).append(r["best"]["id"])
            fresh.setdefault(r["grp"], []).append((r["best"]["x"], r["best"]["y"]))
        todo = [(r["grp"], chosen[r["grp"]], fresh.get(r["grp"], [])) for r in found if len(chosen[r["grp"]]) < most[r["grp"]]]
        if not todo:
            break
        near = F.array_min(F.transform("fresh", lambda p: F.nanvl((F.col("x") - p["x"]) ** 2 + (F.col("y") - p["y"]) ** 2, F.lit(None))))
        held = spark.createDataFrame(todo, kind).withColumnRenamed("grp", "_grp")
        left = now.join(F.broadcast(held), F.col("grp").eqNullSafe(F.col("_grp"))).where(~F.array_contains("ids", F.col("id")))
        left = left.select("grp", "id", "x", "y", "quota", F.least("gap", near).alias("gap"))
        if max(map(len, fresh.values())) >= every:
            now, fresh = written(left, "gaps"), {}
            left = now
        found = left.groupBy("grp").agg(F.max_by(F.struct("id", "x", "y"), F.struct("gap", "id")).alias("best")).collect()
    picked = [(g, i, n) for g, ids in chosen.items() for n, i in enumerate(ids, 1)]
    return spark.createDataFrame(picked, f"{group} {kinds[group]}, {id_col} {kinds[id_col]}, rank int")
