"""Batches of a bounding box, fetched in parts: what fails is cut into four and tried again, what was finished before is not fetched.

A frontier of cells is a written table. In each round its cells are fetched side by side, by tasks; those that
fail are the frontier of the next round, each cut into its quarters, down to ``MOST_LEVELS``. A cell whose text was kept by an earlier run is
not fetched; a cell of which a part was kept is cut without being tried, as it must have failed then. A lost
executor repeats at most the round at hand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathglow.operators.shared import written

#: How often a cell may be cut, and the parts along each side of the box to begin with.
MOST_LEVELS, GRID = 3, 4
CELL = "name string, level int, x1 double, y1 double, x2 double, y2 double"
BOX = ("x1", "y1", "x2", "y2")


def first_cells(spark: SparkSession, box: tuple[float, float, float, float], grid: int = GRID) -> DataFrame:
    """The box in ``grid`` x ``grid`` cells of level 0, named by row and column."""
    x1, y1, x2, y2 = box
    w, h = (x2 - x1) / grid, (y2 - y1) / grid
    at = spark.range(grid * grid).select((F.col("id") % grid).alias("i"), F.floor(F.col("id") / grid).alias("j"))
    return at.select(F.format_string("r%dc%d", "j", "i").alias("name"), F.lit(0).alias("level"), *[(F.lit(a) + F.col(n) * s).alias(b) for b, a, n, s in (("x1", x1, "i", w), ("y1", y1, "j", h))], *[(F.lit(a) + (F.col(n) + 1) * s).alias(b) for b, a, n, s in (("x2", x1, "i", w), ("y2", y1, "j", h))])


def quarters(cells: DataFrame) -> DataFrame:
    """Each cell in its four quarters, their names those of the cell and a digit."""
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    parts = [(F.col("x1"), F.col("y1"), mx, my), (mx, F.col("y1"), F.col("x2"), my), (F.col("x1"), my, mx, F.col("y2")), (mx, my, F.col("x2"), F.col("y2"))]
    each = F.array(*[F.struct(F.concat("name", F.lit(f"_{k}")).alias("name"), (F.col("level") + 1).alias("level"), *[c.alias(n) for n, c in zip(BOX, p, strict=True)]) for k, p in enumerate(parts)])
    return cells.select(F.explode(each).alias("c")).select("c.*")


def fetch_batches(cells: DataFrame, fetch: Callable[[float, float, float, float], str | None], kept: DataFrame, most_levels: int = MOST_LEVELS) -> DataFrame:
    """name, level, box, text and fetched for cells that cover the given ones (name, level, box).

    ``fetch`` runs in tasks, once a cell and run: it returns the text of a box, or None if it could not be had. ``kept`` (name, text) is what earlier
    runs have; of a repeated name the least text counts. Raises, with the cell's name, if a cell of the last level fails. The caller stores
    the rows that are new (fetched), so that the next run finds them.
    """
    held = written(kept.groupBy("name").agg(F.min("text").alias("text")), "kept-batches")
    # a cell's name begins its parts' names: every cut before that a kept part tells of
    cuts = F.expr("transform(sequence(1, size(split(name, '_')) - 1), n -> substring_index(name, '_', n))")
    above = held.where(F.col("name").contains("_")).select(F.explode(cuts).alias("name")).distinct().withColumn("cut", F.lit(True))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["text"] = [fetch(*box) for box in frame[list(BOX)].itertuples(index=False)]
            yield frame

    frontier, done = written(cells.select("name", F.col("level").cast("int").alias("level"), *BOX), "frontier"), None
    for _ in range(most_levels + 2):
        known = frontier.join(held, "name", "left").join(above, "name", "left")
        old = known.where("text is not null").select("name", "level", *BOX, "text", F.lit(False).alias("fetched"))
        todo = known.where("text is null and cut is null").select("name", "level", *BOX).repartition(F.col("name"))
        tried = written(todo.mapInPandas(run, CELL + ", text string"), "tried").withColumn("fetched", F.lit(True))
        old = old.unionByName(tried.where("text is not null"))
        done = old if done is None else done.unionByName(old)
        failed = tried.where("text is null").select("name", "level", *BOX)
        lost = failed.where(F.col("level") >= most_levels).select("name").head()
        if lost:
            raise RuntimeError(f"batch {lost[0]} failed after {most_levels} cuts")
        cut = known.where("text is null and cut").select("name", "level", *BOX)
        frontier = written(quarters(failed.unionByName(cut)), "frontier")
        if not frontier.head(1):
            return done
    raise RuntimeError("kept parts lie deeper than cells may be cut")
