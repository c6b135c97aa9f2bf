"""Reviews as a stream: labels that arrive late or twice are folded into the history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathglow.functions.text import is_not_an_issue
from pathglow.operators.labels import nai_upsert

HISTORY = "candidate_id string, first_seen timestamp, last_seen timestamp, mapper string"


def no_issue_events(reviews: DataFrame) -> DataFrame:
    """candidate_id, first_seen, last_seen, mapper of reviews (candidate_id, status, reviewed_at, mapper) without an issue."""
    return reviews.where(is_not_an_issue(F.col("status"))).select("candidate_id", F.col("reviewed_at").alias("first_seen"), F.col("reviewed_at").alias("last_seen"), "mapper")


def part_of(candidate_id: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(candidate_id), F.lit(parts)).cast("int")


def follow_reviews(reviews: DataFrame, path: str, checkpoint: str, parts: int = 64) -> StreamingQuery:
    """Folds every micro-batch into the history under ``path``, which lies in ``parts`` parts by a hash of the candidate.

    A batch reads and writes only the parts that it touches, in the folder that bears its number, from their newest version
    before it. A batch that is run again after a failure so writes the same rows to the same place, and no version is read
    while it is written. Of a part the newest version and the one before it stay, older ones are removed. ``parts`` must
    stay the same for a path.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = no_issue_events(batch).persist()
        touched = sorted(r[0] for r in found.select(part_of(F.col("candidate_id"), parts)).distinct().collect())
        if touched:
            before = _versions(spark, path, number)
            stored = _read(spark, path, {k: before[k] for k in touched if k in before})
            both = nai_upsert(stored, found).withColumn("part", part_of(F.col("candidate_id"), parts))
            both.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/version={number}")
            _remove_older(spark, path, {k: before[k][-1:] for k in touched if k in before})
        found.unpersist()

    return reviews.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(spark: SparkSession, path: str, mark: str) -> list[int]:
    """Numbers of the folders ``mark=number`` of a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{mark}="))


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list[int]]:
    """The finished versions of each part, oldest first."""
    found: dict[int, list[int]] = {}
    for n in _folders(spark, path, "version"):
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}/_SUCCESS")
        if (before is None or n < before) and done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            for k in _folders(spark, f"{path}/version={n}", "part"):
                found.setdefault(k, []).append(n)
    return found


def _read(spark: SparkSession, path: str, versions: dict[int, list[int]]) -> DataFrame:
    paths = [f"{path}/version={numbers[-1]}/part={k}" for k, numbers in sorted(versions.items())]
    return spark.read.schema(HISTORY).parquet(*paths) if paths else spark.createDataFrame([], HISTORY)


def _remove_older(spark: SparkSession, path: str, kept: dict[int, list[int]]) -> None:
    """Removes the versions of parts that are older than the ones kept, and folders that no part is left in."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, numbers in _versions(spark, path).items():
        for n in numbers:
            if k in kept and n < kept[k][0]:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}/part={k}"), True)
                if not _folders(spark, f"{path}/version={n}", "part"):
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}"), True)


def history(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest version of the history, or that before a number; empty if there is none."""
    return _read(spark, path, _versions(spark, path, before))


def review_rates(reviews: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Reviews by state in windows of event time; a window is final once the stream is ``late`` past it."""
    return reviews.withWatermark("reviewed_at", late).groupBy(F.window("reviewed_at", window).alias("w"), "status").agg(F.count("*").alias("n"))
