"""Writers of candidates, features, tables and run figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathglow.sources.features import RECORD_MARK


def as_feature(lon: Column, lat: Column, properties: Column) -> Column:
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties"))


def write_sequence(rows: DataFrame, path: str, lon: str, lat: str, properties: list[str], marked: bool = True) -> None:
    """A collection of one feature a line, with a record mark before it or none; all property values are text."""
    entries = F.create_map(*[x for p in properties for x in (F.lit(p), F.coalesce(F.col(p).cast("string"), F.lit("")))])
    one = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(as_feature(F.col(lon), F.col(lat), entries)).alias("features")))
    rows.select(F.concat(F.lit(RECORD_MARK if marked else ""), one).alias("value")).write.mode("overwrite").text(path)


def write_collection(rows: DataFrame, path: str, key: str, lon: str, lat: str, properties: list[str]) -> None:
    """One collection of all rows, sorted by ``key`` as text, in files that together, in the order of their names, are the
    document; so no task holds it whole. A key has one feature, the least of its rows; rows without a key are left out.
    """
    entries = F.create_map(*[x for p in properties for x in (F.lit(p), F.coalesce(F.col(p).cast("string"), F.lit("")))])
    one = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.to_json(as_feature(F.col(lon), F.col(lat), entries)).alias("f"))
    each = one.groupBy("k").agg(F.min("f").alias("f"))
    first = each.agg(F.min("k")).first()[0]
    lines = each.select(F.lit(1).alias("place"), "k", F.concat(F.when(F.col("k") == F.lit(first), "").otherwise(","), "f").alias("value"))
    ends = rows.sparkSession.createDataFrame([(0, "", '{"type": "FeatureCollection", "features": ['), (2, "", "]}")], "place int, k string, value string")
    lines.unionByName(ends).repartitionByRange("place", "k").sortWithinPartitions("place", "k").select("value").write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with the given columns in their order; nulls are blank, other columns are left out."""
    rows.select(*columns).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def write_figures(row: DataFrame, path: str) -> None:
    """A one-row DataFrame as a JSON document."""
    row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_tasks(rows: DataFrame, path: str, key: str = "candidate_id") -> None:
    """The task table anew, one row a key, the least of its rows by their columns in turn, sorted by the key."""
    others = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in rows.columns])
    one.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def backups_to_drop(backups: DataFrame, keep: int = 3, by: str = "region") -> DataFrame:
    """Of dated backups those beyond the newest ``keep`` of each region."""
    from pyspark.sql import Window

    ranked = backups.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("made_at"), F.desc("name"))))
    return ranked.where(F.col("_rn") > keep).drop("_rn")
