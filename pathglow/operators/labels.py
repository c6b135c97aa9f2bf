"""Joining candidates with reviews, and keeping the history of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathglow.functions.text import canonical_status, is_not_an_issue, is_smoke_challenge

#: A challenge number that stands for none.
NO_CHALLENGE = 99999


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; rows whose key is null or blank go. One aggregate, no window."""
    others = [c for c in rows.columns if c != key]
    kept = rows.where(F.trim(F.col(key).cast("string")) != "").groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_row"))
    return kept.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    others = [c for c in rows.columns if c != key]
    kept = rows.where(F.trim(F.col(key).cast("string")) != "").groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("_row"))
    return kept.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def with_labels(rows: DataFrame, reviews: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """Left join with the last review of each row; ``status`` in its canonical form."""
    last = last_wins(reviews.select(key, order, status), key, order).select(key, canonical_status(F.col(status)).alias("status"))
    return rows.join(last, key, "left")


def label_coverage(rows: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """How many rows have a review, and how many reviews no row: one row."""
    mine, theirs = rows.select(key).distinct(), reviews.select(key).distinct()
    joined = mine.withColumn("mine", F.lit(True)).join(theirs.withColumn("theirs", F.lit(True)), key, "full")
    return joined.agg(F.count_if(F.col("mine").isNotNull()).alias("candidates"), F.count_if(F.col("mine") & F.col("theirs")).alias("labelled"), F.count_if(F.col("mine").isNull()).alias("reviews_without_candidate"))


def output_gate(rows: DataFrame, prior: DataFrame, key: str, suppressed: Column) -> DataFrame:
    """Rows to write: not suppressed, and not settled as too hard or no issue; done ones carry a warning."""
    joined = rows.join(prior.select(key, F.col("status").alias("prior_status")), key, "left")
    settled = F.coalesce(F.col("prior_status").isin("Too_Hard", "Not_An_Issue"), F.lit(False))
    return joined.where(~suppressed & ~settled).withColumn("warn_done", F.coalesce(F.col("prior_status").isin("Fixed", "Already_Fixed"), F.lit(False)))


def nai_upsert(stored: DataFrame, found: DataFrame) -> DataFrame:
    """candidate_id, first_seen, last_seen, mapper: the earliest sighting is kept, the latest gives the mapper."""
    both = stored.unionByName(found)
    return both.groupBy("candidate_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by("mapper", F.struct("last_seen", "mapper")).alias("mapper"))


def registry_append(stored: DataFrame, new: DataFrame) -> DataFrame:
    """challenge_id, name, layer, task_count: new values win where they are not null; probes and placeholders stay out."""
    able = new.where((F.col("challenge_id") > 0) & (F.col("challenge_id") != NO_CHALLENGE) & ~is_smoke_challenge(F.col("name")))
    both = stored.withColumn("age", F.lit(0)).unionByName(able.withColumn("age", F.lit(1)))

    def newest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("age"))).alias(c)

    return both.groupBy("challenge_id").agg(newest("name"), newest("layer"), newest("task_count"))


def history_usable(stored: DataFrame, not_an_issue: DataFrame) -> DataFrame:
    """One row: whether a history holds anything, tasks or no-issue ids. One row of either side is looked at."""
    either = stored.select(F.lit(1).alias("x")).limit(1).unionByName(not_an_issue.select(F.lit(1).alias("x")).limit(1))
    return either.agg((F.count("*") > 0).alias("usable"))


def prefer(stored: DataFrame, discovered: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer merge in which discovered values win."""
    return stored.select(key, F.col(value).alias("old")).join(discovered.select(key, F.col(value).alias("new")), key, "full").select(key, F.coalesce("new", "old").alias(value))


def sync_not_an_issue(tasks: DataFrame, answered: DataFrame, stored: DataFrame) -> DataFrame:
    """candidate_id of no-issue tasks per challenge. A challenge that did not answer keeps what was stored for it."""
    fresh = tasks.where(is_not_an_issue(F.col("status"))).select("challenge_id", "candidate_id")
    kept = stored.join(answered.select("challenge_id"), "challenge_id", "left_anti")
    return fresh.unionByName(kept.select("challenge_id", "candidate_id")).distinct()
