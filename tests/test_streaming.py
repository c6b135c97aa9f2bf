from __future__ import annotations

import datetime as dt

from pathglow.operators import labels
from pathglow.streaming import reviews

SCHEMA = "candidate_id string, status string, reviewed_at timestamp, mapper string"


def day(n: int) -> dt.datetime:
    return dt.datetime(2024, 1, n)


def test_history_follows_the_stream(spark, tmp_path):
    source, path, check = str(tmp_path / "in"), str(tmp_path / "history"), str(tmp_path / "check")
    batches = [[("a", "2", day(3), "m1"), ("b", "Fixed", day(3), "m1")], [("a", "Not_An_Issue", day(1), "m2"), ("c", "false positive", day(5), "m3")], [("a", "2", day(9), "m4")]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        reviews.follow_reviews(spark.readStream.schema(SCHEMA).parquet(source), path, check).awaitTermination()
    got = {r["candidate_id"]: (r["first_seen"], r["last_seen"], r["mapper"]) for r in reviews.history(spark, path).collect()}
    assert got == {"a": (day(1), day(9), "m4"), "c": (day(5), day(5), "m3")}
    reviews.follow_reviews(spark.readStream.schema(SCHEMA).parquet(source), path, check).awaitTermination()  # nothing new
    assert reviews.history(spark, path).count() == 2


def test_a_batch_rewrites_only_the_parts_it_touches(spark, tmp_path):
    source, path, check = str(tmp_path / "in"), tmp_path / "history", str(tmp_path / "check")
    for n in range(1, 5):
        rows = [("same", "2", day(n), f"m{n}")] + ([(f"c{i}", "2", day(1), "m") for i in range(12)] if n == 1 else [])
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        reviews.follow_reviews(spark.readStream.schema(SCHEMA).parquet(source), str(path), check, parts=4).awaitTermination()
    assert reviews.history(spark, str(path)).count() == 13
    assert [r["mapper"] for r in reviews.history(spark, str(path)).where("candidate_id = 'same'").collect()] == ["m4"]
    folders = {v.name: sorted(p.name for p in v.glob("part=*")) for v in path.glob("version=*")}
    newest = folders["version=3"]
    assert len(newest) == 1 and folders["version=2"] == newest  # the version before stays, for a batch that is run again
    assert set(folders) == {"version=0", "version=2", "version=3"} and newest[0] not in folders["version=0"] and len(folders["version=0"]) == 3


def test_history_of_nothing(spark, tmp_path):
    assert reviews.history(spark, str(tmp_path / "none")).count() == 0


def test_failed_challenges_keep_what_was_stored(spark):
    tasks = spark.createDataFrame([(1, "a", "2"), (1, "b", "1"), (2, "c", "Not_An_Issue")], "challenge_id long, candidate_id string, status string")
    stored = spark.createDataFrame([(1, "old"), (3, "kept")], "challenge_id long, candidate_id string")
    answered = spark.createDataFrame([(1,), (2,)], "challenge_id long")
    got = {tuple(r) for r in labels.sync_not_an_issue(tasks, answered, stored).collect()}
    assert got == {(1, "a"), (2, "c"), (3, "kept")}
    again = labels.sync_not_an_issue(tasks, answered, labels.sync_not_an_issue(tasks, answered, stored))
    assert {tuple(r) for r in again.collect()} == got


def test_registry_keeps_what_new_rows_lack(spark):
    old = spark.createDataFrame([(5, "five", "ride", 10)], "challenge_id long, name string, layer string, task_count long")
    new = spark.createDataFrame([(5, "Five", None, 12), (99999, "x", "run", 1), (7, "API Test", "run", 1), (8, "eight", None, None)], old.schema)
    got = {r["challenge_id"]: tuple(r)[1:] for r in labels.registry_append(old, new).collect()}
    assert got == {5: ("Five", "ride", 12), 8: ("eight", None, None)}
