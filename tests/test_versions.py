"""Validated promotion: whatever fails leaves the old version readable."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pathglow.sources import versions

def figures() -> dict:
    return {"ways": F.count_if(F.col("kind") == "way"), "nodes": F.count_if(F.col("kind") == "node"), "made": F.max("made"), "dangling": F.count_if(F.col("ref").isNull())}


CHECKS = {
    "enough ways": versions.at_least("ways", 2), "none dangling": versions.at_most("dangling", 0), "growth": versions.grows_at_most("rows", 3.0), "age": versions.never_older("made"),
}


def extract(spark, ways: int, nodes: int, made: int, dangling: int = 0):
    rows = [("way", i, made, 1) for i in range(ways)] + [("node", i, made, None if i < dangling else 1) for i in range(nodes)]
    return spark.createDataFrame(rows, "kind string, id int, made int, ref int")


def shown(spark, folder) -> tuple[int, int]:
    return versions.current(spark, folder).agg(F.count("*"), F.max("made")).first()[:]


def stored(tmp_path) -> int:
    return len(list((tmp_path / "t" / "versions").iterdir()))


def test_failures_at_each_step_leave_the_old_version(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, folder)
    with pytest.raises(versions.Refused, match="enough ways: ways is 1"):
        versions.promote(extract(spark, 1, 5, 10), folder, figures(), CHECKS)
    assert versions.manifest(spark, folder) is None and stored(tmp_path) == 0
    assert versions.promote(extract(spark, 3, 5, 10), folder, figures(), CHECKS) == {"rows": 8, "ways": 3, "nodes": 5, "made": 10, "dangling": 0}
    for refused, said in ((extract(spark, 3, 5, 9), "age: made went back"), (extract(spark, 30, 50, 11), "growth: rows went"), (extract(spark, 2, 0, 11), "growth"), (extract(spark, 3, 5, 11, 2), "none dangling"), (extract(spark, 0, 0, 11).limit(0), "age")):
        with pytest.raises(versions.Refused, match=said):
            versions.promote(refused, folder, figures(), CHECKS)
        assert shown(spark, folder) == (8, 10) and stored(tmp_path) == 1
    broken = extract(spark, 3, 5, 11).withColumn("id", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        versions.promote(broken, folder, figures(), CHECKS)
    with monkeypatch.context() as m:
        m.setattr(versions, "_swap", lambda *_: (_ for _ in ()).throw(OSError("no rename")))
        with pytest.raises(OSError, match="no rename"):
            versions.promote(extract(spark, 4, 5, 11), folder, figures(), CHECKS)
    assert shown(spark, folder) == (8, 10) and stored(tmp_path) == 1


def test_versions_are_kept_and_rolled_back(spark, tmp_path):
    folder = str(tmp_path / "t")
    for made in range(1, 6):
        versions.promote(extract(spark, made + 1, made + 2, made), folder, figures(), CHECKS, keep=2)
        assert shown(spark, folder) == (2 * made + 3, made) and stored(tmp_path) == min(made, 3)
    assert [v["figures"]["made"] for v in versions.manifest(spark, folder)["earlier"]] == [4, 3]
    assert versions.roll_back(spark, folder)["made"] == 4 and shown(spark, folder) == (11, 4) and stored(tmp_path) == 2
    versions.roll_back(spark, folder)
    with pytest.raises(FileNotFoundError, match="no earlier"):
        versions.roll_back(spark, folder)
    assert shown(spark, folder) == (9, 3)
    assert versions.equal("a", "b")({"a": 1, "b": 2}, None) == "a is 1 and b 2" and versions.equal("a", "b")({"a": 1, "b": 1}, None) is None
