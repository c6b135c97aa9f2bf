"""Small functions of text, names and tables, each on the cases that its callers may meet."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pathglow.functions import geo, text
from pathglow.operators import labels
from pathglow.operators.quantiles import exact_quantiles
from pathglow.sources import features, sinks
from pathglow.streaming.reviews import review_rates


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)
    return lambda *columns: row.select(*columns).first()[:]


def test_parsing(one):
    assert one(*[text.parse_bool(F.lit(v)) for v in (" True ", "yes", "1", "no", "", None)]) == (True, True, True, False, False, False)
    assert one(*[text.parse_float(F.lit(v)) for v in (" 1.5 ", "-2e3", "x", "", None)]) == (1.5, -2000.0, None, None, None)
    assert one(*[text.parse_tags(F.lit(v)) for v in ('{"a": "b"}', "broken", None)]) == ({"a": "b"}, {}, {})


def test_names(one):
    assert one(text.safe_stem(F.lit("La Palma/Süd 1"))) == ("La_Palma_S_d_1",)
    assert one(text.redact(F.lit("key=abc abc"), "abc"), text.redact(F.lit("key"), "")) == ("key=*** ***", "key")
    a, b = one(text.cache_digest(F.lit("a"), F.lit("b")), text.cache_digest(F.lit("a|b")))
    assert len(a) == 16 and a == b and int(a, 16) >= 0
    day = F.lit(dt.date(2024, 3, 9))
    assert one(text.challenge_name(F.lit("Mallorca"), F.lit("ride"), day, F.lit(1)), text.challenge_name(F.lit("Mallorca"), F.lit("ride"), day, F.lit(3))) == ("Mallorca ride 2024-03-09", "Mallorca ride 2024-03-09-3")
    later, earlier = F.lit("2024-01-01 00:01:00").cast("timestamp"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert one(text.lag_seconds(later, earlier), text.lag_seconds(earlier, later)) == (60, 0)
    p = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    assert one(text.feature_id(p({"id": "a", "candidate_id": "b"})), text.feature_id(p({"id": "", "candidate_id": "b"})), text.feature_id(p({"x": "y"}))) == ("a", "b", None)


def test_pixels_back_to_the_plane(one):
    x, y = geo.from_pixel(F.lit(128), F.lit(256), F.lit(1000.0), F.lit(5000.0), F.lit(512.0), F.lit(1024.0), 512)
    assert one(x, y) == (1256.0, 4744.0)


def test_documents_that_cannot_be_read_are_told(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "a",\n "n": 1}')
    (tmp_path / "b.json").write_text("{broken")
    rows = features.read_documents(spark, str(tmp_path), "name string, n int").collect()
    assert sorted((r["name"], r["n"], bool(r["_corrupt"])) for r in rows if r["name"]) == [("a", 1, False)] and sum(bool(r["_corrupt"]) for r in rows) == 1


def test_discovered_values_win(spark):
    stored, found = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3), ("c", 4), ("d", None)], "k string, v int")
    assert sorted(map(tuple, labels.prefer(stored, found, "k", "v").collect()), key=str) == [("a", 1), ("b", 3), ("c", 4), ("d", None)]


def test_figures_and_tasks(spark, tmp_path):
    sinks.write_figures(spark.createDataFrame([(1, "x")], "n int, name string"), str(tmp_path / "f"))
    assert [json.loads(p.read_text()) for p in (tmp_path / "f").glob("part-*")] == [{"n": 1, "name": "x"}]
    rows = [(1, "b", 2), (1, "a", 9), (1, "a", 3), (2, None, 1), (2, "z", 0)]
    for parts in (1, 4):
        sinks.write_tasks(spark.createDataFrame(rows, "candidate_id int, x string, y int").repartition(parts), str(tmp_path / f"t{parts}"))
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / f"t{parts}")).collect())) == [(1, "a", 3), (2, None, 1)]


def test_rates_of_reviews(spark):
    at = dt.datetime(2024, 1, 1, 10, 5)
    df = spark.createDataFrame([(at, "Fixed"), (at + dt.timedelta(minutes=20), "Fixed"), (at + dt.timedelta(hours=1), "Fixed"), (at, "Skipped")], "reviewed_at timestamp, status string")
    assert sorted((r["status"], r["n"]) for r in review_rates(df).collect()) == [("Fixed", 1), ("Fixed", 2), ("Skipped", 1)]


@pytest.mark.parametrize("held", [1, 10_000])
def test_quantiles_with_keys_of_any_name(spark, held):
    df = spark.range(40).selectExpr("id % 2 as k", "id % 3 as v", "id as task", "cast(id as double) as x")
    got = {(r["k"], r["v"]): (r["n"], r["low"], r["high"], r["q"]) for r in exact_quantiles(df, ["k", "v"], "x", (0.5,), held).collect()}
    for (k, v), (n, low, high, q) in got.items():
        mine = [i for i in range(40) if i % 2 == k and i % 3 == v]
        middle = (mine[(len(mine) - 1) // 2] + mine[len(mine) // 2]) / 2
        assert (n, low, high, q) == (len(mine), mine[0], mine[-1], [middle])
    assert len(got) == 6 and exact_quantiles(df, ["task"], "x", (0.5,), held).count() == 40
    with pytest.raises(ValueError, match="named like the figures"):
        exact_quantiles(df.withColumnRenamed("k", "n"), ["n"], "x", (0.5,))
