"""Containment where areas lie on top of one another."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from helpers import duck_rows, spark_rows
from pathglow.operators.areas import distinct_shapes
from pathglow.plans import query_spatial

COPIES = 4


@pytest.fixture(scope="module")
def piled(tmp_path_factory, data) -> str:
    """Parts, and so rings, ``COPIES`` times in the same places, and a few line items."""
    to, con = tmp_path_factory.mktemp("piled"), duckdb.connect()
    con.execute(f"copy (select p.* replace (p_partkey + 20000 * i as p_partkey) from '{data}/part.parquet' p, range({COPIES}) as t(i)) to '{to}/part.parquet'")
    con.execute(f"copy (select * from '{data}/lineitem.parquet' where l_orderkey % 5 = 0) to '{to}/lineitem.parquet'")
    for t in "region nation customer supplier orders events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"copy (select * from '{data}/{t}.parquet' limit 1) to '{to}/{t}.parquet'")
    return str(to)


def test_equal_areas_are_one_shape(spark):
    square = ((0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0))
    rows = [(k, *(float(v) for v in e)) for k in (7, 3, 5) for e in (square if k != 5 else square[::-1])] + [(9, *(2.0 * v for v in e)) for e in square]
    shapes, members = distinct_shapes(spark.createDataFrame([*rows, (11, 0.0, 0.0, None, 1.0)], "k long, x1 double, y1 double, x2 double, y2 double"), "k")
    assert sorted(map(tuple, members.collect())) == [(3, 3), (5, 3), (7, 3), (9, 9)]
    assert sorted(map(tuple, shapes.collect())) == sorted((k, *e) for k, *e in rows if k in (3, 9))


def test_spots_do_not_meet_each_copy_of_a_ring(spark, piled):
    inside, members = query_spatial._inside(spark, piled)
    ((pairs,),) = duckdb.connect().sql(f"select count(*) from '{piled}/lineitem.parquet' l join '{piled}/part.parquet' p on p_partkey < 20000 and l_partkey * 37 % 20000 + l_linenumber * 11 + 0.5 between p_partkey * 37 % 20000 and p_partkey * 37 % 20000 + 4 * (40 + p_size * 3) and l_partkey * 53 % 20000 + l_suppkey % 90 + 0.25 between p_partkey * 53 % 20000 and p_partkey * 53 % 20000 + 4 * (40 + p_size * 3)").fetchall()
    assert inside.count() <= pairs and members.count() == spark.read.parquet(f"{piled}/part.parquet").count()


@pytest.mark.parametrize("name", ["containment_fractions", "golf_battery", "open_area_battery", "point_in_polygon", "best_area"])
def test_piled_rings_like_sql(spark, piled, name):
    columns, rows = duck_rows(entry.oracle_sql()[name], piled)
    found = entry.queries()[name](spark, piled)
    assert sorted(found.columns) == columns and spark_rows(found) == rows


def test_spots_of_one_place_are_one_row(spark, piled, tmp_path):
    """Line items three times over: the places, and so the tests of points in shapes, stay as many; the counts are three times as large."""
    for t in "part region nation customer supplier orders events documents embeddings pages benchmark labels conversations".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"{piled}/{t}.parquet")
    duckdb.connect().execute(f"copy (select l.* replace (l_orderkey + 1000000 * i as l_orderkey) from '{piled}/lineitem.parquet' l, range(3) as t(i)) to '{tmp_path}/lineitem.parquet'")
    rows = [query_spatial._inside(spark, d, of="spots")[0] for d in (piled, str(tmp_path))]
    assert rows[0].count() == rows[1].count() > 0
    columns, expected = duck_rows(entry.oracle_sql()["point_in_polygon"], str(tmp_path))
    assert spark_rows(entry.queries()["point_in_polygon"](spark, str(tmp_path))) == expected


@pytest.mark.parametrize("name", ["open_area_battery", "best_area"])
def test_groups_are_aggregated_by_hash(spark, piled, name):
    """Flags and least scores of a group are longs, so the many rows of groups and shapes are not sorted for them."""
    plan = entry.queries()[name](spark, piled)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and not any("grp" in line.split("functions")[0] for line in plan.splitlines() if "SortAggregate" in line)
    assert "arrays_overlap" not in plan


@pytest.mark.parametrize("name", ["containment_fractions", "golf_battery", "point_in_polygon"])
def test_members_of_shapes_are_not_broadcast(spark, piled, name):
    plan = entry.queries()[name](spark, piled)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
