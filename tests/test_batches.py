"""Batches that are cut where they fail, with failures injected."""

from __future__ import annotations

import os
import uuid

import pytest

from pathglow.sources import batches

KEPT = "name string, text string"


def fetching(log: str, fails):
    """A fetch that notes each try in a file of its own and fails where ``fails`` says so."""

    def fetch(x1: float, y1: float, x2: float, y2: float) -> str | None:
        with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
            f.write(f"{x1} {y1} {x2} {y2}")
        return None if fails(x1, y1, x2, y2) else f"{x1} {y1} {x2} {y2}"

    return fetch


def tries(log) -> list[str]:
    return sorted(p.read_text() for p in log.iterdir())


def area(rows) -> float:
    return sum((r["x2"] - r["x1"]) * (r["y2"] - r["y1"]) for r in rows)


def test_what_fails_is_cut_and_nothing_is_fetched_twice(spark, tmp_path):
    """Cells wider than 1 that hold the place (3.2, 3.2) fail: it is cut three times; the next run fetches nothing."""
    log = tmp_path / "log"
    log.mkdir()
    fails = lambda x1, y1, x2, y2: x1 <= 3.2 < x2 and y1 <= 3.2 < y2 and x2 - x1 > 1
    cells = batches.first_cells(spark, (0.0, 0.0, 32.0, 16.0), 4)
    got = batches.fetch_batches(cells, fetching(str(log), fails), spark.createDataFrame([], KEPT)).collect()
    assert area(got) == 32 * 16 and len(got) == 16 + 3 * 3 and all(r["fetched"] for r in got)
    assert max(r["level"] for r in got) == 3 and {r["text"] for r in got} == {f"{r['x1']} {r['y1']} {r['x2']} {r['y2']}" for r in got}
    seen = tries(log)
    assert len(seen) == len(set(seen)) == 16 + 3 * 4
    kept = [(r["name"], r["text"]) for r in got]
    again = batches.fetch_batches(cells, fetching(str(log), lambda *_: True), spark.createDataFrame(kept + kept[:2], KEPT)).collect()
    assert sorted(map(tuple, again)) == sorted((*tuple(r)[:-1], False) for r in got) and tries(log) == seen


def test_a_run_that_was_broken_off_goes_on(spark, tmp_path):
    """Of a cell that was cut only the missing parts are fetched; the cell itself is not tried again."""
    log = tmp_path / "log"
    log.mkdir()
    cells = batches.first_cells(spark, (0.0, 0.0, 8.0, 8.0), 1)
    kept = spark.createDataFrame([("r0c0_0", "a"), ("r0c0_3_1", "b")], KEPT)
    got = batches.fetch_batches(cells, fetching(str(log), lambda *_: False), kept).collect()
    assert sorted(r["name"] for r in got) == ["r0c0_0", "r0c0_1", "r0c0_2", "r0c0_3_0", "r0c0_3_1", "r0c0_3_2", "r0c0_3_3"] and area(got) == 64
    assert {r["name"] for r in got if not r["fetched"]} == {"r0c0_0", "r0c0_3_1"} and len(tries(log)) == 5


def test_the_last_level_raises(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    with pytest.raises(RuntimeError, match="r0c0_0_0_0 failed after 3 cuts"):
        batches.fetch_batches(batches.first_cells(spark, (0.0, 0.0, 8.0, 8.0), 1), fetching(str(log), lambda x1, y1, *_: (x1, y1) == (0.0, 0.0)), spark.createDataFrame([], KEPT))
    assert len(tries(log)) == 1 + 4 + 4 + 4
