"""Tables that are promoted only when they pass their checks: staged, measured while they are written, then swapped in.

A table is a folder of versions and a manifest that names the current one, those before it that are kept, and what was measured of each. A
new version is written beside the others; its figures are observed by the write itself, so no second scan is made. If a check fails the
staged version goes and the manifest stays. Else a new manifest is written under another name and put in the old one's place
by one rename, which is atomic on file systems that have such a rename. So a reader sees the old version or the new one, and whatever
fails before the rename leaves the old one. Versions beyond those kept are dropped after it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Figures = dict[str, object]
#: Tells from the figures of the staged version and of the current one (none at first) what is wrong, or None.
Check = Callable[[Figures, Figures | None], str | None]
MANIFEST = "current.json"


class Refused(ValueError):
    """A staged version that did not pass its checks."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """current and its figures, and earlier, a list of the versions before it, the last first; None if there is none yet."""
    fs, where = _files(spark, f"{folder}/{MANIFEST}")
    if not fs.exists(where):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).collect()))


def _swap(spark: SparkSession, folder: str, content: dict) -> None:
    fs, staged = _files(spark, f"{folder}/.{uuid.uuid4().hex}.json")
    out = fs.create(staged)
    out.write(bytearray(json.dumps(content), "utf-8"))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = next(o for o in kind.getEnumConstants() if str(o) == "OVERWRITE")
    context.rename(staged, jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}"), options)


def _drop(spark: SparkSession, folder: str, version: str) -> None:
    fs, where = _files(spark, f"{folder}/versions/{version}")
    fs.delete(where, True)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The current version's rows."""
    known = manifest(spark, folder)
    if known is None:
        raise FileNotFoundError(f"no version in {folder}")
    return spark.read.parquet(f"{folder}/versions/{known['current']['version']}")


def promote(rows: DataFrame, folder: str, figures: Mapping[str, Column], checks: Mapping[str, Check], keep: int = 3) -> Figures:
    """Writes ``rows`` as a new version and makes it the current one if every check passes; returns its figures.

    ``figures`` are aggregates, measured as the rows are written; rows is always one of them. The last ``keep`` versions before it are kept.
    """
    spark, version, seen = rows.sparkSession, uuid.uuid4().hex, Observation()
    before = manifest(spark, folder)
    try:
        rows.observe(seen, F.count("*").alias("rows"), *[c.alias(n) for n, c in figures.items()]).write.parquet(f"{folder}/versions/{version}")
        found = {n: v if isinstance(v, (int, float, str, bool, type(None))) else str(v) for n, v in seen.get.items()}
        wrong = {n: said for n, check in checks.items() if (said := check(found, before and before["current"]["figures"]))}
        if wrong:
            raise Refused("; ".join(f"{n}: {said}" for n, said in wrong.items()))
        earlier = [before["current"], *before["earlier"]] if before else []
        _swap(spark, folder, {"current": {"version": version, "figures": found}, "earlier": earlier[:keep]})
    except BaseException:
        _drop(spark, folder, version)
        raise
    for old in earlier[keep:]:
        _drop(spark, folder, old["version"])
    return found


def roll_back(spark: SparkSession, folder: str) -> Figures:
    """Makes the version before the current one current again, and drops the latter; returns its figures."""
    known = manifest(spark, folder)
    if known is None or not known["earlier"]:
        raise FileNotFoundError(f"no earlier version in {folder}")
    _swap(spark, folder, {"current": known["earlier"][0], "earlier": known["earlier"][1:]})
    _drop(spark, folder, known["current"]["version"])
    return known["earlier"][0]["figures"]


# ---- checks


def at_least(name: str, least: float) -> Check:
    return lambda now, _: None if now[name] is not None and now[name] >= least else f"{name} is {now[name]}, less than {least}"


def at_most(name: str, most: float) -> Check:
    return lambda now, _: None if now[name] is not None and now[name] <= most else f"{name} is {now[name]}, more than {most}"


def grows_at_most(name: str, factor: float, shrinks: float = 0.5) -> Check:
    """Against the current version: neither ``factor`` times as much nor less than ``shrinks`` of it."""

    def check(now: Figures, before: Figures | None) -> str | None:
        if not before or not before.get(name):
            return None
        ratio = (now[name] or 0) / before[name]
        return None if shrinks <= ratio <= factor else f"{name} went from {before[name]} to {now[name]}"

    return check


def never_older(name: str) -> Check:
    """The downgrade guard: a figure, such as a time or a sequence, that does not go back."""
    return lambda now, before: None if not before or before.get(name) is None or (now[name] is not None and now[name] >= before[name]) else f"{name} went back from {before[name]} to {now[name]}"


def equal(left: str, right: str) -> Check:
    """Two figures that must agree, such as references and those that were found."""
    return lambda now, _: None if now[left] == now[right] else f"{left} is {now[left]} and {right} {now[right]}"
