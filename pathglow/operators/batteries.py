"""Batteries of predicates on containment, counted in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is asked of a candidate and the golf course it is nearest to.
GOLF = {
    "center_inside golf_course": "centre_inside",
    **{f"inside_frac >= {t:.2f}": f"inside_frac >= {t}" for t in (0.25, 0.50, 0.75, 0.90, 0.99)},
    "stays_inside golf_course": "stays_inside",
    "center_inside AND crosses": "centre_inside and crosses",
    "center_inside AND NOT crosses": "centre_inside and not crosses",
    "crosses golf (any frac)": "crosses",
    "has_nearby golf (250m+)": "distance is not null",
    **{f"distance <= {t}m (not inside)": f"not centre_inside and distance <= {t}" for t in (25, 50)},
    "semantic: stays_inside OR (center_inside AND inside_frac>=0.90)": "stays_inside or (centre_inside and inside_frac >= 0.9)",
    "semantic: internal (stays OR entire) not crossing-only": "(stays_inside or inside_frac >= 0.99) and not (crosses and not centre_inside)",
}
SAND, WILD = ("beach", "sand"), ("golf_course", "beach", "sand", "sport_climbing")
#: What is asked of a candidate and open areas of some classes, or of any class.
OPEN_AREA: Sequence[tuple[str, str, Sequence[str] | None]] = (
    ("center_inside any listed class", "centre_inside", None), ("majority component inside any", "majority", None), ("near-entire (>=0.9) inside any", "near_entire", None),
    ("entire (>=0.99) inside any", "entire", None), ("stays_inside any (center + >=0.9 + not crosses)", "stays_inside", None), ("center_inside AND crosses any", "centre_inside and crosses", None),
    ("center_inside golf_course", "centre_inside", ["golf_course"]), ("stays_inside golf_course", "stays_inside", ["golf_course"]), ("majority inside golf_course", "majority", ["golf_course"]),
    ("center_inside beach", "centre_inside", ["beach"]), ("stays_inside beach", "stays_inside", ["beach"]), ("majority inside beach OR sand", "majority", SAND), ("center_inside beach OR sand", "centre_inside", SAND),
    ("stays_inside beach OR sand", "stays_inside", SAND), ("center_inside sport_climbing", "centre_inside", ["sport_climbing"]), ("stays_inside sport_climbing", "stays_inside", ["sport_climbing"]),
    *((f"center_inside {c}", "centre_inside", [c]) for c in ("pitch", "sports_centre", "parking", "pedestrian_area")), ("center_inside park OR playground", "centre_inside", ("park", "playground")),
    *((f"{name} golf OR beach OR sand OR climbing", flag, WILD) for name, flag in (("stays_inside", "stays_inside"), ("center_inside", "centre_inside"), ("majority inside", "majority"))),
)


def count_predicates(rows: DataFrame, predicates: Mapping[str, str], status: str = "status", weight: Column | None = None) -> DataFrame:
    """predicate, status, hits, n: all predicates are sums of one aggregate; null meets none. A row stands for ``weight`` rows."""
    w = F.lit(1).cast("long") if weight is None else weight
    sums = [F.sum(F.when(F.expr(f"coalesce({c}, false)"), w).otherwise(F.lit(0).cast("long"))).alias(f"p{i}") for i, c in enumerate(predicates.values())]
    counted = rows.groupBy(status).agg(F.sum(w).alias("n"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("predicate"), F.col(f"p{i}").alias("hits")) for i, name in enumerate(predicates)])).alias("p")
    return counted.select(status, "n", each).select("p.predicate", status, "p.hits", "n")


def class_bits(area_class: Column, battery=OPEN_AREA) -> Column:
    """A class as bits of a long: the lowest for any class, one for each that is asked for."""
    named = _named(battery)
    bits = F.create_map(*[F.lit(v) for c, i in named.items() for v in (c, 1 << i)])
    return F.lit(1).cast("long").bitwiseOR(F.coalesce(bits[area_class].cast("long"), F.lit(0).cast("long")))


def _named(battery) -> dict[str, int]:
    return {c: i + 1 for i, c in enumerate(dict.fromkeys(c for _, _, classes in battery for c in classes or ()))}


def by_class(rows: DataFrame, group: str, area_class: str, battery=OPEN_AREA) -> tuple[DataFrame, dict[str, str]]:
    """One row a group with a flag for each question, from rows of a group and the ``class_bits`` of an area, or of several areas alike.

    The bits of the rows that meet a condition are joined by or, one long a condition; questions are asked of these.
    """
    met = {condition: f"_c{i}" for i, condition in enumerate(dict.fromkeys(condition for _, condition, _ in battery))}
    bits = [F.bit_or(F.when(F.expr(f"coalesce({condition}, false)"), F.col(area_class)).otherwise(F.lit(0).cast("long"))).alias(n) for condition, n in met.items()]
    named = _named(battery)
    flags = []
    for i, (_, condition, classes) in enumerate(battery):
        wanted = 1 if classes is None else sum(1 << named[c] for c in set(classes))
        flags.append((F.col(met[condition]).bitwiseAND(F.lit(wanted).cast("long")) != 0).alias(f"q{i}"))
    return rows.groupBy(group).agg(*bits).select(group, *flags), {name: f"q{i}" for i, (name, _, _) in enumerate(battery)}
