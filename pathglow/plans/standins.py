"""Views over the star schema that stand in for candidates, reviews, heat tiles and map geometry.

Each is one SQL text that Spark and DuckDB read alike. All grow with the tables: a new thousand of events is a new area, a
new four hundred orders a new heat tile, so density stays the same at every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def div(a: str, b: int) -> str:
    return f"cast(floor(({a}) / {b}) as bigint)"


def mixed(key: str, factor: int, modulus: int, scale: float = 1) -> str:
    """A double in [0, modulus / scale) that jumps from key to key."""
    return f"(cast(({key} * {factor}) % {modulus} as double) / {scale})"


def sparse(value: str, key: str, every: int, at: int) -> str:
    return f"case when {key} % {every} = {at} then null else {value} end"


def _candidate() -> str:
    block, e = div("event_id", 1000), "event_id"
    fields = {
        "event_id": "event_id",
        "ts": "ts",
        "candidate_id": f"'14/' || cast(8200 + {block} % 1000 as string) || '/' || cast(6200 + {div(block, 1000)} as string) || '/' || cast({div('event_id % 1000', 40)} as string) || '/' || cast(event_id % 40 as string)",
        "layer": "case user_id % 3 when 0 then 'ride' when 1 then 'run' else 'all' end",
        "mx": f"cast({block} % 1000 * 100000 + (event_id * 7919 + (event_id % 1009) * (event_id % 1013) * 31) % 5000 as double)",
        "my": f"cast({div(block, 1000)} * 100000 + (event_id * 104729 + (event_id % 997) * (event_id % 991) * 17) % 5003 as double)",
        "lon": f"-170 + cast({block} % 1000 as double) * 0.3 + {mixed(e, 7919, 50000, 1e6)}",
        "lat": f"30 + cast({div(block, 1000)} as double) * 0.3 + {mixed(e, 104729, 50021, 1e6)}",
        "size": "cast((event_id * 13) % 40 as int)",
        "inside_area": "event_id % 23 <> 7",
        "peak_dist": sparse(mixed(e, 31, 2403, 10), e, 19, 5),
        "p90": sparse(mixed(e, 37, 1607, 10), e, 29, 3),
        "pmax": mixed(e, 41, 1907, 10),
        "iqr": sparse(mixed(e, 43, 211, 10), e, 31, 8),
        "follow50": mixed(e, 47, 1009, 1008),
        "follow75": mixed(e, 53, 1013, 1012),
        "follow100": sparse(mixed(e, 59, 1019, 1018), e, 37, 11),
        "parallel15": sparse(mixed(e, 61, 1021, 1020), e, 41, 2),
        "parallel30": sparse(mixed(e, 67, 1031, 1030), e, 43, 6),
        "elongation": mixed(e, 71, 2503, 100),
        "ferry_dist": sparse(mixed(e, 73, 20011, 10), e, 3, 1),
        "ferry_id": f"case when {e} % 3 <> 1 and {e} % 4 <> 2 then 'f' || cast({e} % 50 as string) else '' end",
        "constr_dist": sparse(mixed(e, 79, 9001, 10), e, 5, 3),
        "constr_id": f"case when {e} % 5 <> 3 then 'c' || cast({e} % 40 as string) else '' end",
        "tunnel": f"case {e} % 13 when 1 then 'yes' when 2 then 'culvert' when 3 then '' else null end",
        "highway": f"case {e} % 11 when 0 then 'construction' when 1 then 'path' when 2 then 'track' when 3 then 'footway' when 4 then 'residential' when 5 then 'service' when 6 then '' when 7 then 'primary' else null end",
        "construction": f"case {e} % 17 when 0 then 'yes' when 1 then 'track' else null end",
        "ratio_p90": sparse(mixed(e, 83, 503, 100), e, 7, 2),
        "cover150": mixed(e, 89, 1033, 1032),
        "cover200": mixed(e, 97, 1039, 1038),
        "cover250": mixed(e, 101, 1049, 1048),
        "cover250_30": mixed(e, 103, 1051, 1050),
        "halo": sparse(mixed(e, 107, 307, 100), e, 11, 4),
        "between": sparse(mixed(e, 109, 211, 100), e, 11, 4),
        "lateral_min": sparse(mixed(e, 113, 1511, 10), e, 13, 9),
        "heat_max": f"cast((event_id * 127) % 256 as int)",
        "pixels": f"cast((event_id * 131) % 300 as int)",
        "golf": f"{e} % 27 = 4",
        "value": "value",
    }
    return "select " + ", ".join(f"{x} as {n}" for n, x in fields.items()) + " from {events}"


def _review() -> str:
    """Tasks about candidates: repeated names, blank names, odd spellings, and candidates without a task."""
    spelled = "case o_orderkey % 11 when 4 then 'not an issue' when 5 then 'Fixed' when 6 then 'Fixed' when 7 then 'Too_Hard' when 8 then 'Already_Fixed' when 9 then ' Too Hard ' when 10 then 'Skipped' else 'Not_An_Issue' end"
    theme = "case o_orderkey % 9 when 0 then 'Golf course' when 1 then 'on the beach' when 2 then 'GPS scatter' when 3 then 'marathon race' when 4 then 'climbing wall' when 5 then '' else 'no path here' end"
    event = div("o_orderkey * 2", 3)
    return f"""select o_orderkey as ord, {event} as event_id, {spelled} as status_raw, 't' || cast(o_orderkey as string) as task_id,
  cast(o_custkey % 7 as bigint) as challenge_id, {theme} as comment, o_orderdate as reviewed_at, 'm' || cast(o_custkey % 50 as string) as mapper
from {{orders}} where o_orderkey % 5 <> 4 and o_orderkey % 97 <> 0"""


def _heat() -> str:
    rank = f"percent_rank() over (partition by {div('o_orderkey', 400)} order by o_totalprice, o_orderkey)"
    r, c = div("o_orderkey % 400", 20), "o_orderkey % 20"
    return f"""select tile, r, c, greatest(0, v0 - case when (r * 7 + c * 13) % 10 < 4 then 255 else 20 end) as v from (
  select {div('o_orderkey', 400)} as tile, cast({r} as int) as r, cast({c} as int) as c, cast(floor(255 * {rank}) as int) as v0 from {{orders}})"""


WAY_BLOCK = div("l_orderkey", 1500)
#: A vertex hangs on the order, its line and the part alone.
VERTEX = (
    "l_orderkey as way_id", "l_linenumber as pos", "l_partkey as node_id",
    f"cast({WAY_BLOCK} % 1000 * 100000 + (l_orderkey * 7919) % 5000 + l_linenumber * 45 as double) as x",
    f"cast({div(WAY_BLOCK, 1000)} * 100000 + (l_orderkey * 104729) % 5003 + l_partkey % 70 as double) as y",
)


def _vertex() -> str:
    """Map ways: an order is a way, its items its nodes in order; some references dangle."""
    return f"""select way_id, pos, node_id, x, y from (
  select {", ".join(VERTEX[:3])},
    {("," + chr(10) + "    ").join(VERTEX[3:])},
    row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) as copy
  from {{lineitem}}) where copy = 1"""


def _vertices(lineitem: DataFrame) -> DataFrame:
    """The rows of the vertex view. Of the items of a line the first has the least part, and nothing else of it is kept: three columns
    are shuffled, once, as ways are whole in their part."""
    items = lineitem.select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey")
    return items.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).selectExpr(*VERTEX)


def _item() -> str:
    """Tags of the ways."""
    o = "o_orderkey"
    return f"""select {o} as way_id,
  case {o} % 12 when 0 then 'residential' when 1 then 'path' when 2 then 'track' when 3 then 'construction' when 4 then case when {o} % 24 = 4 then 'footway' else 'pedestrian' end when 5 then 'service' when 6 then 'services' when 7 then 'primary' else null end as highway,
  case when {o} % 12 = 8 then 'ferry' else null end as route, case when {o} % 31 = 9 then 'rail' else null end as railway,
  case {o} % 37 when 1 then 'runway' when 2 then 'gate' else null end as aeroway,
  case {o} % 12 when 9 then 'golf_course' when 10 then 'pitch' when 11 then case {o} % 5 when 0 then 'playground' when 1 then 'stadium' when 2 then 'sports_centre' when 3 then 'track' else 'park' end else null end as leisure,
  case {o} % 41 when 1 then 'beach' when 2 then 'sand' else null end as natural_kind,
  case {o} % 7 when 1 then 'yes' when 2 then 'no' else null end as area,
  case {o} % 23 when 1 then 'soccer' when 2 then 'Climbing;fitness' when 3 then 'running;climbing_wall' when 4 then ' ' else null end as sport,
  case {o} % 19 when 1 then 'parking' when 2 then 'parking_space' when 3 then 'bench' else null end as amenity, case when {o} % 17 = 1 then 'sand' end as surface,
  case when {o} % 59 = 1 then 'multipolygon' end as type
from {{orders}}"""


VIEWS = {"candidate": _candidate(), "review": _review(), "heat": _heat(), "vertex": _vertex(), "item": _item()}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "vertex":
        return _vertices(base(spark, sf_dir, "lineitem"))
    sql = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql})


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(body: str, *names: str) -> str:
    """DuckDB SQL: ``body`` after the views that it names, as common table expressions."""
    defined = ", ".join(f"{n} as ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)
    return f"with recursive {defined}, {body}" if not body.lstrip().lower().startswith("select") else f"with recursive {defined} {body}"
