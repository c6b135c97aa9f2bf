"""Queries on areas: which candidates lie in the requested ones, and which areas lie near them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglow.functions import tags
from pathglow.operators import areas, nearby
from pathglow.plans.registry import query
from pathglow.plans.standins import base, div, view, with_views

#: Corners of an area and of the hole in it, in units of its size.
OUTER, HOLE = ((0, 0), (4, 1), (3, 4), (2, 2), (0, 3)), ((0.75, 0.75), (1.5, 0.75), (0.75, 1.5))
BORDERS = [(*a, *b) for ring in (OUTER, HOLE) for a, b in zip(ring, (*ring[1:], ring[0]), strict=True)]
#: Twelve suppliers are the areas of each thousand candidates; a nation's areas are a group, and five groups have none.
PLACE = {
    "region": "s_nationkey", "area": "s_suppkey", "s": "cast(100 + s_suppkey % 7 * 60 as double)",
    "ox": f"cast({div('s_suppkey', 12)} % 1000 * 100000 + s_suppkey * 37 % 4000 as double)",
    "oy": f"cast({div(div('s_suppkey', 12), 1000)} * 100000 + s_suppkey * 53 % 4000 as double)",
}
GROUPS = 30


def _area_sql() -> str:
    """area_edge: the borders of the suppliers' areas, for DuckDB."""
    place = ", ".join(f"{e} as {n}" for n, e in PLACE.items())
    corners = ", ".join(f"({', '.join(f'{v}::double' for v in e)})" for e in BORDERS)
    return f"""place as (select {place} from supplier), area_edge as materialized (
  select region, area, ox + s * ax as x1, oy + s * ay as y1, ox + s * bx as x2, oy + s * by_ as y2 from place, (values {corners}) as e(ax, ay, bx, by_)),
area_box as materialized (select region, area, min(x1) as bx1, min(y1) as by1, max(x1) as bx2, max(y1) as by2 from area_edge group by all)"""


def area_edges(spark, sf_dir) -> DataFrame:
    place = base(spark, sf_dir, "supplier").selectExpr(*[f"{e} as {n}" for n, e in PLACE.items()])
    each = [F.struct(*[(F.col(o) + F.col("s") * float(v)).alias(n) for n, o, v in zip(areas.EDGE, ("ox", "oy", "ox", "oy"), e, strict=True)]) for e in BORDERS]
    return place.select("region", "area", F.explode(F.array(*each)).alias("e")).select("region", "area", "e.*")


#: Distance of a point (px, py) from an edge, and whether a ray to the right crosses it, for DuckDB.
ALONG = "case when power(x2 - x1, 2) + power(y2 - y1, 2) > 0 then greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)))) else 0 end"
TO_EDGE = f"sqrt(power(px - (x1 + ({ALONG}) * (x2 - x1)), 2) + power(py - (y1 + ({ALONG}) * (y2 - y1)), 2))"
CROSSED = "(y1 > py) <> (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1"


@query(with_views(f"""{_area_sql()}, held as (select event_id from (select event_id, area, mx as px, my as py, b.region from candidate join area_box b on event_id % {GROUPS} = region and mx between bx1 - 1 and bx2 + 1 and my between by1 - 1 and by2 + 1) p
  join area_edge using (region, area) group by event_id, area having count(*) filter (where {CROSSED}) % 2 = 1 or min({TO_EDGE}) <= {areas.BOUNDARY})
select event_id, event_id % {GROUPS} as region, event_id % {GROUPS} not in (select region from area_box) or event_id in (select event_id from held) as in_area from candidate""", "candidate"))  # fmt: skip
def in_area_gate(spark, sf_dir):
    """Candidates in the areas of their group, borders included; those of a group without areas are all in."""
    c = view(spark, sf_dir, "candidate").select("event_id", (F.col("event_id") % GROUPS).cast("int").alias("region"), F.col("mx").alias("px"), F.col("my").alias("py"))
    edges = area_edges(spark, sf_dir).withColumn("region", F.col("region").cast("int"))
    return areas.in_area(c, edges, "region").select("event_id", F.col("region").cast("long").alias("region"), "in_area")


CLASSED = f"([{', '.join(repr(c) for c in tags.OPEN_AREAS)}])[(area % 12 + 1)::int]"
#: Distance and containment of candidates and areas near by or not, for DuckDB; ``where`` bounds the pairs.
PAIRS = """pair as materialized (select event_id, area, {classed} as area_class, mx as px, my as py, case when mx between bx1 - 250 and bx2 + 250 and my between by1 - 250 and by2 + 250 then 250.0::double when mx between bx1 - 2000 and bx2 + 2000 and my between by1 - 2000 and by2 + 2000 then 2000.0::double end as radius
  from candidate join area_box b on {where}),
met as materialized (select event_id, area, any_value(area_class) as area_class, any_value(radius) as radius, min({to_edge}) as d, count(*) filter (where {crossed}) % 2 = 1 as odd from pair join area_edge using (area) group by event_id, area),
judged as (select event_id, area, area_class, radius, odd or d <= {boundary} as inside, round(case when odd or d <= {boundary} then 0 else d end, 6) as dist from met)"""


def _pairs_sql(where: str) -> str:
    return PAIRS.format(classed=CLASSED, where=where, to_edge=TO_EDGE, crossed=CROSSED, boundary=areas.BOUNDARY)


def _shapes(spark, sf_dir) -> DataFrame:
    names = F.array(*map(F.lit, tags.OPEN_AREAS))
    edges = area_edges(spark, sf_dir).withColumn("area_class", F.element_at(names, (F.col("area") % 12 + 1).cast("int")))
    return nearby.area_shapes(edges.select("area", "area_class", *areas.EDGE))


def _candidates(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "candidate").select("event_id", F.col("mx").alias("px"), F.col("my").alias("py"))


@query(with_views(f"""{_area_sql()}, {_pairs_sql("mx between bx1 - 2000 and bx2 + 2000 and my between by1 - 2000 and by2 + 2000")},
first as (select event_id, area_class, min(radius) as radius from judged group by all)
select event_id, area_class, area, dist, inside, radius from (select *, row_number() over (partition by event_id, area_class order by inside desc, dist, area) as rn from judged join first using (event_id, area_class, radius)) where rn = 1""", "candidate"))  # fmt: skip
def open_area_by_class(spark, sf_dir):
    """For each candidate and class the best open area within 250 m of its box, else within 2,000 m."""
    return nearby.nearest_by_class(_candidates(spark, sf_dir), _shapes(spark, sf_dir), tags.OPEN_AREAS, "event_id")


@query(with_views(f"""{_area_sql()}, {_pairs_sql("true")},
first as (select event_id, bool_or(radius = 250) as near from judged group by all)
select event_id, area, dist, case when radius = 250 then inside else false end as inside, case when radius = 250 then 250.0::double end as radius from (
  select *, row_number() over (partition by event_id order by near and inside desc, dist, area) as rn from judged join first using (event_id) where not coalesce(near, false) or radius = 250) where rn = 1""", "candidate"))  # fmt: skip
def open_area_of_any_class(spark, sf_dir):
    """For each candidate the best open area within 250 m of its box, else the nearest of all, however far."""
    return nearby.nearest_of_any(_candidates(spark, sf_dir), _shapes(spark, sf_dir), "event_id")


#: Metres of a tile's side.
TILE = 48.0
SAME_SIDE = [" and ".join(f"(x2 - x1) * ({b} - y1) - (y2 - y1) * ({a} - x1) {op} 0" for a in (f"tx * {TILE}", f"(tx + 1) * {TILE}") for b in (f"ty * {TILE}", f"(ty + 1) * {TILE}")) for op in "<>"]
TILES = f"""tile_row as (select area, unnest(range(ceil(bx1 / {TILE})::bigint - 1, floor(bx2 / {TILE})::bigint + 1)) as tx, by1, by2 from area_box),
tile as (select area, tx, unnest(range(ceil(by1 / {TILE})::bigint - 1, floor(by2 / {TILE})::bigint + 1)) as ty from tile_row),
seen as (select area, tx, ty, (tx + 0.5) * {TILE} as px, (ty + 0.5) * {TILE} as py, x1, y1, x2, y2 from tile join area_edge using (area)),
told as (select area, tx, ty, bool_or(least(x1, x2) <= (tx + 1) * {TILE} and greatest(x1, x2) >= tx * {TILE} and least(y1, y2) <= (ty + 1) * {TILE} and greatest(y1, y2) >= ty * {TILE} and not ({SAME_SIDE[0]}) and not ({SAME_SIDE[1]})) as border,
  count(*) filter (where {CROSSED}) % 2 = 1 as inside from seen group by all)"""


@query(with_views(f"""{_area_sql()}, {TILES} select area, count(*) as tiles, count(*) filter (where border) as border_tiles, min(tx * 100000 + ty)::bigint as least_tile, max(tx * 100000 + ty)::bigint as greatest_tile from told where border or inside group by area""", "candidate"))
def tiles_of_areas(spark, sf_dir):
    """The tiles that each supplier's area meets: those inside found whole, by descent."""
    cover = areas.tile_cover(area_edges(spark, sf_dir).select("area", *areas.EDGE), "area", TILE)
    place = F.col("x") * 100000 + F.col("y")
    every = areas.single_tiles(cover, "area").groupBy("area").agg(F.count("*").alias("tiles"), F.min(place).alias("least_tile"), F.max(place).alias("greatest_tile"))
    return every.join(cover.groupBy("area").agg(F.count_if("border").alias("border_tiles")), "area").select("area", "tiles", "border_tiles", "least_tile", "greatest_tile")
