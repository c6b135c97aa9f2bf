"""The detector as one query: tiles, ways and areas in, candidates with measured metrics and verdicts out."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathglow.operators import areas, mapdata
from pathglow.operators.areas import BOUNDARY
from pathglow.operators.detector import FERRY, Frame, Rules, detect
from pathglow.plans.query_areas import CROSSED, TO_EDGE, _area_sql, area_edges
from pathglow.plans.query_lateral import LEFT, NEXT_TO, PIXEL, SIDE, TOP
from pathglow.plans.query_spatial import LABELLED, MIN_SIZE, THRESHOLD
from pathglow.plans.registry import query
from pathglow.plans.standins import view, with_views

HALF = (2 * round(PIXEL / PIXEL) + 1) / 2
#: Cells that no way explains within one cell's width, as the tables that the labelling reads; then peaks, areas, ferries.
LEFT_OVER = f"""frame as materialized (select tile, {LEFT} as left_x, {TOP} as top_y from (select distinct tile from heat)),
line as materialized (select * from (select way_id, x as x1, y as y1, lead(x) over w as x2, lead(y) over w as y2 from vertex window w as (partition by way_id order by pos)) where x2 is not null),
burning as (select tile, (top_y - y1) / {PIXEL} as r1, (x1 - left_x) / {PIXEL} as c1, (top_y - y2) / {PIXEL} as r2, (x2 - left_x) / {PIXEL} as c2 from frame join line
  on least(x1, x2) <= left_x + {SIDE * PIXEL} + 99 and greatest(x1, x2) >= left_x - 99 and least(y1, y2) <= top_y + 99 and greatest(y1, y2) >= top_y - {SIDE * PIXEL} - 99),
burnt as (select distinct tile, r, c from (select tile, r, c, c1, r1, c2, r2, case when power(c2 - c1, 2) + power(r2 - r1, 2) > 0 then greatest(0, least(1, ((c - c1) * (c2 - c1) + (r - r1) * (r2 - r1)) / (power(c2 - c1, 2) + power(r2 - r1, 2)))) else 0 end as t from heat join burning using (tile))
  where sqrt(power(c - (c1 + t * (c2 - c1)), 2) + power(r - (r1 + t * (r2 - r1)), 2)) <= {HALF}),
unexplained as materialized (select tile, r, c, case when b.tile is null then v else 0 end as v from heat left join burnt b using (tile, r, c))"""
GATED = f"""peak_at as materialized (select tile, comp, r, c, peak, size, left_x + c * {PIXEL} as px, top_y - r * {PIXEL} as py from chosen join frame using (tile)),
held as (select distinct tile, comp from (select tile, comp, area from (select * from peak_at join area_box on px between bx1 - 1 and bx2 + 1 and py between by1 - 1 and by2 + 1) join area_edge using (region, area)
  group by tile, comp, area having count(*) filter (where {CROSSED}) % 2 = 1 or min({TO_EDGE}) <= {BOUNDARY})),
by_sea as (select tile, comp, min({TO_EDGE}) as ferry_dist from peak_at join (select line.* from line join item using (way_id) where route = 'ferry') on px between least(x1, x2) - {FERRY} and greatest(x1, x2) + {FERRY} and py between least(y1, y2) - {FERRY} and greatest(y1, y2) + {FERRY}
  group by tile, comp having min({TO_EDGE}) <= {FERRY})"""


@query(with_views(f"""{LEFT_OVER}, {_area_sql()}, {LABELLED.replace("from heat", "from unexplained")}, {GATED}, beside as (with {NEXT_TO})
select p.tile, p.r::int as r, p.c::int as c, p.peak::int as peak, p.size, round(ferry_dist, 3) as ferry_dist, between_ratio, halo, ferry_dist is not null as by_ferry, coalesce(between_ratio >= 1, false) as by_halo, not (ferry_dist is not null or coalesce(between_ratio >= 1, false)) as written
from peak_at p join held using (tile, comp) left join by_sea using (tile, comp) left join beside b on b.tile = p.tile and b.r * 1000 + b.c = p.comp""", "heat", "vertex", "item"))  # fmt: skip
def detected_candidates(spark, sf_dir):
    """Heat that no way explains, in the suppliers' areas, against ferries and the heat beside it."""
    frame = Frame(F.expr(LEFT), F.expr(TOP), PIXEL, SIDE)
    kinds = view(spark, sf_dir, "item").select("way_id", (F.coalesce("route", F.lit("")) == "ferry").alias("ferry"))
    none = spark.range(0).selectExpr("'' as area", "false as golf", "false as fill", *[f"0.0D as {n}" for n in areas.EDGE])
    prior = spark.range(0).selectExpr("'' as candidate_id", "'' as status")
    requested = area_edges(spark, sf_dir).select("area", "x1", "y1", "x2", "y2")
    rules = Rules(THRESHOLD, MIN_SIZE, PIXEL, parallel=False)
    found = detect(view(spark, sf_dir, "heat"), mapdata.segments(view(spark, sf_dir, "vertex")), kinds, none, requested, prior, frame, F.concat_ws("/", "tile", "r", "c"), F.lit("all"), rules)
    return found.select("tile", "r", "c", "peak", "size", F.round("ferry_dist", 3).alias("ferry_dist"), "between_ratio", "halo", "by_ferry", "by_halo", "written")
