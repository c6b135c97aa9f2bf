"""The query on heat to the side of candidates, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathglow.operators import lateral, mapdata, raster
from pathglow.operators.metrics import BANDS
from pathglow.operators.shared import written
from pathglow.plans.query_spatial import LABELLED, MIN_SIZE, SEGS, THRESHOLD
from pathglow.plans.registry import query
from pathglow.plans.standins import base, div, view, with_views

#: Tiles of 20 cells of 10 metres that lie among the ways of their orders.
PIXEL, SIDE = 10.0, 20
BLOCK = div("tile * 400", 1500)
LEFT = f"cast({BLOCK} % 1000 * 100000 + (tile * 1237) % 4800 as double)"
TOP = f"cast({div(BLOCK, 1000)} * 100000 + (tile * 2311) % 4800 + 200 as double)"


def _moments(r: str, c: str) -> str:
    return f"count(*) as n, sum({c})::double as sc, sum({r})::double as sr, (count(*) * sum({c} * {c}) - sum({c}) * sum({c}))::double as a, (sum({c}) * sum({r}) - count(*) * sum({c} * {r}))::double as b, (count(*) * sum({r} * {r}) - sum({r}) * sum({r}))::double as d"


def _turned(name: str, source: str) -> str:
    """Rows of ``source`` with the unit vector of their moments."""
    return f"""{name} as materialized (select * exclude (vx, vy), vx / nullif(sqrt(vx * vx + vy * vy), 0) as ax, vy / nullif(sqrt(vx * vx + vy * vy), 0) as ay from (
    select *, case when a >= d then a - d + sqrt((a - d) * (a - d) + 4 * b * b) else 2 * b end as vx, case when a >= d then 2 * b else d - a + sqrt((a - d) * (a - d) + 4 * b * b) end as vy from {source}))"""


FOOT = "greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (len * len)))"
GAP = "round(sqrt(power(px - (x1 + t * (x2 - x1)), 2) + power(py - (y1 + t * (y2 - y1)), 2)), 5)"


def _range(a: str, b: str) -> str:
    """The stretch of a piece from a to b, as shares of its length, between 0 and the tile's side."""
    return f"case when {b} = {a} then (case when {a} between 0 and {SIDE} then 0 else 2 end) else least(-{a} / nullif({b} - {a}, 0), ({SIDE} - {a}) / nullif({b} - {a}, 0)) end as {a}_in, case when {b} = {a} then 1 else greatest(-{a} / nullif({b} - {a}, 0), ({SIDE} - {a}) / nullif({b} - {a}, 0)) end as {a}_out"


def _line(kind: str, pieces: str, most: int) -> str:
    """Cells that the parts of a line inside the tile pass."""
    return f"""{kind}_cut as (select *, greatest(0, r1_in, c1_in) as ta, least(1, r1_out, c1_out) as tb from (select *, {_range('r1', 'r2')}, {_range('c1', 'c2')} from {pieces}) where least(1, r1_out, c1_out) > greatest(0, r1_in, c1_in)),
{kind}_part as (select *, sum(fresh) over (partition by tile, comp order by place) as part from (select *, case when lag(place) over w = place - 1 and lag(tb) over w = 1 and ta = 0 then 0 else 1 end as fresh from {kind}_cut window w as (partition by tile, comp order by place))),
{kind}_to as (select *, sum((tb - ta) * sqrt(power(r2 - r1, 2) + power(c2 - c1, 2))) over (partition by tile, comp, part order by place) as upto from {kind}_part),
{kind}_whole as (select *, least({most}, greatest(2, ceil(round(max(upto) over p, 6)) + 1)) - 1 as steps, max(upto) over p as whole, coalesce(lag(upto) over (partition by tile, comp, part order by place), 0) as since, place = max(place) over p as last from {kind}_to window p as (partition by tile, comp, part)),
{kind}_step as (select *, unnest(generate_series(ceil(since / (whole / steps))::bigint, (case when last then steps else ceil(upto / (whole / steps)) - 1 end)::bigint)) as i from {kind}_whole),
{kind}_at as (select tile, comp, part, i, round_even(round(r1 + u * (r2 - r1), 6), 0) as r, round_even(round(c1 + u * (c2 - c1), 6), 0) as c from (select *, ta + (i * (whole / steps) - since) / (upto - since) * (tb - ta) as u from {kind}_step)),
{kind}_seen as (select *, '{kind}' as kind, row_number() over (partition by tile, comp order by part, i) as nth from {kind}_at where r between 0 and {SIDE - 1} and c between 0 and {SIDE - 1} qualify nth <= {most})"""


NEXT_TO = f"""own as materialized (select c.tile, c.comp, c.r, c.c, c.v from cells c join chosen k on k.tile = c.tile and k.comp = c.comp),
sums as (select tile, comp, min(r * 1000 + c) as head, {_moments('r', 'c')}, avg(v) as own_mean, quantile_cont(v, 0.9) as own_p90 from own group by tile, comp),
{_turned('region', '(select *, sr / n as cr, sc / n as cc from sums)')},
around as (select s.tile, s.comp, s.r, s.c, {_moments('q.r', 'q.c')} from own s join own q on q.tile = s.tile and q.comp = s.comp and power(q.r - s.r, 2) + power(q.c - s.c, 2) <= {lateral.AROUND / PIXEL} * {lateral.AROUND / PIXEL} group by all having count(*) >= {lateral.LEAST_CELLS}),
{_turned('near_dir', 'around')},
sample as materialized (select o.tile, o.comp, o.r, o.c, case when l.ax is null then g.ax else l.ax end as ax, case when l.ax is null then g.ay else l.ay end as ay, left_x + o.c * {PIXEL} as px, top_y - o.r * {PIXEL} as py
  from (select *, {LEFT} as left_x, {TOP} as top_y from own) o join region g using (tile, comp) left join near_dir l on l.tile = o.tile and l.comp = o.comp and l.r = o.r and l.c = o.c),
{SEGS}, long as (select *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as len from segs where x1 <> x2 or y1 <> y2),
way as materialized (select way_id, x1, y1, x2, y2, len, row_number() over w as place, sum(len) over w as m2, (sum(len) over w) - len as m1, sum(len) over (partition by way_id) as total from long window w as (partition by way_id order by pos)),
looked as (select tile, comp, r, c, way_id, place, m1, len, total, t, {GAP} as dist from (select *, {FOOT} as t from sample join way on px between least(x1, x2) - {lateral.SEARCH} and greatest(x1, x2) + {lateral.SEARCH} and py between least(y1, y2) - {lateral.SEARCH} and greatest(y1, y2) + {lateral.SEARCH})),
closest as (select *, m1 + t * len as along from looked where dist <= {lateral.SEARCH} qualify row_number() over (partition by tile, comp, r, c, way_id order by dist, place) = 1),
ranked as (select *, greatest(0, along - least({lateral.TANGENT_HALF}, total / 2)) as s, least(total, along + least({lateral.TANGENT_HALF}, total / 2)) as e from closest qualify row_number() over (partition by tile, comp, r, c order by dist, way_id) <= {lateral.MOST_WAYS}),
window_ends as (select k.tile, k.comp, k.r, k.c, k.way_id, any_value(k.dist) as dist,
    arg_max(w.x1 + (e - w.m1) / w.len * (w.x2 - w.x1), w.place) - arg_min(w.x1 + (s - w.m1) / w.len * (w.x2 - w.x1), w.place) as tx, arg_max(w.y1 + (e - w.m1) / w.len * (w.y2 - w.y1), w.place) - arg_min(w.y1 + (s - w.m1) / w.len * (w.y2 - w.y1), w.place) as ty
  from ranked k join way w on w.way_id = k.way_id and w.m2 >= k.s and w.m1 <= k.e where k.e - k.s >= {lateral.LEAST_SPAN} group by all),
angled as (select tile, comp, r, c, way_id, dist, round(degrees(acos(least(1, abs(ax * tx + ay * ty) / nullif(sqrt(ax * ax + ay * ay) * sqrt(tx * tx + ty * ty), 0)))), 5) as angle from window_ends join sample using (tile, comp, r, c)),
best as materialized (select tile, comp, r, c, min(dist) filter (where angle <= {lateral.PARALLEL}) as dist15, min(dist) filter (where angle <= {lateral.WIDE}) as dist30, arg_min(way_id, (dist, way_id)) filter (where angle <= {lateral.PARALLEL}) as way_id, arg_min(angle, (dist, way_id)) filter (where angle <= {lateral.PARALLEL}) as angle from angled group by all),
cover as (select tile, comp, {', '.join(f'round(avg(coalesce(dist15 <= {b}, false)::int), 6) as cover{b}' for b in BANDS)}, round(avg(coalesce(dist30 <= {BANDS[-1]}, false)::int), 6) as cover250_30 from sample left join best using (tile, comp, r, c) group by all),
won as materialized (select * from (select tile, comp, way_id, count(*) as votes, quantile_cont(dist15, 0.5) as d_median, min(dist15) as d_min, quantile_cont(angle, 0.5) as angle_median from best where way_id is not null group by all) qualify row_number() over (partition by tile, comp order by votes desc, d_median, way_id) = 1),
centre as (select *, left_x + cc * {PIXEL} as px, top_y - cr * {PIXEL} as py from (select tile, comp, way_id, cr, cc, {LEFT} as left_x, {TOP} as top_y from won join region using (tile, comp))),
piece as materialized (select tile, comp, place, (top_y - y1) / {PIXEL} as r1, (x1 - left_x) / {PIXEL} as c1, (top_y - y2) / {PIXEL} as r2, (x2 - left_x) / {PIXEL} as c2 from centre join way using (way_id)),
foot as (select *, {FOOT} as t from centre join way using (way_id)),
gap as materialized (select tile, comp, 1 as place, cr as r1, cc as c1, (top_y - (y1 + t * (y2 - y1))) / {PIXEL} as r2, (x1 + t * (x2 - x1) - left_x) / {PIXEL} as c2 from foot qualify row_number() over (partition by tile, comp order by {GAP}, place) = 1),
{_line('way', 'piece', lateral.ON_LINE)},
{_line('between', 'gap', lateral.BETWEEN)},
reach as (select tile, comp, cr, cc, ax, ay, min((c - cc) * ax - (r - cr) * ay) as t0, max((c - cc) * ax - (r - cr) * ay) as t1 from own join region using (tile, comp) where n >= 2 and ax is not null group by all),
paced as (select *, case when round(t1 - t0, 6) < 1 then 0 else least({lateral.ON_LINE}, greatest(2, round_even(round(t1 - t0, 6), 0) + 1)) - 1 end as steps from reach),
strode as (select *, case when steps = 0 then 0 else t0 + (t1 - t0) * i / steps end as s from (select *, unnest(generate_series(0, steps::bigint)) as i from paced)),
axis_seen as (select tile, comp, 'axis' as kind, round_even(round(cr - s * ay, 6), 0) as r, round_even(round(cc + s * ax, 6), 0) as c from strode),
seen as (select kind, p.tile, p.comp, coalesce(h.v, 0) as v from (select tile, comp, kind, r, c from axis_seen where r between 0 and {SIDE - 1} and c between 0 and {SIDE - 1} union all select tile, comp, kind, r, c from way_seen union all select tile, comp, kind, r, c from between_seen) p left join heat h on h.tile = p.tile and h.r = p.r and h.c = p.c),
stat as (select tile, comp, {', '.join(f"avg(v) filter (where kind = '{k}') as {k}_mean, quantile_cont(v, 0.9) filter (where kind = '{k}') as {k}_p90, count(*) filter (where kind = '{k}') as {k}_n" for k in ('axis', 'way'))}, quantile_cont(v, 0.5) filter (where kind = 'between') as between_median from seen group by all)
select tile, (head // 1000)::int as r, (head % 1000)::int as c, n, way_id, round(d_median, 6) as d_median, d_min, round(angle_median, 6) as angle_median, {', '.join(f'cover{b}' for b in BANDS)}, cover250_30, coalesce(votes, 0) as votes, coalesce(axis_n, 0) as axis_n, coalesce(way_n, 0) as way_n,
  {', '.join(f'round({c}, 4) as {c}' for c in ('own_mean', 'own_p90', 'axis_mean', 'axis_p90', 'way_mean', 'way_p90', 'between_median'))}, round(way_mean / own_mean, 4) as ratio_mean, round(way_p90 / own_p90, 4) as ratio_p90, round(between_median / own_mean, 4) as between_ratio,
  case when way_p90 is not null and between_median is not null then round(least(way_p90, between_median) / own_p90, 4) end as halo
from region join cover using (tile, comp) left join won using (tile, comp) left join stat using (tile, comp)"""


@query(with_views(f"{LABELLED}, {NEXT_TO}", "heat", "vertex"))
def lateral_heat(spark, sf_dir):
    """Each tile's candidates against the ways around: cover, the way beside it, heat on it and between, halo."""
    heat = written(view(spark, sf_dir, "heat"), "heat")
    cells = written(raster.labelled_cells(heat, THRESHOLD).where("comp >= 0"), "labelled")
    chosen = raster.peaks(cells, MIN_SIZE).select("tile", "comp")
    own = cells.join(chosen, ["tile", "comp"], "left_semi").select("tile", "comp", "r", "c", "v")
    return lateral.lateral_metrics(own, mapdata.segments(view(spark, sf_dir, "vertex")), heat, F.expr(LEFT), F.expr(TOP), PIXEL, SIDE)


#: An order is a triangle of its tile, some of them wide, some partly outside.
CORNERS = [f"o_orderkey % 20 - 1.7e0 + ({s})" for s in ("0", "w", "w / 2")], [f"o_orderkey * 7 % 20 - 1.7e0 + ({s})" for s in ("0", "w / 2", "w")]
TRIANGLES = " union all ".join(f"select tile, shape, {CORNERS[0][i]} as r1, {CORNERS[1][i]} as c1, {CORNERS[0][(i + 1) % 3]} as r2, {CORNERS[1][(i + 1) % 3]} as c2 from {{orders}}" for i in range(3))
WIDTH = "case when o_orderkey % 16 = 3 then 2e0 + o_orderkey % 4 else 0.4e0 end"


@query(with_views(f"""shapes as (select *, {div('o_orderkey', 400)} as tile, o_orderkey as shape, {WIDTH} as w from orders), edges as ({TRIANGLES.replace('{orders}', 'shapes')}),
inside as (select distinct tile, r, c from (select tile, r, c, shape from heat join edges using (tile) group by all having count(*) filter (where (r1 > r) <> (r2 > r) and c < (c2 - c1) * (r - r1) / (r2 - r1) + c1) % 2 = 1))
select tile, count(*) as cells, count(*) filter (where i.tile is null and v > 0) as hot_left, sum(case when i.tile is null then v else 0 end)::bigint as heat_left from heat left join inside i using (tile, r, c) group by tile""", "heat"))  # fmt: skip
def heat_after_fill(spark, sf_dir):
    """Heat that areas leave: every order is a polygon, filled in its tile."""
    shapes = base(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{div('o_orderkey', 400)} as tile", "o_orderkey as shape", f"{WIDTH} as w")
    edges = F.array(*[F.struct(*[F.expr(e).alias(n) for n, e in (("r1", CORNERS[0][i]), ("c1", CORNERS[1][i]), ("r2", CORNERS[0][(i + 1) % 3]), ("c2", CORNERS[1][(i + 1) % 3]))]) for i in range(3)])
    left = raster.fill_polygons(view(spark, sf_dir, "heat"), shapes.select("tile", "shape", F.explode(edges).alias("e")).select("tile", "shape", "e.*"), SIDE)
    return left.groupBy("tile").agg(F.count("*").alias("cells"), F.count_if(F.col("v") > 0).alias("hot_left"), F.sum("v").alias("heat_left"))
