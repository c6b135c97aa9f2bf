"""Queries on rules: grids, frontiers, ranked lists, categories and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathglow.functions import tags, text
from pathglow.operators import labels, rules
from pathglow.operators.quantiles import exact_quantiles
from pathglow.operators.rules import Rule
from pathglow.plans.registry import query
from pathglow.plans.rulebook import full_grid, lateral_grid, remaining_grid, second_grid
from pathglow.plans.standins import view, with_views

CANONICAL = "replace(trim(status_raw), ' ', '_')"
STATUS = f"case lower({CANONICAL}) when 'not_an_issue' then 'Not_An_Issue' else {CANONICAL} end"
LABELLED = f"""labelled as materialized (
  select c.*, l.status, coalesce(follow100 >= 0.7 and parallel15 >= 0.7, false) as existing_parallel from candidate c
  left join (select event_id, {STATUS} as status from (select *, row_number() over (partition by event_id order by ord desc) as rn from review) where rn = 1) l using (event_id))"""
ACCEPTED = "accepted as materialized (select * from labelled where size > 3 and inside_area)"
SUPPRESSED = "(existing_parallel or coalesce(ferry_dist <= 500, false))"


def oracle(body: str) -> str:
    return with_views(f"{LABELLED}, {ACCEPTED}, {body}" if not body.lstrip().startswith("select") else f"{LABELLED}, {ACCEPTED} {body}", "candidate", "review")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.with_labels(view(spark, sf_dir, "candidate"), view(spark, sf_dir, "review"), "event_id", "ord", "status_raw")
    return rows.withColumn("existing_parallel", tags.parallel_rule(F.col("follow100"), F.col("parallel15")))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).where("size > 3 and inside_area")


def suppressed():
    return F.col("existing_parallel") | tags.ferry_rule(F.col("ferry_dist"))


def per_rule(own: list[Rule], source: str, columns: str, more: str = "") -> str:
    """A scan of ``source`` a rule, all in one statement."""
    quoted = [(r.name.replace("'", "''"), r.family, r.complexity, r.sql()) for r in own]
    return " union all ".join(f"select '{n}' as rule_name, '{f}' as family, {c} as complexity, {columns.format(hit='hit')} from (select *, {h} as hit from {source}){more}" for n, f, c, h in quoted)


COUNTS = """count(*) filter (where {hit}) as removed_total, count(*) filter (where {hit} and status = 'Not_An_Issue') as removed_nai,
  count(*) filter (where {hit} and status = 'Fixed') as removed_fixed, count(*) filter (where {hit} and status = 'Too_Hard') as removed_too_hard,
  count(*) filter (where {hit} and status is null) as removed_unlabeled"""
EVALUATED = """evaluated as (select *, removed_nai + removed_fixed + removed_too_hard as removed_labeled,
  case when all_nai > 0 then round(removed_nai / all_nai, 6) end as nai_recall, case when all_fixed > 0 then round(removed_fixed / all_fixed, 6) end as fixed_loss,
  case when removed_nai + removed_fixed > 0 then round(removed_nai / (removed_nai + removed_fixed), 6) end as precision_of_removed
  from counted, (select count(*) filter (where status = 'Not_An_Issue') as all_nai, count(*) filter (where status = 'Fixed') as all_fixed from accepted))"""
RESULT = "rule_name, family, complexity::int as complexity, removed_total, removed_nai, removed_fixed, removed_too_hard, removed_unlabeled, removed_labeled, nai_recall, fixed_loss, precision_of_removed"
FULL = f"counted as ({per_rule(full_grid(), 'accepted', COUNTS)}), {EVALUATED}"
FRONT = "front as (select * from evaluated a where not exists (select 1 from evaluated b where b.removed_nai >= a.removed_nai and b.removed_fixed <= a.removed_fixed and (b.removed_nai > a.removed_nai or b.removed_fixed < a.removed_fixed)))"


@query(oracle(f"{FULL} select {RESULT} from evaluated"))
def rule_eval_grid(spark, sf_dir):
    return rules.evaluate(accepted(spark, sf_dir), full_grid())


@query(oracle(f"{FULL}, {FRONT} select {RESULT} from front"))
def rule_pareto(spark, sf_dir):
    return rules.pareto(rules.evaluate(accepted(spark, sf_dir), full_grid()))


def _ranked(limit: float) -> str:
    return oracle(f"{FULL} select {RESULT}, (row_number() over (order by removed_nai desc, removed_fixed, rule_name))::int as rank from evaluated where removed_nai > 0 and fixed_loss <= {limit}")


@query(_ranked(0.02))
def rule_ranked_conservative(spark, sf_dir):
    return rules.ranked(rules.evaluate(accepted(spark, sf_dir), full_grid()), 0.02)


@query(_ranked(0.05))
def rule_ranked_aggressive(spark, sf_dir):
    return rules.ranked(rules.evaluate(accepted(spark, sf_dir), full_grid()), 0.05)


@query(oracle(f"""{FULL}, {FRONT}, pools as (
  select rule_name, 0 as pool, row_number() over (order by removed_nai desc, removed_fixed, coalesce(precision_of_removed, 0) desc, rule_name) as place from front where removed_nai > 0
  union all select rule_name, 1, row_number() over (order by removed_nai desc, removed_fixed, rule_name) from evaluated where removed_nai > 0 and fixed_loss <= 0.02
  union all select rule_name, 2, row_number() over (order by removed_nai desc, removed_fixed, rule_name) from evaluated where removed_nai > 0 and fixed_loss <= 0.05
  union all select rule_name, 3, row_number() over (order by removed_nai desc, removed_total desc, rule_name) from evaluated where removed_nai > 0 and removed_fixed = 0
), firsts as (select *, row_number() over (partition by rule_name order by pool, place) as rn from pools)
select * from (select (row_number() over (order by pool, place))::int as rank, rule_name, pool::int as pool from firsts where rn = 1) where rank <= 10"""))  # fmt: skip
def rule_best10(spark, sf_dir):
    return rules.best_of(rules.evaluate(accepted(spark, sf_dir), full_grid()))


LEFT = f"remaining as materialized (select * from accepted where not {SUPPRESSED})"


@query(oracle(f"""{LEFT}, counted as ({per_rule(remaining_grid(), 'remaining', COUNTS)}), before as (
  select count(*) filter (where {SUPPRESSED}) as was, count(*) filter (where {SUPPRESSED} and status = 'Not_An_Issue') as was_nai,
    count(*) filter (where {SUPPRESSED} and status = 'Fixed') as was_fixed, count(*) filter (where not {SUPPRESSED}) as remain from accepted)
select rule_name, removed_total, removed_nai, removed_fixed, removed_too_hard, was + removed_total as total_suppressed, remain - removed_total as still_left,
  was_nai + removed_nai as total_nai, was_fixed + removed_fixed as total_fixed from counted, before"""))  # fmt: skip
def incremental_rule_eval(spark, sf_dir):
    return rules.evaluate_on_remaining(accepted(spark, sf_dir), remaining_grid(), suppressed())


@query(oracle(f"{LEFT}, counted as ({per_rule(second_grid(), 'remaining', COUNTS)}) select rule_name, family, complexity::int as complexity, removed_total, removed_nai, removed_fixed, removed_too_hard, removed_unlabeled from counted"))
def rule_eval_second_grid(spark, sf_dir):
    found = rules.evaluate(accepted(spark, sf_dir).where(~suppressed()), second_grid())
    return found.select("rule_name", "family", "complexity", "removed_total", "removed_nai", "removed_fixed", "removed_too_hard", "removed_unlabeled")


@query(oracle(f"""{LEFT}, sets as ({per_rule(second_grid(), 'remaining', "list(event_id order by event_id) filter (where {hit}) as ids")})
select rule_name, family, complexity::int as complexity, coalesce(len(ids), 0)::bigint as removed_total from (
  select *, row_number() over (partition by ids order by complexity, length(rule_name), rule_name) as rn from sets) where rn = 1"""))  # fmt: skip
def rule_dedupe(spark, sf_dir):
    return rules.distinct_rules(accepted(spark, sf_dir).where(~suppressed()), second_grid())


def _universes() -> str:
    kinds = {"nai": "Not_An_Issue", "fixed": "Fixed", "already_fixed": "Already_Fixed", "too_hard": "Too_Hard"}
    columns = ", ".join(f"count(*) filter (where {{hit}} and status = '{v}') as removed_{k}, count(*) filter (where not {{hit}} and status = '{v}') as retained_{k}" for k, v in kinds.items())
    names = ", ".join(f"removed_{k}, retained_{k}" for k in kinds)
    return oracle(f"""spread as (select *, 'accepted' as universe from accepted union all select *, 'remaining' as universe from accepted where not {SUPPRESSED}),
    counted as ({per_rule(lateral_grid(), 'spread', 'universe, count(*) as n_universe, ' + columns, ' group by universe')}) select rule_name, universe, n_universe, {names} from counted""")


@query(_universes())
def status_rule_universe(spark, sf_dir):
    universe = F.when(suppressed(), F.array(F.lit("accepted"))).otherwise(F.array(F.lit("accepted"), F.lit("remaining")))
    return rules.evaluate_by_universe(accepted(spark, sf_dir), lateral_grid(), universe)


@query(oracle(" union all ".join(f"select '{r.name}' as rule_name, event_id, candidate_id from accepted where status = 'Fixed' and {r.sql()}" for r in remaining_grid())))
def rule_removed_ids(spark, sf_dir):
    return rules.removed_ids(accepted(spark, sf_dir), remaining_grid(), "candidate_id", "event_id")


def _leftover() -> str:
    own = remaining_grid()
    safe = f"counted as ({per_rule(own, 'accepted', COUNTS)}), safe as (select rule_name from counted where removed_nai > 0 and removed_fixed = 0 and removed_too_hard = 0)"
    hits = " union all ".join(f"select event_id, '{r.name}' as rule_name from accepted where {r.sql()}" for r in own)
    return oracle(f"{safe}, hits as ({hits}) select candidate_id, peak_dist from accepted where status = 'Not_An_Issue' and event_id not in (select event_id from hits join safe using (rule_name))")


@query(_leftover())
def rule_leftovers(spark, sf_dir):
    return rules.leftovers(accepted(spark, sf_dir), remaining_grid(), "peak_dist", "candidate_id")


def _category(first: bool) -> str:
    near = "(follow100 >= 0.7 and parallel15 >= 0.5) or (parallel15 >= 0.7 and follow100 >= 0.5)"
    close = "when peak_dist <= 50 then 'close_to_existing_osm'"
    miss = f"when ({near})" + (" and not existing_parallel" if first else "") + " then 'near_parallel_miss'"
    ferry = "when ferry_dist <= 500 then 'ferry'" if first else ""
    order = f"{miss} {close}" if first else f"{close} {miss}"
    return f"""case {ferry} when constr_dist <= 100 then 'construction' when lower(trim(tunnel)) = 'yes' then 'tunnel' {order}
      when follow100 >= 0.7 and parallel30 >= 0.7 and (parallel15 is null or parallel15 < 0.7) then 'weak_parallel_existing_osm' when peak_dist > 100 then 'far_from_existing_osm' else 'other' end"""


def _categorised(first: bool) -> str:
    return oracle(f"select candidate_id, {_category(first)} as category from accepted")


@query(_categorised(True))
def remaining_category_v1(spark, sf_dir):
    return accepted(spark, sf_dir).select("candidate_id", tags.remaining_category(first=True).alias("category"))


@query(_categorised(False))
def remaining_category_v2(spark, sf_dir):
    return accepted(spark, sf_dir).select("candidate_id", tags.remaining_category(first=False).alias("category"))


BUCKET = "case when status = 'Not_An_Issue' then 'nai' when status = 'Fixed' then 'fixed' when status = 'Too_Hard' then 'too_hard' when coalesce(status, '') <> '' then 'other' else 'unmatched' end"
BUCKETS = ("nai", "fixed", "too_hard", "other", "unmatched")


def _pivot(key: str) -> str:
    counts = ", ".join(f"count(*) filter (where bucket = '{b}') as n_{b}" for b in BUCKETS)
    return oracle(f"select {key}, count(*) as n, {counts}, round(count(*) * 100.0::double / (select count(*) from accepted), 4) as percent from (select *, {_category(False)} as category, coalesce(nullif(trim(highway), ''), '(empty)') as shown, {BUCKET} as bucket from accepted) group by {key}")


def _pivoted(rows: DataFrame, key: str) -> DataFrame:
    total = rows.agg(F.count("*").alias("total"))
    counted = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in BUCKETS])
    return counted.crossJoin(F.broadcast(total)).withColumn("percent", F.round(F.col("n") * 100.0 / F.col("total"), 4)).drop("total")


@query(_pivot("category"))
def category_pivot(spark, sf_dir):
    rows = accepted(spark, sf_dir).withColumn("category", tags.remaining_category(first=False)).withColumn("bucket", tags.status_bucket(F.col("status")))
    return _pivoted(rows, "category")


@query(_pivot("shown"))
def value_pivot(spark, sf_dir):
    rows = accepted(spark, sf_dir).withColumn("shown", F.coalesce(F.nullif(F.trim("highway"), F.lit("")), F.lit("(empty)"))).withColumn("bucket", tags.status_bucket(F.col("status")))
    return _pivoted(rows, "shown")


FIELDS = ("peak_dist", "p90", "iqr", "follow100", "parallel15", "elongation", "ratio_p90", "halo")
DESCRIBED = " union all ".join(f"""select '{f}' as field, {BUCKET} as bucket, count({f}) as n, round(min({f}), 6) as low, round(quantile_cont({f}, 0.25), 6) as p25, round(quantile_cont({f}, 0.5), 6) as median,
  round(avg({f}), 6) as mean, round(quantile_cont({f}, 0.75), 6) as p75, round(max({f}), 6) as high from accepted group by all""" for f in FIELDS)  # fmt: skip


@query(oracle(f"select * from ({DESCRIBED})"))
def describe_by_status(spark, sf_dir):
    rows = accepted(spark, sf_dir).withColumn("bucket", tags.status_bucket(F.col("status")))
    long = rows.unpivot(["bucket"], list(FIELDS), "field", "x")
    stats = exact_quantiles(long, ["field", "bucket"], "x", (0.25, 0.5, 0.75))
    return stats.select("field", "bucket", "n", *[F.round(c, 6).alias(n) for n, c in (("low", F.col("low")), ("p25", F.col("q")[0]), ("median", F.col("q")[1]), ("mean", F.col("mean")), ("p75", F.col("q")[2]), ("high", F.col("high")))])


GROUPED = "case when status = 'Not_An_Issue' then 'nai' when status = 'Too_Hard' then 'too_hard' when status in ('Fixed', 'Already_Fixed') then 'positive' end"


@query(oracle(f"select g as label_group, count(*) as n, round(quantile_cont(peak_dist, 0.5), 6) as peak_dist, round(quantile_cont(p90, 0.5), 6) as p90, round(quantile_cont(follow100, 0.5), 6) as follow100 from (select *, {GROUPED} as g from accepted) where g is not null group by g"))
def metric_medians(spark, sf_dir):
    s = F.col("status")
    group = F.when(s == "Not_An_Issue", "nai").when(s == "Too_Hard", "too_hard").when(s.isin("Fixed", "Already_Fixed"), "positive")
    rows = accepted(spark, sf_dir).withColumn("label_group", group).where("label_group is not null")
    names = ["peak_dist", "p90", "follow100"]
    medians = exact_quantiles(rows.unpivot(["label_group"], names, "field", "x"), ["label_group", "field"], "x", (0.5,))
    shown = [F.round(F.max(F.when(F.col("field") == c, F.col("q")[0])), 6).alias(c) for c in names]
    return rows.groupBy("label_group").agg(F.count("*").alias("n")).join(medians.groupBy("label_group").agg(*shown), "label_group", "left")


PROXIES = {"pixels": (0, "<=", (20, 50, 100)), "heat_max": (999, "<", (60, 100, 140))}
PROXY = " union all ".join(f"select '{f}' as field, {t}::int as threshold, {BUCKET} as bucket, count(*) filter (where coalesce(nullif({f}, 0), {d}) {op} {t}) as hits, count(*) as n from accepted group by all" for f, (d, op, ts) in PROXIES.items() for t in ts)


@query(oracle(f"select * from ({PROXY})"))
def threshold_proxy(spark, sf_dir):
    rows = accepted(spark, sf_dir).withColumn("bucket", tags.status_bucket(F.col("status")))
    steps = []
    for field, (default, op, thresholds) in PROXIES.items():
        value = F.coalesce(F.nullif(F.col(field), F.lit(0)), F.lit(default))
        steps += [F.struct(F.lit(field).alias("field"), F.lit(t).alias("threshold"), (value <= t if op == "<=" else value < t).alias("hit")) for t in thresholds]
    return rows.select("bucket", F.explode(F.array(*steps)).alias("s")).groupBy("s.field", "s.threshold", "bucket").agg(F.count_if("s.hit").alias("hits"), F.count("*").alias("n"))


@query(oracle(f"select {BUCKET} as bucket, string_agg(candidate_id, ';' order by event_id) as examples, max(n) as hits from (select *, row_number() over (partition by {BUCKET} order by event_id) as rn, count(*) over (partition by {BUCKET}) as n from accepted where p90 <= 60) where rn <= 8 group by 1"))
def hit_examples(spark, sf_dir):
    """The first eight hits of each bucket; min-heaps of eight are kept per task, the hits are not gathered."""
    rows = accepted(spark, sf_dir).where("p90 <= 60").withColumn("bucket", tags.status_bucket(F.col("status")))
    parts = rows.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(64)))
    from pyspark.sql import Window

    few = parts.withColumn("rn", F.row_number().over(Window.partitionBy("bucket", "part").orderBy("event_id"))).where("rn <= 8")
    firsts = few.groupBy("bucket").agg(F.slice(F.array_sort(F.collect_list(F.struct("event_id", "candidate_id"))), 1, 8).alias("x"))
    n = rows.groupBy("bucket").agg(F.count("*").alias("hits"))
    return firsts.join(n, "bucket").select("bucket", F.array_join(F.transform("x", lambda x: x["candidate_id"]), ";").alias("examples"), "hits")


GOLF_STATS = """select status, count(*) filter (where golf) as hits, count(*) as n,
  case when sum(count(*) filter (where golf and status in ('Not_An_Issue', 'Fixed'))) over () > 0 then round(sum(count(*) filter (where golf and status = 'Not_An_Issue')) over () / sum(count(*) filter (where golf and status in ('Not_An_Issue', 'Fixed'))) over (), 6) end as precision_of_removed
from accepted where status is not null group by status"""


@query(oracle(GOLF_STATS))
def predicate_stats(spark, sf_dir):
    rows = accepted(spark, sf_dir).where("status is not null")
    stats = rows.groupBy("status").agg(F.count_if("golf").alias("hits"), F.count("*").alias("n"))
    s = F.col("status")
    both = stats.agg(F.sum(F.when(s == "Not_An_Issue", F.col("hits"))).alias("a"), F.sum(F.when(s.isin("Not_An_Issue", "Fixed"), F.col("hits"))).alias("b"))
    return stats.crossJoin(F.broadcast(both)).select("status", "hits", "n", F.when(F.col("b") > 0, F.round(F.col("a") / F.col("b"), 6)).alias("precision_of_removed"))


@query(oracle("select candidate_id, status from labelled"))
def label_join_last_wins(spark, sf_dir):
    return labelled(spark, sf_dir).select("candidate_id", "status")


@query(with_views("select count(*) filter (where c.event_id is not null) as candidates, count(*) filter (where c.event_id is not null and r.event_id is not null) as labelled, count(*) filter (where c.event_id is null) as reviews_without_candidate from candidate c full join (select distinct event_id from review) r using (event_id)", "candidate", "review"))
def join_coverage(spark, sf_dir):
    return labels.label_coverage(view(spark, sf_dir, "candidate"), view(spark, sf_dir, "review"), "event_id")


@query(with_views("select event_id, candidate_id, task_id, mapper from candidate join (select * from (select *, row_number() over (partition by event_id order by ord) as rn from review) where rn = 1) using (event_id)", "candidate", "review"))
def feature_join_first_wins(spark, sf_dir):
    first = labels.first_wins(view(spark, sf_dir, "review"), "event_id", "ord").select("event_id", "task_id", "mapper")
    return view(spark, sf_dir, "candidate").select("event_id", "candidate_id").join(first, "event_id")


@query(oracle("select candidate_id, status as prior_status, coalesce(status in ('Fixed', 'Already_Fixed'), false) as warn_done from accepted where not existing_parallel and coalesce(status, '') not in ('Too_Hard', 'Not_An_Issue')"))
def output_gate_anti(spark, sf_dir):
    rows = accepted(spark, sf_dir).drop("status")
    last = labels.last_wins(view(spark, sf_dir, "review").select("event_id", "ord", "status_raw"), "event_id", "ord").select("event_id", text.canonical_status(F.col("status_raw")).alias("status"))
    return labels.output_gate(rows, last, "event_id", F.col("existing_parallel")).select("candidate_id", "prior_status", "warn_done")


FLAGS = {"parallel": "existing_parallel", "ferry": "coalesce(ferry_dist <= 500, false)", "halo": "coalesce(between >= 1.0, false)", "golf": "(layer = 'all' and golf)"}
FLAGGED = "flagged as (select *, " + ", ".join(f"{x} as by_{n}" for n, x in FLAGS.items()) + " from labelled)"


@query(oracle(f"""{FLAGGED} select layer, count(*) as raw, count(*) filter (where size <= 3) as too_small, count(*) filter (where size > 3 and inside_area) as accepted,
  count(*) filter (where ok and by_parallel) as parallel, count(*) filter (where ok and by_ferry) as ferry, count(*) filter (where ok and by_halo) as halo, count(*) filter (where ok and by_golf) as golf,
  count(*) filter (where ok and by_parallel and by_ferry) as overlap, count(*) filter (where ok and by_halo and not by_parallel and not by_ferry) as halo_additional,
  count(*) filter (where ok and by_golf and not by_parallel and not by_ferry and not by_halo) as golf_additional, count(*) filter (where ok and (by_parallel or by_ferry or by_halo or by_golf)) as any_rule
from (select *, size > 3 and inside_area as ok from flagged) group by layer"""))  # fmt: skip
def suppression_counters(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    p, f = F.col("existing_parallel"), tags.ferry_rule(F.col("ferry_dist"))
    h, g = tags.halo_rule(F.col("between")), tags.golf_rule(F.col("layer"), F.col("golf"))
    ok = (F.col("size") > 3) & F.col("inside_area")
    counts = {"too_small": F.col("size") <= 3, "accepted": ok, "parallel": ok & p, "ferry": ok & f, "halo": ok & h, "golf": ok & g, "overlap": ok & p & f, "halo_additional": ok & h & ~p & ~f, "golf_additional": ok & g & ~p & ~f & ~h, "any_rule": ok & (p | f | h | g)}
    return rows.groupBy("layer").agg(F.count("*").alias("raw"), *[F.count_if(c).alias(n) for n, c in counts.items()])


REVIEWED = f"select event_id, status_raw, {STATUS} as status from review"


@query(with_views(f"select event_id, ord, {STATUS} as status, {STATUS} = 'Not_An_Issue' as is_nai, case when trim(lower(comment)) = '' then 'other/no_comment' when contains(lower(comment), 'golf') then 'golf' when regexp_matches(lower(comment), 'beach|sand') then 'beach/sand' when regexp_matches(lower(comment), 'gps|scatter') then 'gps_scatter' when regexp_matches(lower(comment), 'event|marathon|race') then 'event' when contains(lower(comment), 'climb') then 'climbing' else 'other' end as theme from review", "review"))
def status_and_theme(spark, sf_dir):
    s = F.col("status_raw")
    return view(spark, sf_dir, "review").select("event_id", "ord", text.canonical_status(s).alias("status"), text.is_not_an_issue(s).alias("is_nai"), text.comment_theme(F.col("comment")).alias("theme"))


@query(with_views(f"""seen as (select event_id, min(reviewed_at) as first_seen, max(reviewed_at) as last_seen, arg_max(mapper, (reviewed_at, mapper)) as mapper from review where {STATUS} = 'Not_An_Issue' group by event_id)
select cast(event_id as varchar) as candidate_id, first_seen, last_seen, mapper from seen""", "review"))  # fmt: skip
def history_upsert(spark, sf_dir):
    """The reviews of even challenges as what is stored, the others as what a sync finds."""
    rows = view(spark, sf_dir, "review").where(text.is_not_an_issue(F.col("status_raw")))
    seen = rows.select(F.col("event_id").cast("string").alias("candidate_id"), F.col("reviewed_at").alias("first_seen"), F.col("reviewed_at").alias("last_seen"), "mapper", "challenge_id")
    old = labels.nai_upsert(seen.where("challenge_id % 2 = 0").drop("challenge_id"), seen.limit(0).drop("challenge_id"))
    return labels.nai_upsert(old, seen.where("challenge_id % 2 = 1").drop("challenge_id"))


@query("""with new as (select c_custkey as challenge_id, case when c_custkey % 10 = 0 then 'api test ' || c_name else c_name end as name, case when c_custkey % 3 = 0 then null else 'run' end as layer, c_nationkey::bigint as task_count from customer where c_custkey % 4 <> 1),
old as (select c_custkey as challenge_id, 'old ' || c_name as name, 'ride' as layer, 7::bigint as task_count from customer where c_custkey % 3 = 0),
able as (select * from new where challenge_id > 0 and challenge_id <> 99999 and not contains(lower(name), 'api test'))
select challenge_id, coalesce(a.name, o.name) as name, coalesce(a.layer, o.layer) as layer, coalesce(a.task_count, o.task_count) as task_count from old o full join able a using (challenge_id)""")
def registry_merge(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    new = c.where("c_custkey % 4 <> 1").selectExpr("c_custkey as challenge_id", "case when c_custkey % 10 = 0 then 'api test ' || c_name else c_name end as name", "case when c_custkey % 3 = 0 then null else 'run' end as layer", "cast(c_nationkey as bigint) as task_count")
    old = c.where("c_custkey % 3 = 0").selectExpr("c_custkey as challenge_id", "'old ' || c_name as name", "'ride' as layer", "cast(7 as bigint) as task_count")
    return labels.registry_append(old, new)
