"""The rule grids, as axes of thresholds."""

from __future__ import annotations

from pathglow.operators.rules import Axis, Clause, Rule, grid

#: Thresholds and names of the rule grids.
SHARES = (0.50, 0.75, 0.80, 0.90, 0.95)
FOLLOW = (0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
PARALLEL30, PARALLEL15 = (0.60, 0.70, 0.80, 0.90, 0.95), (0.50, 0.60, 0.70, 0.80, 0.90)
MASKS = (40, 45, 50, 60, 75)
FERRY = Clause("ferry_id", "set")
CONSTRUCTION = Clause("constr_id", "set")


def share(label: str, values, field: str | None = None) -> Axis:
    return Axis(label + " >= {:.2f}", field or label, ">=", values)


def most(label: str, field: str, values, text: str = "{}", extra: tuple[Clause, ...] = ()) -> Axis:
    return Axis(f"{label} <= {text}", field, "<=", values, extra)


def least(label: str, field: str, values, text: str = "{}") -> Axis:
    return Axis(f"{label} >= {text}", field, ">=", values)


TUNNEL = Axis("tunnel=yes", "tunnel", "=", ["yes"])
ANY_TUNNEL = Axis("tunnel=*", "tunnel", "set", [None])


def full_grid() -> list[Rule]:
    """234 rules over all accepted candidates."""
    out: list[Rule] = []
    for label, values in (("follow50", SHARES), ("follow75", SHARES), ("follow100", SHARES[2:])):
        out += grid("follow", share(label, values))
    for label in ("follow50", "follow75", "follow100"):
        out += grid("follow", share(label, FOLLOW), share("parallel30", PARALLEL30)) + grid("follow", share(label, FOLLOW), share("parallel15", PARALLEL15))
    out += grid("distance", most("osm_distance_p90_m", "p90", (40, 45, 50, 60, 75, 100)))
    out += grid("distance", most("p90", "p90", (50, 60, 75)), share("parallel30", [0.80]))
    out += grid("shape", share("follow75", [0.80]), share("parallel30", [0.80]), least("elongation", "elongation", (2, 3, 5)))
    out += grid("shape", share("follow75", [0.90]), share("parallel30", [0.80]), least("elongation", "elongation", [2]))
    out += grid("ferry", most("ferry", "ferry_dist", (50, 75, 100, 150, 200, 250, 500), "{} (nearest_ferry_* populated)", (FERRY,)))
    out += grid("ferry", most("ferry", "ferry_dist", (100, 150, 200), extra=(FERRY,)), share("follow100", [0.80]))
    out += grid("construction", most("construction", "constr_dist", (35, 50, 75, 100), "{} (nearest_construction_* populated)", (CONSTRUCTION,)))
    out += grid("tunnel", TUNNEL, most("p90", "p90", (50, 75, 100))) + grid("tunnel", TUNNEL, share("follow75", [0.80]))
    for metric, field in (("p90", "p90"), ("max", "pmax")):
        out += grid("mask", Axis(f"APPROX mask ~{{0}}m via component {metric} <= {{0}} (NOT an exact detector rerun)", field, "<=", MASKS))
    return out


def remaining_grid() -> list[Rule]:
    """25 rules over what is left after the first suppression."""
    out = grid("ferry", most("ferry", "ferry_dist", (75, 100, 150, 200, 250, 500)))
    out += grid("tunnel", TUNNEL, most("p90", "p90", (50, 75, 100))) + grid("tunnel", TUNNEL, share("follow75", [0.80]))
    out += [Rule("tunnel=yes regardless of distance", (Clause("tunnel", "=", "yes"),), "tunnel")]
    out += grid("construction", most("construction", "constr_dist", (35, 50, 75, 100)))
    for follow, f, parallel, p in (("follow100", 0.70, "parallel15", (0.65, 0.60)), ("follow100", 0.80, "parallel15", [0.65]), ("follow100", 0.90, "parallel15", [0.65]), ("follow100", 0.80, "parallel30", [0.90]), ("follow100", 0.90, "parallel30", [0.90]), ("follow75", 0.90, "parallel30", [0.90])):
        out += grid("near_parallel", share(follow, [f]), share(parallel, p))
    return out + grid("close", most("p90", "p90", [40])) + grid("close", most("nearest_osm_distance_m", "peak_dist", (40, 45)))


def second_grid() -> list[Rule]:
    """997 rules over what is left after the second suppression."""
    out = grid("construction", most("construction", "constr_dist", (35, 50, 75, 100, 150)))
    out += [Rule("nearest tags highway=construction", (Clause("highway", "=", "construction"),), "construction"), Rule("nearest tags construction=*", (Clause("construction", "set"),), "construction"), Rule("nearest tags construction=yes", (Clause("construction", "=", "yes"),), "construction")]
    out += grid("tunnel", TUNNEL) + grid("tunnel", ANY_TUNNEL) + grid("tunnel", ANY_TUNNEL, most("p90", "p90", (50, 75, 100, 125, 150)))
    for label in ("follow100", "follow75"):
        out += grid("tunnel", ANY_TUNNEL, share(label, (0.50, 0.70, 0.90)))
    out += grid("close_peak", most("nearest_osm_distance_m", "peak_dist", (36, 37, 38, 39, 40, 42, 45, 50, 60)))
    out += grid("close_p90", most("osm_distance_p90_m", "p90", (36, 38, 40, 42, 45, 50, 60)))
    follow, p15, p30 = share("follow100", (0.70, 0.80, 0.90, 0.95)), share("parallel15", (0.40, 0.50, 0.55, 0.60, 0.65)), share("parallel30", (0.70, 0.80, 0.90, 0.95))
    spread, long = (2, 3, 5, 7.5, 10, 15), (2, 3, 5, 10, 20)
    iqr, elong, peak = most("iqr", "iqr", spread), least("elong", "elongation", long), most("peak", "peak_dist", (40, 45, 50, 60))
    families = [[follow], [p15], [p30], [most("osm_distance_iqr_m", "iqr", spread)], [least("component_elongation", "elongation", long)]]
    families += [[follow, p15], [follow, p30], [follow, p15, iqr], [follow, p15, elong], [follow, p15, iqr, elong], [follow, p15, peak]]
    return out + [r for axes in families for r in grid("near_parallel", *axes)]


def lateral_grid() -> list[Rule]:
    """95 rules on heat beside the path: 23 single ones, 36 combinations, and these where no parallel way is known."""
    out = [Rule("EXISTING follow100>=0.70 AND parallel15>=0.70", (Clause("follow100", ">=", 0.70), Clause("parallel15", ">=", 0.70)), "existing")]
    out += grid("ratio", least("heat_ratio_p90", "ratio_p90", (1.25, 1.5, 2.0, 2.5, 3.0, 4.0), "{:g}"))
    for label, field, values in (("cover250", "cover250", (0.50, 0.70, 0.80, 0.90)), ("cover150", "cover150", [0.70]), ("cover200", "cover200", [0.80]), ("cover250@30deg", "cover250_30", [0.70])):
        out += grid("cover", least(label, field, values, "{:g}"))
    out += grid("halo", least("halo_score", "halo", (1.0, 1.5, 2.0), "{:g}")) + grid("halo", least("between_heat_ratio", "between", (0.8, 1.0, 1.2), "{:g}"))
    out += grid("distance", least("parallel_osm_min", "lateral_min", (50, 75, 100), "{} (outside local mask)"))
    ratio, cover = Axis("heat_ratio_p90>={:g}", "ratio_p90", ">=", (1.5, 2.0, 2.5, 3.0)), Axis("cover250>={:g}", "cover250", ">=", (0.50, 0.70, 0.80))
    combined = grid("combined", ratio, cover) + grid("combined", ratio, cover, Axis("min>={}", "lateral_min", ">=", [50])) + grid("combined", ratio, cover, Axis("halo>={}", "halo", ">=", [1.0]))
    return out + combined + [Rule(r.name + " AND NOT existing parallel", (*r.clauses, Clause("existing_parallel", "not")), "incremental") for r in combined]
