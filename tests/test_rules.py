from __future__ import annotations

import itertools

from pathglow.operators import rules
from pathglow.operators.rules import Axis, Clause, Rule, grid
from pathglow.plans.rulebook import full_grid, lateral_grid, remaining_grid, second_grid


def test_grid_sizes():
    sizes = [len(f()) for f in (full_grid, remaining_grid, second_grid, lateral_grid)]
    assert sizes == [234, 25, 997, 95]
    for f in (full_grid, remaining_grid, second_grid, lateral_grid):
        assert len({r.name for r in f()}) == len(f())


def rows(spark):
    data = [(i, float(i % 7) if i % 5 else None, float(i % 11), ["Not_An_Issue", "Fixed", None, "Too_Hard"][i * 3 % 4]) for i in range(200)]
    return spark.createDataFrame(data, "id long, a double, b double, status string"), data


RULES = grid("x", Axis("a >= {}", "a", ">=", (1.0, 3.0, 5.0))) + grid("y", Axis("a >= {}", "a", ">=", (1.0, 3.0)), Axis("b <= {}", "b", "<=", (2.0, 6.0)))


def plain(data, rule):
    def met(row, c):
        v = row[1] if c.field == "a" else row[2]
        return v is not None and (v >= c.value if c.op == ">=" else v <= c.value)

    return [r for r in data if all(met(r, c) for c in rule.clauses)]


def test_evaluate_counts_like_a_loop(spark):
    df, data = rows(spark)
    found = {r["rule_name"]: r for r in rules.evaluate(df, RULES).collect()}
    assert len(found) == len(RULES)
    for rule in RULES:
        gone = plain(data, rule)
        r = found[rule.name]
        assert r["removed_total"] == len(gone)
        assert r["removed_nai"] == sum(x[3] == "Not_An_Issue" for x in gone)
        assert r["removed_unlabeled"] == sum(x[3] is None for x in gone)


def test_null_meets_nothing_but_its_negation(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5.0, True)], "id int, a double, f boolean")
    hit = lambda *cs: [r["id"] for r in df.where(rules.meets(Rule("r", cs))).collect()]
    assert hit(Clause("a", ">=", 0.0)) == [2]
    assert hit(Clause("f", "not")) == [1]


def test_pareto_keeps_ties_and_drops_the_beaten(spark):
    data = [("a", 5, 1), ("b", 5, 1), ("c", 4, 1), ("d", 3, 0), ("e", 9, 4), ("f", 9, 5), ("g", 0, 0)]
    df = spark.createDataFrame(data, "rule_name string, removed_nai long, removed_fixed long")
    kept = {r["rule_name"] for r in rules.pareto(df).collect()}
    beaten = {x[0] for x, y in itertools.product(data, data) if y[1] >= x[1] and y[2] <= x[2] and (y[1] > x[1] or y[2] < x[2])}
    assert kept == {x[0] for x in data} - beaten


def test_distinct_rules_keep_the_simplest(spark):
    df, data = rows(spark)
    kept = {r["rule_name"] for r in rules.distinct_rules(df, RULES).collect()}
    groups: dict = {}
    for rule in RULES:
        groups.setdefault(frozenset(x[0] for x in plain(data, rule)), []).append(rule)
    assert kept == {min(g, key=lambda r: (r.complexity, len(r.name), r.name)).name for g in groups.values()}


def test_rules_on_no_rows(spark):
    df = rows(spark)[0].limit(0)
    assert {r["removed_total"] for r in rules.evaluate(df, RULES).collect()} == {0}
    assert rules.distinct_rules(df, RULES).count() == 1
