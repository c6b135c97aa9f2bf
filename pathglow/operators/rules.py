"""Threshold rules over candidates, evaluated for whole grids in one pass.

A rule is a conjunction of clauses (field, comparison, threshold). A grid of hundreds of rules shares a few dozen distinct
clauses, so each row is reduced to the set of clauses that it meets, held as bits, and rows with equal bits and status are
counted together before any rule is looked at. Rules then meet these few counts. The rows are read once and shuffled
as partial sums; their number never multiplies with that of the rules.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAI, FIXED, TOO_HARD, ALREADY_FIXED = "Not_An_Issue", "Fixed", "Too_Hard", "Already_Fixed"
#: Bits in one word of a row's clause set.
WORD_BITS = 62


@dataclass(frozen=True)
class Clause:
    """A comparison that null never meets. op: >=, <=, =, set (present and not blank), is (a true flag), not (no such flag)."""

    field: str
    op: str
    value: float | str | None = None

    def column(self) -> Column:
        c = F.col(self.field)
        met = {
            ">=": lambda: c >= self.value,
            "<=": lambda: c <= self.value,
            "=": lambda: F.lower(F.trim(c)) == self.value,
            "set": lambda: F.trim(c) != "",
            "is": lambda: c,
            "not": lambda: ~F.coalesce(c, F.lit(False)),
        }[self.op]()
        return F.coalesce(met, F.lit(False))

    def sql(self) -> str:
        v = f"'{self.value}'" if isinstance(self.value, str) else f"cast({self.value} as double)"
        met = {">=": f"{self.field} >= {v}", "<=": f"{self.field} <= {v}", "=": f"lower(trim({self.field})) = {v}", "set": f"trim({self.field}) <> ''", "is": self.field, "not": f"not coalesce({self.field}, false)"}[self.op]
        return f"coalesce({met}, false)"


@dataclass(frozen=True)
class Rule:
    name: str
    clauses: tuple[Clause, ...]
    family: str = ""

    @property
    def complexity(self) -> int:
        return self.name.count(" AND ") + 1

    def sql(self) -> str:
        return "(" + " and ".join(c.sql() for c in self.clauses) + ")"


@dataclass(frozen=True)
class Axis:
    """The clauses that one part of a rule's name runs through; ``text`` formats the threshold."""

    text: str
    field: str
    op: str
    values: Sequence[float | str]
    extra: tuple[Clause, ...] = ()

    def steps(self) -> list[tuple[str, tuple[Clause, ...]]]:
        return [(self.text.format(v), (Clause(self.field, self.op, v), *self.extra)) for v in self.values]


def grid(family: str, *axes: Axis) -> list[Rule]:
    """A rule for each choice of one step an axis."""
    return [Rule(" AND ".join(n for n, _ in steps), tuple(c for _, cs in steps for c in cs), family) for steps in product(*(a.steps() for a in axes))]


def meets(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule.clauses))


def _bits(clauses: Iterable[Clause]) -> dict[Clause, tuple[int, int]]:
    return {c: divmod(i, WORD_BITS) for i, c in enumerate(dict.fromkeys(clauses))}


def clause_counts(rows: DataFrame, rules: Sequence[Rule], *keys: str) -> tuple[DataFrame, dict[Clause, tuple[int, int]]]:
    """met (the clauses met, as words of bits), the keys and n, for every combination that occurs."""
    bits = _bits(c for r in rules for c in r.clauses)
    words = []
    for w in range(max(i for i, _ in bits.values()) + 1):
        own = [F.when(c.column(), F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for c, (i, b) in bits.items() if i == w]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), own))
    met = rows.select(*keys, F.array(*words).alias("met"))
    return met.groupBy("met", *keys).agg(F.count("*").alias("n")), bits


def rule_table(spark, rules: Sequence[Rule], bits: dict[Clause, tuple[int, int]]) -> DataFrame:
    size = max(i for i, _ in bits.values()) + 1
    rows = []
    for rule in rules:
        needed = [0] * size
        for c in rule.clauses:
            i, b = bits[c]
            needed[i] |= 1 << b
        rows.append((rule.name, rule.family, rule.complexity, needed))
    return spark.createDataFrame(rows, "rule_name string, family string, complexity int, needed array<bigint>")


def matches(rows: DataFrame, rules: Sequence[Rule], *keys: str) -> DataFrame:
    """A row for each rule and each combination of clauses and keys that meets it, with its count n.

    The rule side is a bounded literal table, broadcast; the other side has been counted before.
    """
    counts, bits = clause_counts(rows, rules, *keys)
    table = rule_table(rows.sparkSession, rules, bits)
    size = max(i for i, _ in bits.values()) + 1
    holds = reduce(lambda a, b: a & b, (F.col("met")[i].bitwiseAND(F.col("needed")[i]) == F.col("needed")[i] for i in range(size)))
    return counts.join(F.broadcast(table), holds)


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")


def _rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 6))


def evaluate(rows: DataFrame, rules: Sequence[Rule], status: str = "status") -> DataFrame:
    """For every rule what it removes by status, and recall, loss and precision (null where nothing is divided by)."""
    s = F.col(status)
    totals = rows.agg(F.count_if(s == NAI).alias("all_nai"), F.count_if(s == FIXED).alias("all_fixed"))
    removed = matches(rows, rules, status).groupBy("rule_name", "family", "complexity").agg(
        F.sum("n").alias("removed_total"), _n(s == NAI).alias("removed_nai"), _n(s == FIXED).alias("removed_fixed"), _n(s == TOO_HARD).alias("removed_too_hard"), _n(s.isNull()).alias("removed_unlabeled"),
    )
    names = rows.sparkSession.createDataFrame([(r.name, r.family, r.complexity) for r in rules], "rule_name string, family string, complexity int")
    zero = ["removed_total", "removed_nai", "removed_fixed", "removed_too_hard", "removed_unlabeled"]
    full = names.join(removed, ["rule_name", "family", "complexity"], "left").fillna(0, zero).crossJoin(F.broadcast(totals))
    nai, fixed = F.col("removed_nai"), F.col("removed_fixed")
    return full.select(
        "rule_name", "family", "complexity", *zero, (nai + fixed + F.col("removed_too_hard")).alias("removed_labeled"),
        _rate(nai, F.col("all_nai")).alias("nai_recall"), _rate(fixed, F.col("all_fixed")).alias("fixed_loss"), _rate(nai, nai + fixed).alias("precision_of_removed"),
    )


def evaluate_on_remaining(rows: DataFrame, rules: Sequence[Rule], suppressed: Column, status: str = "status") -> DataFrame:
    """Rules on the rows that are left, with totals that include what is suppressed already."""
    before = rows.agg(F.count_if(suppressed).alias("was"), F.count_if(suppressed & (F.col(status) == NAI)).alias("was_nai"), F.count_if(suppressed & (F.col(status) == FIXED)).alias("was_fixed"), F.count_if(~suppressed).alias("left"))
    found = evaluate(rows.where(~suppressed), rules, status).crossJoin(F.broadcast(before))
    return found.select(
        "rule_name", "removed_total", "removed_nai", "removed_fixed", "removed_too_hard", (F.col("was") + F.col("removed_total")).alias("total_suppressed"),
        (F.col("left") - F.col("removed_total")).alias("still_left"), (F.col("was_nai") + F.col("removed_nai")).alias("total_nai"), (F.col("was_fixed") + F.col("removed_fixed")).alias("total_fixed"),
    )


def evaluate_by_universe(rows: DataFrame, rules: Sequence[Rule], universe: Column, status: str = "status") -> DataFrame:
    """Removed and retained counts of every status, for each universe that a row belongs to (an array column)."""
    spread = rows.withColumn("universe", F.explode(universe))
    kinds = {"nai": NAI, "fixed": FIXED, "already_fixed": ALREADY_FIXED, "too_hard": TOO_HARD}
    s = F.col(status)
    totals = spread.groupBy("universe").agg(F.count("*").alias("n_universe"), *[F.count_if(s == v).alias(f"all_{k}") for k, v in kinds.items()])
    removed = matches(spread, rules, status, "universe").groupBy("rule_name", "universe").agg(*[_n(s == v).alias(f"removed_{k}") for k, v in kinds.items()])
    names = rows.sparkSession.createDataFrame([(r.name,) for r in rules], "rule_name string")
    full = names.crossJoin(F.broadcast(totals)).join(removed, ["rule_name", "universe"], "left").fillna(0, [f"removed_{k}" for k in kinds])
    return full.select("rule_name", "universe", "n_universe", *[c for k in kinds for c in (F.col(f"removed_{k}"), (F.col(f"all_{k}") - F.col(f"removed_{k}")).alias(f"retained_{k}"))])


def removed_ids(rows: DataFrame, rules: Sequence[Rule], id_col: str, order_col: str, status: str = "status", of: str = FIXED) -> DataFrame:
    """rule_name, ``order_col`` and ``id_col`` of each row of status ``of`` that a rule removes; no rule's ids are gathered."""
    few = rows.where(F.col(status) == of)
    return few.select(F.explode(F.array_compact(F.array(*[F.when(meets(r), F.lit(r.name)) for r in rules]))).alias("rule_name"), order_col, id_col)


def distinct_rules(rows: DataFrame, rules: Sequence[Rule], status: str = "status") -> DataFrame:
    """Of rules that remove the same rows, the simplest: least complexity, then shortest name, then first name.

    Two rules remove the same rows exactly if they match the same combinations of clauses. A set of combinations is told
    by its size and by the sum and the exclusive or of 64-bit hashes, so none is gathered. Rules that remove nothing form
    one group too.
    """
    h = F.xxhash64("met")
    mark = F.struct(F.count("*").alias("size"), F.sum(h.cast("decimal(38,0)")).alias("sum"), F.bit_xor(h).alias("xor"))
    found = matches(rows, rules).groupBy("rule_name", "family", "complexity").agg(mark.alias("key"), F.sum("n").alias("removed_total"))
    names = rows.sparkSession.createDataFrame([(r.name, r.family, r.complexity) for r in rules], "rule_name string, family string, complexity int")
    full = names.join(found, ["rule_name", "family", "complexity"], "left")
    first = Window.partitionBy("key").orderBy("complexity", F.length("rule_name"), "rule_name")
    return full.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("rule_name", "family", "complexity", F.coalesce("removed_total", F.lit(0)).alias("removed_total"))


def pareto(results: DataFrame, gain: str = "removed_nai", cost: str = "removed_fixed") -> DataFrame:
    """Rules that no other rule beats: none gains as much for less, or more for no more. Ties all stay.

    For each gain the least cost is kept, and it must be below that of every higher gain: a running minimum over the few
    distinct gains instead of comparing rules in pairs.
    """
    steps = results.groupBy(gain).agg(F.min(cost).alias("least"))
    higher = Window.orderBy(F.desc(gain)).rowsBetween(Window.unboundedPreceding, -1)
    front = steps.withColumn("above", F.min("least").over(higher)).where("above is null or least < above")
    return results.join(F.broadcast(front.select(gain, F.col("least").alias(cost))), [gain, cost])


def ranked(results: DataFrame, limit: float, top: int | None = None) -> DataFrame:
    """Useful rules that lose at most the share ``limit`` of Fixed, best first, with their rank."""
    able = results.where((F.col("removed_nai") > 0) & (F.col("fixed_loss") <= limit))
    order = Window.orderBy(F.desc("removed_nai"), "removed_fixed", "rule_name")
    out = able.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= top) if top else out


def _listed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Rows with their rank; rules are few."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def safest(results: DataFrame) -> DataFrame:
    """Useful rules that remove neither Fixed nor Too_Hard: those that remove most first, then the simplest."""
    able = results.where("removed_nai > 0 and removed_fixed = 0 and removed_too_hard = 0")
    return _listed(able, F.desc("removed_nai"), "complexity", "rule_name")


def exploratory(results: DataFrame) -> DataFrame:
    """Useful rules that cost exactly one Fixed."""
    return _listed(results.where("removed_nai > 0 and removed_fixed = 1"), F.desc("removed_nai"), "removed_too_hard", "complexity", "rule_name")


def best_of(results: DataFrame, top: int = 10) -> DataFrame:
    """The first ``top`` rules from the frontier, then the careful, bold and safe lists, each rule once."""
    useful = results.where("removed_nai > 0")
    careful = [F.desc("removed_nai"), F.col("removed_fixed"), F.col("rule_name")]
    pools = [
        (pareto(results).where("removed_nai > 0"), [F.desc("removed_nai"), F.col("removed_fixed"), F.desc(F.coalesce("precision_of_removed", F.lit(0.0))), F.col("rule_name")]),
        (useful.where("fixed_loss <= 0.02"), careful),
        (useful.where("fixed_loss <= 0.05"), careful),
        (useful.where("removed_fixed = 0"), [F.desc("removed_nai"), F.desc("removed_total"), F.col("rule_name")]),
    ]
    listed = [p.select("rule_name", F.lit(i).alias("pool"), F.row_number().over(Window.orderBy(*by)).alias("place")) for i, (p, by) in enumerate(pools)]
    every = reduce(DataFrame.unionByName, listed)
    first = every.withColumn("rn", F.row_number().over(Window.partitionBy("rule_name").orderBy("pool", "place"))).where("rn = 1")
    return first.withColumn("rank", F.row_number().over(Window.orderBy("pool", "place"))).where(F.col("rank") <= top).select("rank", "rule_name", "pool")


def leftovers(rows: DataFrame, rules: Sequence[Rule], distance: str, id_col: str, status: str = "status") -> DataFrame:
    """NAI rows that no safe rule catches; a rule is safe if it removes NAI but neither Fixed nor Too_Hard."""
    safe = evaluate(rows, rules, status).where("removed_nai > 0 and removed_fixed = 0 and removed_too_hard = 0").select("rule_name")
    names = [r["rule_name"] for r in safe.collect()]  # bounded by the rules
    own = [r for r in rules if r.name in set(names)]
    caught = reduce(lambda a, b: a | b, map(meets, own), F.lit(False))
    return rows.where((F.col(status) == NAI) & ~caught).select(id_col, distance)
