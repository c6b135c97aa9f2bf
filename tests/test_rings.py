"""Ring assembly over all relations at once against walking them one by one."""

from __future__ import annotations

import random

from pathglow.operators import rings

SCHEMA = "relation_id int, pos long, xs array<double>, ys array<double>"
Line = tuple[int, list[tuple[float, float]]]


def walked(lines: list[Line], first_free: bool) -> list[tuple]:
    """Rings of one relation: ``first_free`` takes the first free member at each point, else ends are paired in order."""
    lines = sorted(lines)
    out = [(pos, len(p), len(p) >= 4, p) for pos, p in lines if p[0] == p[-1]]
    todo = [(pos, p) for pos, p in lines if p[0] != p[-1]]
    at: dict = {}
    for i, (_, p) in enumerate(todo):
        for e in (0, 1):
            at.setdefault(p[-e], []).append((i, e))
    pair = {}
    for ends in at.values():
        for a, b in zip(ends[::2], ends[1::2], strict=False):
            pair[a], pair[b] = b, a
    used: set[int] = set()

    def follow(i: int, way: int) -> list[tuple[int, int]]:
        steps = [(i, way)]
        while True:
            i, way = steps[-1]
            if first_free:
                end = todo[i][1][-1 if way == 0 else 0]
                if end == todo[steps[0][0]][1][0]:
                    return steps
                seen = {j for j, _ in steps}
                then = next(((j, e) for j, e in sorted(at[end]) if j not in used | seen), None)
            else:
                then = pair.get((i, 1 - way))
            if then is None or then == steps[0]:
                return steps
            steps.append(then)

    for i in range(len(todo)):
        if i in used:
            continue
        steps = follow(i, 0)
        if not first_free and pair.get((steps[-1][0], 1 - steps[-1][1])) is None:  # a chain: from its beginning
            back = follow(i, 1)
            steps = [(j, 1 - w) for j, w in reversed(back)] + steps[1:]
        used |= {j for j, _ in steps}
        points: list = []
        for j, w in steps:
            p = todo[j][1][:: -1 if w else 1]
            points += p[1:] if points else p
        out.append((todo[i][0], len(points), len(points) >= 4 and points[0] == points[-1], points))
    return out


def found(spark, relations: dict[int, list[Line]]) -> dict[int, list[tuple]]:
    rows = [(k, pos, [x for x, _ in p], [y for _, y in p]) for k, lines in relations.items() for pos, p in lines]
    random.Random(0).shuffle(rows)
    got: dict = {}
    for r in rings.merge_rings(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect():
        got.setdefault(r["relation_id"], []).append((r["ring"], r["points"], r["closed"], list(zip(r["xs"], r["ys"], strict=True))))
    return {k: sorted(v) for k, v in got.items()}


def test_hundreds_of_random_relations(spark):
    rng = random.Random(7)
    relations = {}
    for k in range(400):
        corners = [(float(rng.randrange(6)), float(rng.randrange(3))) for _ in range(rng.choice([3, 6, 12]))]
        lines = []
        for i in range(rng.randrange(1, 30)):
            middle = [(rng.random(), rng.random()) for _ in range(rng.randrange(3))]
            lines.append((rng.randrange(10_000) * 100 + i, [rng.choice(corners), *middle, rng.choice(corners)]))
        relations[k] = lines
    expected = {k: sorted(walked(lines, False)) for k, lines in relations.items()}
    assert found(spark, relations) == expected
    assert sum(r[2] for rows in expected.values() for r in rows) > 100


def test_rings_that_no_point_joins_are_those_of_the_first_free_member(spark):
    rng = random.Random(8)
    relations = {}
    for k in range(60):
        lines, places = [], rng.sample(range(1000), 200)
        for c in range(rng.randrange(1, 5)):
            ring = [(100.0 * c + i, float(i * i % 7)) for i in range(rng.randrange(4, 12))]
            cuts = sorted(rng.sample(range(len(ring)), rng.randrange(1, 4)))
            turned = ring[cuts[0] :] + ring[: cuts[0]]
            bounds = [c - cuts[0] for c in cuts] + [len(ring)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                piece = (turned + turned[:1])[a : b + 1]
                lines.append((places.pop(), piece[:: rng.choice([1, -1])]))
        relations[k] = lines
    got = found(spark, relations)
    assert got == {k: sorted(walked(lines, True)) for k, lines in relations.items()}
    assert all(r[2] for rows in got.values() for r in rows)


def test_one_relation_of_many_members(spark):
    """A ring of 50,000 members, a third of them turned, and 50,000 more in rings of four; odd rows are left out."""
    rng = random.Random(9)
    n = 50_000
    order = rng.sample(range(n), n)
    rows = [(1, order[i], *([float(i), float((i + 1) % n)][:: rng.choice([1, -1])] for _ in (0,))) for i in range(n)]
    rows = [(k, pos, xs, [0.0, 0.0]) for k, pos, xs in rows]
    rows += [(1, n + i, [float(i // 4 * 4 + i % 4), float(i // 4 * 4 + (i + 1) % 4)], [1.0, 1.0]) for i in range(n)]
    rows += [(1, 3 * n, [0.5], [0.5]), (None, 1, [0.0, 1.0], [0.0, 1.0]), (1, 3 * n + 1, [0.0, None], [0.0, 0.0]), (1, 3 * n + 2, None, None)]
    got = rings.merge_rings(spark.createDataFrame(rows, SCHEMA)).select("relation_id", "ring", "points", "closed", "xs").collect()
    assert len(got) == 1 + n // 4 and all(r["closed"] for r in got)
    large = max(got, key=lambda r: r["points"])
    steps = {(b - a) % n for a, b in zip(large["xs"], large["xs"][1:], strict=False)}
    assert large["points"] == n + 1 and large["ring"] == 0 and steps in ({1}, {n - 1})
    assert {r["points"] for r in got if r is not large} == {5}


def test_nothing_to_assemble(spark):
    assert rings.merge_rings(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, 5, [0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 0.0])], SCHEMA)
    assert [r[:4] for r in rings.merge_rings(one).collect()] == [(1, 5, 4, True)]
