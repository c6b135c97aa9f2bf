"""SimHash and embedding near-duplicates, and components, against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from pathglow.llm import embedding_dedup, simhash
from pathglow.llm.common import table
from pathglow.llm.components import _star, connected_components
from pathglow.llm.embedding_dedup import embedding_components
from pathglow.llm.simhash import _anchors, fingerprint_links, keep_one_of_each_group, simhash_components


class Groups(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


@pytest.mark.parametrize("seed", range(3))
def test_components_like_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [tuple(e) for e in rng.integers(0, 120, (90, 2)).tolist()] + [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(501, 540)] + [(7, 7), (None, 3)]
    groups = Groups()
    for a, b in edges:
        if a is not None and a != b:
            groups.join(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: groups.find(n) for n in groups}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints: dict[int, int]) -> Groups:
    ids, groups = sorted(prints), Groups()
    values = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        groups.find(i)
        for j in np.flatnonzero(np.bitwise_count(values[k] ^ values[k + 1 :]) <= 2):
            groups.join(i, ids[k + 1 + j])
    return groups


def test_fingerprints_and_groups(spark, data):
    docs = table(spark, data, "documents")
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    groups = plain_groups(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_components(docs).collect()}
    assert got == {i: (f"{p:016x}", groups.find(i)) for i, p in prints.items()}
    kept = {r["doc_id"] for r in keep_one_of_each_group(docs).collect()}
    assert kept == {i for i in prints if groups.find(i) == i}


def test_parts_of_a_batch_agree(spark, data):
    from pathglow.llm import simhash

    docs = table(spark, data, "documents").coalesce(1)
    whole = {tuple(r) for r in simhash.fingerprints(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {(i, f & (1 << 64) - 1) for i, f in whole} == {(i, plain_fingerprint(t)) for i, t in texts.items()}


def test_no_near_pair_escapes_the_anchors(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    prints = set(base.tolist())
    for b in base[:40].tolist():
        for bits in rng.choice(64, (12, 3)).tolist():
            value = b
            for bit in bits[: rng.integers(1, 4)]:
                value ^= 1 << bit
            prints.add((value + (1 << 63)) % (1 << 64) - (1 << 63))
    prints = sorted(prints)
    unsigned = np.array(prints, np.int64).view(np.uint64)
    pairs = {(prints[i], prints[j]) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(unsigned[i] ^ unsigned) <= 2).tolist() if prints[i] < prints[j]}
    got = [tuple(r) for r in fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()]
    assert set(got) == pairs and len(got) == len(pairs)


def test_nothing_of_the_groups_is_broadcast(spark, data):
    """Dozens of replicas a fingerprint would be sized by the fingerprints alone, and so gathered in the driver."""
    pairs = spark.range(20).selectExpr("id as a", "id + 1 as b")
    for found in (fingerprint_links(spark.range(5).selectExpr("id as fp")), _star(pairs, large=True), _star(pairs, large=False), simhash_components(table(spark, data, "documents"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_many_ids_are_not_broadcast(spark, data, monkeypatch):
    docs = table(spark, data, "documents")
    whole = sorted(r["doc_id"] for r in keep_one_of_each_group(docs).collect())
    monkeypatch.setattr(simhash, "MOST_BROADCAST", 1)
    found = keep_one_of_each_group(docs)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and sorted(r["doc_id"] for r in found.collect()) == whole


def test_anchors_are_few():
    fp = np.random.default_rng(1).integers(0, 1 << 62, 2000, dtype=np.int64)
    rows, _ = _anchors(fp, 2)
    assert np.bincount(rows).mean() < 80
    assert len(_anchors(fp, 0)[0]) == len(fp)


def test_odd_documents(spark, odd_documents, no_documents):
    rows = simhash_components(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["fingerprint"] == by_id[1]["fingerprint"] == by_id[2]["fingerprint"] == "0" * 16 and by_id[2]["component_id"] == 0
    assert by_id[6]["component_id"] == 5 and by_id[None]["component_id"] is None
    kept = keep_one_of_each_group(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted({r["component_id"] for r in rows}, key=str)
    assert simhash_components(no_documents).count() == keep_one_of_each_group(no_documents).count() == 0


def embeddings(spark, data):
    df = table(spark, data, "embeddings")
    extra = [(90001, None, 1), (90002, [0.0] * 64, 1), (90003, [float("nan")] + [1.0] * 63, 1), (90004, [1.0] * 64, None), (90005, [None] + [1.0] * 63, 2), (90006, [2.0] * 64, 3), (90007, [1.0] * 64, 3), (90008, [1.0] * 8, 3), (90009, [], 3)]
    first = [(90100 + i, r["embedding"], r["label"]) for i, r in enumerate(df.orderBy("vec_id").limit(30).collect())]
    near = [(90200 + i, [x + 0.01 for x in v], label) for i, (_, v, label) in enumerate(first)]
    return df.unionByName(spark.createDataFrame(extra + first + near, df.schema))


@pytest.mark.parametrize("part_rows", [None, 25])
def test_embeddings_like_all_pairs(spark, data, part_rows):
    df = embeddings(spark, data)
    rows = df.collect()
    links, groups = {r["vec_id"]: 0 for r in rows}, Groups({r["vec_id"]: r["vec_id"] for r in rows})
    classes: dict = {}
    for r in rows:
        v = r["embedding"]
        if v and r["label"] is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            classes.setdefault((r["label"], len(v)), []).append((r["vec_id"], np.array(v) / np.linalg.norm(v)))
    for own in classes.values():
        ids, x = [i for i, _ in own], np.array([v for _, v in own])
        for a, b in zip(*np.nonzero(x @ x.T >= 0.93), strict=True):
            if a != b:
                links[ids[a]] += 1
                groups.join(ids[a], ids[b])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_components(df, part_rows=part_rows).collect()}
    assert got == {i: (links[i], groups.find(i), groups.find(i) == i) for i in links}
    assert sum(links.values()) > 0


@pytest.mark.parametrize(("rows", "cell", "sides"), [(500, 256, 1), (1500, 8, 1), (1500, 8, 2), (1500, 100, 2)])
def test_a_tile_like_all_pairs(monkeypatch, rows, cell, sides):
    """Cells of few rows, cosines on both sides of the threshold, a dense group, a looser one, and weights."""
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell)
    rng = np.random.default_rng(rows + cell + sides)
    x, k, centre = rng.normal(size=(rows, 64)), rows // 8, rng.normal(size=64)
    x[:k] = x[k : 2 * k] + rng.normal(size=(k, 64)) * rng.uniform(0.1, 0.45, (k, 1))
    x[2 * k : 4 * k] = centre + rng.normal(size=(2 * k, 64)) * 0.06
    x[4 * k : 5 * k] = centre + rng.normal(size=(k, 64)) * 0.25
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    node, weight = rng.permutation(3 * rows)[:rows].astype(np.int64), rng.integers(1, 4, rows).astype(np.int64)
    side = np.sort(rng.integers(0, sides, rows))
    linked = x @ x.T >= 0.93
    np.fill_diagonal(linked, False)
    if sides == 2:
        linked &= side[:, None] != side[None, :]
    groups = Groups()
    for a, b in zip(*np.nonzero(linked), strict=True):
        groups.join(int(node[a]), int(node[b]))
    got = {a: (b, c) for a, b, c in zip(*(c.tolist() for c in embedding_dedup.tile_links(node, weight, side, x, 0.93)), strict=True)}
    assert got == {n: (int(s), groups.find(n)) for n, s in zip(node.tolist(), (linked * weight).sum(1), strict=True) if s}
    assert len(got) > rows // 4


def test_components_of_any_size(spark):
    """Squares of these components overflow or vanish in double precision."""
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1e200], 1), (3, [2e200, 2.1e200], 1), (4, [1e-200, 1e-200], 1), (5, [-1e200, 1e200], 1), (6, [5e-324, 0.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


def test_embeddings_of_nothing(spark, data):
    assert embedding_components(table(spark, data, "embeddings").limit(0)).count() == 0


def test_dense_group_returns_no_pairs(spark):
    """400 copies that differ a little: every link is counted, but rows stay as many as vectors."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=64)
    rows = [(i, (base + rng.normal(size=64) * 0.02).tolist(), 1) for i in range(400)]
    got = embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), part_rows=150).collect()
    assert len(got) == 400 and {(r["n_links"], r["component_id"]) for r in got} == {(399, 0)}


def test_width_and_threshold_of_the_group_filter(spark):
    rng = np.random.default_rng(3)
    words = rng.choice([f"w{i}" for i in range(500)], 120).tolist()
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:60], "new", *words[61:]])), (3, " ".join(reversed(words)))], "doc_id long, text string")
    for width, threshold in ((3, 0), (5, 2), (1, 2)):
        groups = {r["doc_id"]: r["component_id"] for r in simhash_components(df, width=width, threshold=threshold).collect()}
        kept = {r["doc_id"] for r in keep_one_of_each_group(df, width=width, threshold=threshold).collect()}
        assert kept == {i for i, c in groups.items() if i == c}
        assert (3 in kept) == (width > 1)  # single words do not tell an order from its reverse


def test_no_group_is_lost_when_ids_repeat(spark):
    """An id that stands for several texts is judged text by text."""
    rng = np.random.default_rng(4)
    a, b, c = (" ".join(rng.choice([f"w{i}" for i in range(900)], 80)) for _ in range(3))
    rows = [(7, a, "x"), (7, b, "y"), (7, b, "z"), (9, a, "x"), (3, c, "x"), (7, c, "x"), (None, a, "n"), (12, b, "x"), (5, None, "x"), (5, "", "y")]
    kept = [tuple(r) for r in keep_one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, root string")).collect()]
    assert sorted((i, t) for i, t, _ in kept if i is not None and t) == sorted([(7, a), (7, b), (3, c)])
    assert [i for i, t, _ in kept if not t] == [5] and (None, a, "n") in kept


def test_helper_columns_of_the_group_filter_touch_no_column(spark):
    """Columns named like the filter's own keep their values, where an id stands for several texts as elsewhere."""
    rows = [(1, "a b c d e", 7, 8, "k"), (1, "v w x y z", 9, 10, "l"), (2, "a b c d e", 11, 12, "m"), (3, "q r s t u", 13, 14, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _fp int, _0 int, _least string")
    kept = sorted(map(tuple, keep_one_of_each_group(docs).collect()), key=str)
    assert kept == sorted([rows[0], rows[1], rows[3]], key=str)
