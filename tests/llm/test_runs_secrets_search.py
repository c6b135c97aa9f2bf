"""Periodic runs, secret scan and ranked search against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathglow.llm import lexical_search, periodic_runs, queries, secret_scan


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """Start, length and period of every run, by trying all periods."""
    found = []
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            run = words[i : j + p]
            if len(run) >= max(6, 4 * p) and j > i and not any(run[q:] == run[:-q] for q in range(1, p)):
                found.append((i, len(run), p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def tiled_runs(words: list, core: int, low: int) -> list[tuple[int, int, int]]:
    codes, found = np.array(words, np.int64), []
    for lo, hi, seen, until, own, own_to in periodic_runs.tiles(len(words), core, low):
        one = [np.array([v], np.int64) for v in (until - seen, seen, own, own_to)]
        found += [(0, *f[1:]) for f in periodic_runs.solve_tiles(codes[seen:until], *one, lo, hi)]
    return sorted([(s, e - s, p) for _, p, s, e in periodic_runs.merged(found) if e - s >= max(6, 4 * p)], key=lambda r: (r[0], r[2]))


BLOCK = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=14), st.integers(1, 9)).map(lambda b: b[0] * b[1])
WORDS = st.lists(BLOCK, max_size=6).map(lambda bs: [x for b in bs for x in b])


@settings(max_examples=200, deadline=None)
@given(WORDS, st.sampled_from([(10_000, 0), (16, 0), (16, 2), (32, 3), (64, 4)]))
def test_runs_of_any_words_in_any_tiles(words, size):
    assert tiled_runs(words, *size) == plain_runs(words)


@pytest.mark.parametrize("core,low", [(64, 2), (128, 4), (16_384, 11)])
def test_runs_across_many_tiles(core, low):
    rng = random.Random(core)
    words = [rng.randrange(50) for _ in range(300)] + [rng.randrange(3) for _ in range(97)] * 6 + [7] * 400 + [1, 2] * 60 + [rng.randrange(9) for _ in range(200)]
    assert tiled_runs(words, core, low) == plain_runs(words)


def test_z_function():
    rng = random.Random(5)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 25))]
        z = periodic_runs.z_function(s, len(s))
        assert z[1:] == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]


def plain_row(text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = plain_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return runs, hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()


@pytest.mark.parametrize("core,low", [(16_384, 11), (32, 1)])
def test_runs_of_documents(spark, core, low):
    rng = random.Random(3)
    texts = [None, "", " \n", "a", "a b " * 5, "x " * 7, "é\tü " * 40, " ".join(rng.choice("ab") for _ in range(300)), "p q r s t " * 30 + "u v w " * 20]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, "a b " * 5, "again", 2), (None, "z z z z z z", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, row int")
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed_sha256"]) for r in periodic_runs.periodic_runs(docs, core=core, low=low).collect()]
    assert sorted(got, key=str) == sorted(((i, *plain_row(t)) for i, t, *_ in rows), key=str)


def test_runs_of_odd_documents(spark, odd_documents, no_documents):
    rows = periodic_runs.periodic_runs(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[0]["runs"] == [] and by[0]["best"] is None and by[0]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    whole = by[7]["runs"]  # w{i % 997} x{i % 31}: no period below 997 * 31 pairs, of which there are not four
    assert whole == []
    assert periodic_runs.periodic_runs(no_documents).count() == 0
    copies = odd_documents.select("doc_id", "text").where("doc_id = 4").withColumn("text", F.lit("one two " * 20_000))
    best = periodic_runs.periodic_runs(copies).first()["best"]
    assert tuple(best) == (0, 40_000, 2)  # three tiles


def planted(doc_id: int, words: list[str]) -> list[str]:
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_periods_are_planted_as_asked(spark):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice(["a", "é", "cc"]) for _ in range(rng.randrange(40))) for i in range(300)}
    docs = spark.createDataFrame([*texts.items(), (None, "x y")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"] or "").split() for r in queries._with_periods(docs).collect()}
    assert got == {i: planted(i, t.split()) for i, t in texts.items()} | {None: ["x", "y"]}
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in texts) > 10


SECRET = st.text(alphabet=st.sampled_from("passwordTOKENapi_key=:\"' AKIA09afXZ+/.-é\n"), max_size=80)


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 8]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


@settings(max_examples=300, deadline=None)
@given(SECRET)
def test_base_spans_of_any_text(text):
    for t in (text, "é" + text + "api_key='" + text, "token:" + text + "0a" * 17 + text, "AKIA" + text.upper()):
        assert [(secret_scan.KINDS[k], s, e) for s, k, e, _ in secret_scan.base_spans(t)] == plain_spans(t)


def test_secrets_of_documents(spark, odd_documents, no_documents):
    rng = random.Random(2)
    token = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    mixed = string.ascii_letters + string.digits + "+/"
    prose = "the quick_brown handler getUserName renders a configuration_value for each internationalization request "
    texts = [prose * 3 + f" Release 2024-11-28 of MODULE_{i} v1.{i}.0" for i in range(200)] + [f"{prose} password = '{token(40, mixed)}' " for _ in range(400)]
    hidden = [token(rng.randrange(24, 40), mixed) for _ in range(20)]
    texts += [f"é {prose} see {h} for it" for h in hidden] + ["x Token: short, api-key=abcdefgh api_key=" + "ab12" * 8]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = odd_documents.select("doc_id", "text").unionByName(more)
    got = secret_scan.find_secrets(rows).collect()
    assert len(got) == rows.count() and secret_scan.find_secrets(no_documents).count() == 0
    by = {r["doc_id"]: r for r in got}
    for r in rows.collect():
        if r["doc_id"] is not None:
            assert [(secret_scan.KINDS[s["kind"]], s["start"], s["stop"]) for s in by[r["doc_id"]]["base"]] == plain_spans(r["text"] or "")
    # tokens that no form names are found by the model, ordinary identifiers are not
    found = [[(s["start"], s["stop"]) for s in by[700 + i]["spans"] if s["kind"] == 3] for i in range(20)]
    at = len(f"é {prose} see ")
    assert sum(f == [(at, at + len(h))] for f, h in zip(found, hidden, strict=True)) >= 19
    assert not any(s["kind"] == 3 for i in range(600) for s in by[100 + i]["spans"])


def test_secret_models_on_held_out_documents(data):
    """Trained on half of the documents: values of the other half's base findings are told from its long ordinary tokens."""
    texts = [t or "" for t in pq.read_table(f"{data}/documents.parquet", columns=["text"])["text"].to_pylist()] * 1
    counts, values, ordinary = np.zeros((2, secret_scan.SIZE**2), np.int64), [], []
    for i, t in enumerate(texts):
        base = secret_scan.base_spans(t)
        if i % 2:
            secret_scan._read(pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], ["id", "text"]), counts)
        else:
            values += [v for *_, v in base if len(v) >= secret_scan.LEAST_LENGTH]
            ordinary += [] if base else re.findall(r"[A-Za-z0-9+/_=-]{20,}", t)
    rng = random.Random(0)
    values += ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(50)]
    model = secret_scan.weights(counts)
    assert sum(secret_scan.score(v, model) >= secret_scan.LEAST_RATIO for v in values) >= 0.95 * len(values)
    assert sum(secret_scan.score(v, model) >= secret_scan.LEAST_RATIO for v in ordinary) <= 0.02 * len(ordinary)


def plain_search(docs: list[tuple], items: list[tuple], top: int = 10) -> list[tuple]:
    fold = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    terms = lambda t: re.findall(lexical_search.TERM, (t or "").translate(fold))
    held = [(i, w) for i, w in ((i, terms(t)) for i, t in docs) if w]
    total, df = sum(len(w) for _, w in held), {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, w in held:
            m = 100 - 90 + (90 * len(w) * len(held)) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * ((1000000000 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in set(terms(text)) if t in df)
            scored += [(-s, i is None, i, s)] if s > 0 else []
        out += [(item, k + 1, i, s) for k, (_, _, i, s) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("width,batch", [(512, 1024), (2, 3), (1, 1)])
def test_search_like_brute_force(spark, width, batch):
    rng = random.Random(width)
    words = ["Alpha", "BETA", "x1", "é", "漢字", "the", "of", "a", "zeta", "ÑANDÚ", "q"] + [f"w{i}" for i in range(40)]
    docs = [(i, rng.choice(["", " ", ", "]).join([" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))])) for i in range(150)]
    docs += [(None, "alpha the"), (200, None), (201, ""), (202, "--- \n")] + [(300 - i, "same Alpha text of w1 w2") for i in range(40)] + [docs[3], docs[3]]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for i in range(9)] + [(20, None), (21, "!!"), (22, "unseen words"), (23, "alpha-alpha the"), (23, "alpha-alpha the")]
    d = spark.createDataFrame([(*r, 1, "c") for r in docs], "doc_id long, text string, rank int, score string").repartition(5)
    q = spark.createDataFrame([(*r, "c") for r in items], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in lexical_search.search(d, q, width=width, batch=batch).collect()), key=str)
    assert got == plain_search(docs, items)


def test_search_in_small_blocks(spark, monkeypatch):
    """Blocks of a few documents: floors carried from block to block lose nothing, ties included."""
    rows = [(i, f"t{i % 3} same word" + " x" * (i % 4)) for i in range(90)]
    documents, length = len(rows), sum(len(t.split()) for _, t in rows)
    vocabulary = ["same", "t0", "t1", "word", "x"]
    df = [sum(v in t.split() for _, t in rows) for v in vocabulary]
    weights = np.array([lexical_search.weight(n, documents) for n in df], np.int64)
    places = np.array([lexical_search.coordinate(t, 2) for t in range(5)])
    asked, floor, best = np.ones(5, np.int64), 0, []
    for a in range(0, 90, 7):
        part = rows[a : a + 7]
        held = [[(vocabulary.index(w), t.split().count(w)) for w in sorted(set(t.split())) if w in vocabulary] for _, t in part]
        lists = [pa.array([[x[k] for x in h] for h in held], pa.list_(pa.int32())) for k in (0, 1)]
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in part]), pa.array([len(t.split()) for _, t in part]), *lists], ["id", "n", "terms", "tf"])
        block = lexical_search.Block(batch, weights, places, 2, documents, length)
        found, scores = block.best(asked, places, 10, floor)
        assert (block.sketch[places].sum(axis=0)[found] >= scores).all()
        best = sorted([*best, *((-int(s), part[int(f)][0]) for f, s in zip(found, scores, strict=True))])[:10]
        floor = -best[-1][0] if len(best) == 10 else 0
    items = [(0, " ".join(vocabulary))]
    assert [(i, -s) for s, i in best] == [(i, s) for _, _, i, s in sorted(plain_search(rows, items), key=lambda r: r[1])]


def test_search_of_odd_documents(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "same text nine words w5 x7")], "item_id long, text string")
    got = lexical_search.search(odd_documents, items).collect()
    assert got and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert lexical_search.search(no_documents, items).count() == lexical_search.search(odd_documents, items.limit(0)).count() == 0
    assert lexical_search.search(no_documents, items).columns == lexical_search.search(odd_documents, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
