"""Quality rules, licence scan and toxicity against plain versions."""

from __future__ import annotations

import math
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import duck_rows, spark_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from pathglow.llm import license_scan, quality_rules, queries, toxicity
from pathglow.llm.common import table
from pathglow.llm.quality_rules import MIN_REPEAT, WINDOW


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    columns, expected = duck_rows(queries.ORACLES[name], data)
    assert sorted(df.columns) == columns
    assert spark_rows(df) == expected


def plain_measures(text: str) -> list[int]:
    w = text.split(" ") if text else []
    n = len(w)
    shared = [0] * n
    for a in range(n):
        for b in range(n):
            if a != b:
                k = 0
                while max(a, b) + k < n and w[a + k] == w[b + k]:
                    k += 1
                shared[a] = max(shared[a], k)
    short = {q for p in range(n) if shared[p] >= WINDOW for q in range(p, p + WINDOW)}
    long = {q for p in range(n) if shared[p] >= MIN_REPEAT for q in range(p, p + shared[p])}
    return [n, len(short), len(long), max(shared, default=0)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=45).map(" ".join), min_size=1, max_size=5))
def test_repetition_of_any_texts(texts):
    m = [c.to_pylist() for c in quality_rules._measures(pa.array(texts, pa.large_string()))]
    for i, t in enumerate(texts):
        assert [m[0][i], m[4][i], m[5][i], m[6][i]] == plain_measures(t)


def test_quality_of_odd_documents(spark, odd_documents, no_documents):
    rows = {r["doc_id"]: r for r in quality_rules.quality_verdicts(odd_documents).collect()}
    assert rows[0]["n_words"] == rows[1]["n_words"] == rows[2]["n_words"] == 0 and rows[0]["base_failed"] and not rows[0]["kept"]
    assert rows[10]["n_dup_lines"] == 2 and rows[7]["n_words"] == 60_000
    assert quality_rules.quality_verdicts(odd_documents).count() == odd_documents.count()
    kept = quality_rules.keep_good(odd_documents)
    assert kept.columns == odd_documents.columns
    judged = quality_rules.quality_verdicts(odd_documents).where("kept").select("doc_id").collect()
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r["doc_id"] for r in judged), key=str)
    assert quality_rules.quality_verdicts(no_documents).count() == quality_rules.keep_good(no_documents).count() == 0


def test_long_repeats_are_rejected(spark):
    once = " ".join(f"w{i}" for i in range(400))
    passage = " ".join(f"p{i}" for i in range(120))
    docs = spark.createDataFrame([(1, once), (2, once + " " + passage + " x " + passage), (3, once + "\n" + once)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in quality_rules.quality_verdicts(docs).collect()}
    assert [rows[i]["kept"] for i in (1, 2, 3)] == [True, False, False]
    assert rows[2]["longest_repeat"] == 120 and not rows[2]["base_failed"] and rows[3]["covered_words"] == 800


def plain_licences(text: str | None) -> tuple:
    low = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    w = re.findall(license_scan.WORD, low)
    places, base, extra = [], set(), {}
    for phrase, label in license_scan.PHRASES.items():
        parts = phrase.split()
        hits = [i for i in range(len(w) - len(parts) + 1) if w[i : i + len(parts)] == parts]
        places += hits
        base |= {label} if hits else set()
    for label, template, window in license_scan.templates():
        t, half = set(template), window // 2
        for start in range(0, max(len(w) - half, 0) + 1, half):
            block = set(w[start : start + window])
            if len(block & t) >= license_scan.CONTAINMENT * len(t) - 1e-9:
                extra[label] = max(extra.get(label, 0), len(block & t) / len(t))
    score = 1.0 if places else max(extra.values(), default=0.0)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(extra))), score


def test_licences_of_odd_documents(spark, odd_documents, no_documents):
    texts = ["Cc-By cc by. ALL rights, reserved", "x " * 40 + license_scan.TEMPLATES[3][1] + " y" * 9, "released under the license", "Released under the MIT License!", "cc", license_scan.TEMPLATES[4][1].replace("binary", "any")]
    whole = [t for _, t in license_scan.TEMPLATES if len(t.split()) > 60]
    texts += ["intro words " * 70 + t.upper() + " and more" * 300 for t in whole] + [" ".join(w for i, w in enumerate(t.split()) if i % 3) for t in whole[:2]]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = odd_documents.select("doc_id", "text").unionByName(extra)
    got = sorted((tuple(r) for r in license_scan.license_scan(rows).collect()), key=str)
    assert got == sorted(((r["doc_id"], *plain_licences(r["text"])) for r in rows.collect()), key=str)
    assert license_scan.license_scan(no_documents).count() == 0
    assert any("mit" in r[6] for r in got)
    assert {label for label, t in license_scan.TEMPLATES if t in whole} <= {x for r in got if r[0] is not None and r[0] >= 106 for x in r[6].split(",")}
    for _, template, window in license_scan.templates():
        assert len(template) <= window // 2


def test_licence_scan_uses_no_python(spark, data, capsys):
    license_scan.license_scan(table(spark, data, "documents")).explain()
    assert "Python" not in capsys.readouterr().out


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


TERMS = (("loser", False), ("idiot", False), ("bad", False), ("worthless", False), ("stem", True), ("lose", False))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="abdeilmorstw", max_size=9), st.sampled_from([t for t, _ in TERMS]).flatmap(lambda t: st.tuples(st.just(t), st.integers(0, len(t)), st.sampled_from(["", "a", "lo"])).map(lambda x: x[0][: x[1]] + x[2] + x[0][x[1] + 1 :]))))
def test_automaton_like_distances(word):
    machine = toxicity.LexiconAutomaton(TERMS)
    best = min(((distance(word, t), i) for i, (t, stem) in enumerate(TERMS) if not stem and distance(word, t) <= (toxicity.EDITS if len(t) >= toxicity.FUZZY_LENGTH else 0)), default=None)
    code = machine.find(word)
    if word.startswith("stem"):
        assert divmod(code - 1, toxicity.EDITS + 1) == (4, 0)
    elif best is None:
        assert code == 0
    else:
        assert divmod(code - 1, toxicity.EDITS + 1) == (best[1], best[0])


STEMS = (("achlic", True), ("stem", True), ("stemming", False), ("grubb", True), ("grabs", False), ("loser", False))


@settings(max_examples=400, deadline=None)
@given(st.tuples(st.sampled_from([t for t, _ in STEMS]), st.integers(0, 8), st.sampled_from(["", "a", "1", "lo"]), st.sampled_from(["", "her", "ing", "b"])).map(lambda x: x[0][: x[1]] + x[2] + x[0][x[1] + 1 :] + x[3]))
def test_automaton_meets_misspelt_stems_like_distances(word):
    exact = [(len(t), i) for i, (t, stem) in enumerate(STEMS) if stem and word.startswith(t)]
    near = [(min(distance(word[:k], t) for k in range(len(word) + 1)) if stem else distance(word, t), i) for i, (t, stem) in enumerate(STEMS)]
    best = (0, min(exact)[1]) if exact else min(((d, i) for d, i in near if d <= (toxicity.EDITS if len(STEMS[i][0]) >= toxicity.FUZZY_LENGTH else 0)), default=None)
    assert toxicity.LexiconAutomaton(STEMS).find(word) == (0 if best is None else 1 + best[1] * (toxicity.EDITS + 1) + best[0])


def test_misspelt_stem_adds_to_the_mass():
    learnt = toxicity.Model(STEMS, (1.0,) * len(STEMS), frozenset({"achtlicht"}), (0.5,) * len(STEMS), -3.0, 5.0)
    exact, misspelt, innocent = toxicity.masses(pa.array(["an achlicher one", "an achl1cher one", "an achtlicht one"], pa.large_string()), learnt).tolist()
    assert 0 < misspelt < exact and innocent == 0


def model(**more) -> toxicity.Model:
    return toxicity.Model(TERMS, (1.0,) * len(TERMS), frozenset({"closer"}), (0.5,) * len(TERMS), -3.0, 5.0, **more)


def test_context_and_spelling():
    texts = ["he is a loser today", 'he said "loser" to them', "you are a loser", "a l0ser walked in", "it came closer", "", "nothing here"]
    plain, quoted, addressed, misspelt, innocent, empty, none = toxicity.masses(pa.array(texts, pa.large_string()), model()).tolist()
    assert quoted < plain < addressed and 0 < misspelt < plain and innocent == empty == none == 0


def test_learns_and_holds_out(spark):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        own = rng.choice(words, 40).tolist() + (rng.choice(["vileness", "grubbity", "mokester"], 3).tolist() if toxic else [])
        rng.shuffle(own)
        docs.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(df, known).collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    unseen = [i for i, r in got.items() if r["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in unseen]) > 0.97
    flipped = spark.createDataFrame([(i, 1 - t if got[i]["held_out"] else t) for i, t in labels], "doc_id long, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(df, flipped).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-12 for i, r in got.items())  # held-out labels are never read


def test_toxicity_of_odd_documents(spark, odd_documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(odd_documents, none).collect()
    assert len(rows) == odd_documents.count() and {r["score"] for r in rows} == {0.0} and {r["predicted"] for r in rows} == {0}
    few = spark.createDataFrame([(3, 1, 1), (3, 1, 0), (4, 1, 0), (5, None, None), (None, 1, 1)], none.schema)
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity_scores(odd_documents, few).collect())
    assert toxicity.toxicity_scores(no_documents, few).count() == 0


def plain_find(word: str, terms) -> tuple[int, int] | None:
    """Edits and number of the term that a normal word meets, by plain distances."""
    exact = [(len(t), i) for i, (t, stem) in enumerate(terms) if stem and word.startswith(t)]
    if exact:
        return 0, min(exact)[1]
    best = []
    for i, (t, stem) in enumerate(terms):
        most = toxicity.EDITS if len(t) >= toxicity.FUZZY_LENGTH else 0
        ends = range(max(0, len(t) - toxicity.EDITS), min(len(word), len(t) + toxicity.EDITS) + 1) if stem else [len(word)]
        d = min((distance(word[:k], t) for k in ends if abs(k - len(t)) <= toxicity.EDITS), default=9)
        if d <= most and not (stem and most == 0):
            best.append((d, i))
    return min(best, default=None)


def plain_score(text: str | None, learnt: toxicity.Model, memo: dict) -> float:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    mass = 0.0
    for place, raw in enumerate(words):
        word = raw.strip(toxicity.EDGES).lower()
        if word not in memo:
            memo[word] = plain_find(word, learnt.terms)
        if memo[word] is None or memo[word][0] and word in learnt.innocent:
            continue
        edits, term = memo[word]
        before, after = words[max(0, place - toxicity.WINDOW) : place], words[place + 1 : place + 1 + toxicity.WINDOW]
        opened = any(w[0] in toxicity.QUOTES for w in [*before, raw])
        closed = any(w.rstrip(".,!?;:")[-1:] in toxicity.QUOTES for w in [raw, *after] if w.rstrip(".,!?;:"))
        near = {w.strip(toxicity.EDGES).lower() for w in [*before, raw, *after]}
        quoted = opened and closed or bool(near & toxicity.REPORTING) and (opened or closed)
        weight = toxicity.QUOTED if quoted else toxicity.ADDRESSED if near & toxicity.ADDRESS else 1.0
        mass += learnt.weights[term] * (learnt.edit_weights[term] if edits else 1.0) * weight
    return 1 / (1 + math.exp(-(learnt.intercept + learnt.slope * math.log1p(mass))))


def test_scores_like_plain_distances(spark, data):
    """The whole query over a small table, with the terms that it learns there and some that it might have learnt."""
    rng = np.random.default_rng(2)
    bad = ["vileness", "v1leness", "grubbity", "grubbitys", "grubity", "mokester", "mokesters", "\"vileness\"", "Mokester,"]
    made = [(i, " ".join(rng.permutation([*rng.choice([f"word{j}" for j in range(200)], 30), *rng.choice(["you", "said", '"', "closer"], 2), *(rng.choice(bad, 2) if i % 4 == 0 else [])]))) for i in range(600)]
    docs = spark.createDataFrame([*made, (-1, None), (-2, ""), (-3, "vileness mokester you")], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    learnt = toxicity.fit(docs, known)
    assert any(stem for _, stem in learnt.terms) or len(learnt.terms) > 3
    memo: dict = {}
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, known).collect()}
    assert all(abs(got[r["doc_id"]] - plain_score(r["text"], learnt, memo)) < 1e-9 for r in docs.collect()) and len(set(got.values())) > 5
    docs = table(spark, data, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    frequent = sorted({w for t in rows.values() for w in (t or "").lower().split() if w.isalpha() and 5 <= len(w) <= 9})[::400]
    more = tuple((w[:-1] + "q", False) for w in frequent) + tuple((w[:4] + "x", True) for w in frequent[:4])
    other = toxicity.Model(more, (0.9,) * len(more), frozenset(frequent[:3]), (0.4,) * len(more), -2.0, 3.0)
    memo = {}
    scored = {r["doc_id"]: r["score"] for r in docs.select("doc_id", toxicity.score_of(docs["text"], other).alias("score")).collect()}
    assert all(abs(scored[i] - plain_score(t, other, memo)) < 1e-9 for i, t in rows.items()) and len(set(scored.values())) > 2


def plain_fit(texts: list[str], toxic: list[int]) -> tuple[set, dict]:
    """Terms and counts of the lexicon by plain counting: evidence, precision, stems and what they cover."""
    counts: dict[str, list[int]] = {}
    for t, y in zip(texts, toxic, strict=True):
        words = {w for w in map(toxicity.normal, t.split()) if len(w) >= toxicity.LEAST_LETTERS}
        for w in words | {w[:k] + "*" for w in words for k in toxicity.STEM_LENGTHS if len(w) > k}:
            counts.setdefault(w, [0, 0])[y] += 1
    base, strong = sum(toxic) / len(toxic), {}
    for w, (clean, bad) in counts.items():
        n = clean + bad
        share = min(bad / n, 1 - 1e-9)
        evidence = n * ((share * math.log(share / base) if share else 0) + (1 - share) * math.log((1 - share) / (1 - base)))
        if bad >= toxicity.PRECISION * n and evidence >= math.log(len(counts)) + toxicity.MARGIN:
            strong[w] = (evidence, bad, n)
    order = sorted(strong, key=lambda w: (-strong[w][0], w))
    stems: list[str] = []
    for w in order:
        if w.endswith("*"):
            s = w[:-1]
            best = max((strong[x][1] for x in order if not x.endswith("*") and x.startswith(s)), default=0)
            if strong[w][1] >= toxicity.STEM_GAIN * best and not any(x.startswith(s) or s.startswith(x) for x in stems):
                stems.append(s)
    long = [s for s in stems if len(s) >= toxicity.FUZZY_LENGTH]
    words = [w for w in order if not w.endswith("*") and not any(w.startswith(s) for s in long)]
    terms = {(s, True): strong[s + "*"][1] / strong[s + "*"][2] for s in stems} | {(w, False): strong[w][1] / strong[w][2] for w in words}
    near: dict[tuple, list[int]] = {}
    innocent = set()
    for w, (clean, bad) in counts.items():
        if not w.endswith("*"):
            found = toxicity.automaton(tuple(terms)).find(w) - 1
            term, edits = divmod(found, toxicity.EDITS + 1)
            if found >= 0 and edits:
                sums = near.setdefault(list(terms)[term], [0, 0])
                sums[0], sums[1] = sums[0] + clean, sums[1] + bad
                innocent |= {w} if clean > bad else set()
    edit = {t: toxicity.EDIT_WEIGHT * (1 + near.get(t, (0, 0))[1]) / (1 + sum(near.get(t, (0, 0)))) for t in terms}
    return innocent, {t: (terms[t], edit[t]) for t in terms}


def test_the_fit_like_plain_counting(spark):
    """Lexicon, weights, misspellings and innocent words are all that pass the evidence test, however many; then the curve."""
    import random

    rng = random.Random(4)
    bad = ["vileness", "grubbity", "mokester", "slimeling", "slimewort", "slimefoot"] + [f"insult{c}{d}" for c in "abcde" for d in "xyz"]
    good = ["village", "grubbily", "mokesters", "plain", "text", "fine", "slim", "number"] + [f"word{i}" for i in range(60)]
    texts, toxic = [], []
    for i in range(400):
        y = int(i % 4 == 0)
        texts.append(" ".join(rng.choices(good, k=12) + (rng.choices(bad, k=6) + rng.choices(["v1leness", "grubity"], k=1) if y else [])))
        toxic.append(y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    learnt = [i for i in range(400) if not zlib.crc32(str(i).encode()) % 3 == 1]
    innocent, terms = plain_fit([texts[i] for i in learnt], [toxic[i] for i in learnt])
    model = toxicity.fit(docs, labels)
    assert len(terms) >= 8 and set(model.terms) == set(terms) and set(model.innocent) == innocent
    for t, w, e in zip(model.terms, model.weights, model.edit_weights, strict=True):
        assert w == pytest.approx(terms[t][0]) and e == pytest.approx(terms[t][1])
    x = np.log1p(toxicity.masses(pa.array([texts[i] for i in learnt], pa.large_string()), model))
    y = np.array([toxic[i] for i in learnt], float)
    p = 1 / (1 + np.exp(-(model.intercept + model.slope * x)))
    assert abs((y - p).sum() - 0.01 * model.intercept) < 1e-3 and abs((x * (y - p)).sum() - 0.01 * model.slope) < 1e-3  # a root of the gradient


def test_ids_that_repeat_learn_once(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(0, "b"), (0, "a"), (0, "a"), (1, "c"), (1, None)], "doc_id long, text string")
    rows = toxicity._training(docs, labels, 10, "doc_id", "text").collect()
    held = {r["doc_id"] for r in docs.select("doc_id", toxicity.held_out("doc_id").alias("h")).where("h").collect()}
    assert sorted((r["text"], r["toxic"]) for r in rows) == [x for i, x in enumerate([("a", 1), ("c", 0)]) if i not in held]


def test_licences_of_a_very_long_text(spark):
    """A million words with templates at both ends and in the middle: work and memory grow with the words."""
    whole = {label: t for label, t in license_scan.TEMPLATES if len(t.split()) > 100}
    rest = 1_000_000 - sum(len(whole[k].split()) for k in ("mit", "zlib", "bsd"))
    filler = ["words of the software and to any other", "license in use"]
    half = " ".join(filler[i % 2] for i in range(rest // 11))
    docs = spark.createDataFrame([(1, f"{whole['mit']} {half} {whole['zlib']} {half} {whole['bsd']}"), (2, half), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    assert rows[1]["n_words"] > 950_000 and {"mit", "zlib", "bsd"} <= set(rows[1]["labels"].split(",")) and rows[1]["score"] == 1.0
    assert rows[2]["labels"] == "" and rows[3]["n_words"] == 0
