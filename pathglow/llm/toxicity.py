"""Toxicity: a learnt lexicon, met with misspellings by Levenshtein automata on its trie, and weighed by context.

Learning. From labelled rows (at most ``fit_rows``, those of the least hash of the id; never the held-out third; of an id
that stands for several texts the least text) words of three letters or more and their stems are counted by document
and class. The lexicon holds all those whose share of toxic documents exceeds the
base rate by more than chance among all candidates allows. All words near the lexicon that clean documents use are noted
as innocent, so lexicon and innocent words are bounded by the words of the ``fit_rows`` documents alone. A term near many of them gets little weight for misspellings, so that ordinary words are not taken for
one. A logistic curve turns a document's mass into a score.

Scoring. Every word runs through the intersection of the lexicon's trie with the Levenshtein automaton of ``EDITS``
edits, made deterministic as it is used; a stem is met by any word of which a beginning lies within these edits of it.
Terms shorter than ``FUZZY_LENGTH`` are met exactly. Each find is weighed by a window of words around it: quotation marks and
reporting verbs make it a quotation, direct address makes it abuse. The weighed finds of a document add up to its mass.

Defined cases: a null or empty text scores as a text without finds; if no row is labelled, or all alike, every score is 0;
texts are scored whole; conflicting labels of an id count as toxic; repeated rows get the same score; rows with a null
id are scored and are not held out; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathglow.llm.common import Memo, held, parts, split_words, text_column, written

FIT_ROWS, LEAST_LETTERS = 10_000, 3
EDITS, FUZZY_LENGTH, EDIT_WEIGHT = 1, 5, 0.6
STEM_LENGTHS, STEM_GAIN, PRECISION, MARGIN = range(4, 10), 1.5, 0.8, -1.0
WINDOW, QUOTED, ADDRESSED = 8, 0.3, 1.5
THRESHOLD = 0.7
EDGES = "".join(map(chr, range(33, 127))).translate({ord(c): None for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}) + "“”„«»‘’…–—¿¡"
#: Marks and words that tell quotation from address.
QUOTES = set('"“”„«»')
REPORTING = {"said", "says", "wrote", "writes", "quoted", "quote", "quotes", "called", "calls", "calling", "dijo", "dit", "sagte", "reported", "cited"}
ADDRESS = {"you", "your", "you're", "youre", "yourself", "u", "ur", "tu", "vous", "du", "dich", "usted"}


def normal(word: str) -> str:
    """Lower case without marks at its ends; what stands inside stays, so that disguised letters count as edits."""
    return word.strip(EDGES).lower()


class LexiconAutomaton:
    """All Levenshtein automata of a lexicon at once: sets of (trie node, edits), made deterministic lazily."""

    DEAD, MOST_STATES = -1, 20_000

    def __init__(self, terms: tuple[tuple[str, bool], ...]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        for number, (term, is_stem) in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            (self.stem_at if is_stem else self.word_at)[node] = number
        self.letters = {c for arcs in self.children for c in arcs}
        self._reset()
        self.memo = Memo(lambda raw: self.find(normal(raw)), 200_000)

    def _reset(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.stem_in: list[tuple[int, int] | None] = []
        self.number: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of the state with these nodes after missing letters have been allowed for."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            if nodes[node] < EDITS:
                for child in self.children[node].values():
                    if nodes.get(child, EDITS + 1) > nodes[node] + 1:
                        nodes[child] = nodes[node] + 1
                        todo.append(child)
        key = tuple(sorted(nodes.items()))
        if not key:
            return self.DEAD
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.stem_in.append(min(((edits, self.stem_at[n]) for n, edits in key if n in self.stem_at and len(self.terms[self.stem_at[n]][0]) >= FUZZY_LENGTH), default=None))
            self.steps.append({})
        return self.number[key]

    def _step(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= EDITS and nodes.get(node, EDITS + 1) > edits:
                nodes[node] = edits

        for node, edits in self.states[state]:
            reach(node, edits + 1)  # a letter too many
            for c, child in self.children[node].items():
                reach(child, edits + (c != letter))
        found = self.steps[state][letter] = self._state(nodes)
        return found

    def find(self, word: str) -> int:
        """0, or 1 + EDITS-ary code of the term met with the fewest edits; a stem that begins the word comes before all."""
        if len(self.states) > self.MOST_STATES:
            self._reset()
        state, node, stem = self.start, 0, None
        for letter in word:
            if node is not None:  # the exact path, on which stems are met
                node = self.children[node].get(letter)
                if node in self.stem_at:
                    return 1 + self.stem_at[node] * (EDITS + 1)
            letter = letter if letter in self.letters else ""
            after = self.steps[state].get(letter)
            state = self._step(state, letter) if after is None else after
            if state == self.DEAD:
                break
            near = self.stem_in[state]
            if near and (stem is None or near < stem):
                stem = near
        whole = () if state == self.DEAD else ((edits, self.word_at[n]) for n, edits in self.states[state] if n in self.word_at and (edits == 0 or len(self.terms[self.word_at[n]][0]) >= FUZZY_LENGTH))
        best = min([*whole, *([stem] if stem else [])], default=None)
        return 0 if best is None else 1 + best[1] * (EDITS + 1) + best[0]


def automaton(terms: tuple[tuple[str, bool], ...]) -> LexiconAutomaton:
    return held("automaton", terms, lambda: LexiconAutomaton(terms))


@dataclass(frozen=True)
class Model:
    """terms: (term, is a stem); weights by term and, for misspellings, edit_weights; innocent: words that only look
    like misspellings; the logistic curve."""

    terms: tuple[tuple[str, bool], ...] = ()
    weights: tuple[float, ...] = ()
    innocent: frozenset[str] = frozenset()
    edit_weights: tuple[float, ...] = ()
    intercept: float = -math.inf
    slope: float = 0.0

    def score(self, mass: np.ndarray) -> np.ndarray:
        if not self.terms:
            return np.full(len(mass), 1 / (1 + math.exp(-self.intercept)) if math.isfinite(self.intercept) else 0.0)
        return 1 / (1 + np.exp(-(self.intercept + self.slope * np.log1p(mass))))


def _context(words: list[str], place: int) -> float:
    """The weight of a find among the words around it."""
    here = words[place]
    before, after = words[:place], words[place + 1 :]
    opened = any(QUOTES & set(w[:1]) for w in [*before, here])
    closed = any(QUOTES & set(w.rstrip(".,!?;:")[-1:]) for w in [here, *after])
    near = {normal(w) for w in words}
    if opened and closed or near & REPORTING and (opened or closed):
        return QUOTED
    return ADDRESSED if near & ADDRESS else 1.0


def masses(texts: pa.Array, model: Model) -> np.ndarray:
    """The weighed finds of each text."""
    mass = np.zeros(len(texts))
    words, counts = split_words(texts)
    if not len(words) or not model.terms:
        return mass
    machine = automaton(model.terms)
    coded = pc.dictionary_encode(words)
    found = np.fromiter(map(machine.memo.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    found = found[coded.indices.to_numpy()]
    ends = np.cumsum(counts)
    hits = np.flatnonzero(found)
    owners = np.searchsorted(ends, hits, side="right")
    for hit, owner in zip(hits.tolist(), owners.tolist(), strict=True):
        term, edits = divmod(int(found[hit]) - 1, EDITS + 1)
        first, last = max(hit - WINDOW, int(ends[owner] - counts[owner])), min(hit + WINDOW + 1, int(ends[owner]))
        around = words.slice(first, last - first).to_pylist()
        if edits and normal(around[hit - first]) in model.innocent:
            continue
        mass[owner] += model.weights[term] * (model.edit_weights[term] if edits else 1.0) * _context(around, hit - first)
    return mass


def _training(docs: DataFrame, labels: DataFrame, fit_rows: int, id_col: str, text_col: str) -> DataFrame:
    """text and toxic of at most ``fit_rows`` labelled documents, none of them held out."""
    known = labels.where("toxic is not null").select(F.col(id_col).alias("id"), "toxic").where(~held_out("id"))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    met = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(written(known, "labelled"), "id")
    return met.groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def _counted(training: DataFrame) -> DataFrame:
    """word, is_stem, toxic, clean, words: in how many documents of each class a word or stem stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for text, toxic in zip(text_column(batch, "text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = {w for w in map(normal, text.split()) if len(w) >= LEAST_LETTERS}
                stems = {w[:k] + "*" for w in words for k in STEM_LENGTHS if len(w) > k}
                counts[bool(toxic)].update(words | stems)
            if sum(map(len, counts)) > 400_000:
                yield from out(counts)
        yield from out(counts)

    def out(counts: list[Counter]) -> Iterator[pa.RecordBatch]:
        for toxic, counter in enumerate(counts):
            if counter:
                n = pa.array(counter.values(), pa.int64())
                none = pa.array(np.zeros(len(counter), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(counter.keys(), pa.string()), n if toxic else none, none if toxic else n], ["word", "toxic", "clean"])
            counter.clear()

    summed = training.mapInArrow(run, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return written(summed, "word-counts")


def _evidence(base: float) -> Column:
    """Documents times the divergence of a word's toxic share from the base rate, in nats."""
    n = F.col("toxic") + F.col("clean")
    share = F.least(F.col("toxic") / n, F.lit(1 - 1e-9))
    return n * (share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base)))


def _lexicon(counted: DataFrame, base: float) -> list[tuple[str, bool, float]]:
    size = counted.count()
    strong = counted.where((F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean"))) & (_evidence(base) >= math.log(size) + MARGIN))
    rows = strong.select("word", "toxic", "clean", _evidence(base).alias("evidence")).orderBy(F.desc("evidence"), "word").collect()  # words of fit_rows documents
    weight = {r["word"]: r["toxic"] / (r["toxic"] + r["clean"]) for r in rows}
    whole = {r["word"]: r["toxic"] for r in rows if not r["word"].endswith("*")}
    stems: list[str] = []
    for word, n in ((r["word"][:-1], r["toxic"]) for r in rows if r["word"].endswith("*")):
        best = max((t for w, t in whole.items() if w.startswith(word)), default=0)
        if n >= STEM_GAIN * best and not any(s.startswith(word) or word.startswith(s) for s in stems):
            stems.append(word)  # it says more than any one word that begins with it
    fuzzy = [s for s in stems if len(s) >= FUZZY_LENGTH]  # words that begin with a shorter stem stay, for their misspellings
    words = [w for w in weight if not w.endswith("*") and not any(w.startswith(s) for s in fuzzy)]
    return [(s, True, weight[s + "*"]) for s in stems] + [(w, False, weight[w]) for w in words]


def _near(counted: DataFrame, terms: tuple[tuple[str, bool], ...]) -> DataFrame:
    """The counts of words that would pass for misspellings, with the number of the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(terms)
        for batch in batches:
            words = batch.column("word").to_pylist()
            term, edits = np.divmod(np.fromiter((0 if w.endswith("*") else machine.find(w) for w in words), np.int64, len(words)) - 1, EDITS + 1)
            near = pa.RecordBatch.from_arrays([*batch.columns, pa.array(term)], ["word", "toxic", "clean", "term"])
            yield near.filter(pa.array((term >= 0) & (edits > 0)))

    return written(counted.mapInArrow(run, "word string, toxic long, clean long, term long"), "near-words")


def _misspelt(near: DataFrame, terms: tuple[tuple[str, bool], ...]) -> tuple[frozenset[str], tuple[float, ...]]:
    """The innocent words, and for each term the weight of its misspellings."""
    used = near.where("clean > toxic").select("word").collect()  # words of fit_rows documents, near a term
    sums = {r["term"]: (r["toxic"], r["clean"]) for r in near.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()}
    shares = [(1 + sums.get(i, (0, 0))[0]) / (1 + sum(sums.get(i, (0, 0)))) for i in range(len(terms))]
    return frozenset(r["word"] for r in used), tuple(EDIT_WEIGHT * s for s in shares)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Intercept and slope by Newton's method."""
    design, beta = np.c_[np.ones(len(x)), x], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - ridge * beta
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(2), gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from ``fit_rows`` labelled documents at most."""
    training = written(_training(docs, labels, fit_rows, id_col, text_col), "training")
    total, toxic = training.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    if not 0 < toxic < total:
        return Model()
    counted = _counted(training)
    chosen = _lexicon(counted, toxic / total)
    terms, weights = tuple((t, s) for t, s, _ in chosen), tuple(w for *_, w in chosen)
    if not terms:
        return Model(intercept=math.log(toxic / (total - toxic)))
    model = Model(terms, weights, *_misspelt(_near(counted, terms), terms))
    seen = training.select(score_of(F.col("text"), model, raw=True).alias("mass"), (F.col("toxic") > 0).cast("double").alias("toxic")).toArrow()  # fit_rows rows at most
    intercept, slope = _logistic(np.log1p(seen["mass"].to_numpy()), seen["toxic"].to_numpy())
    return replace(model, intercept=intercept, slope=slope)


def score_of(text: Column, model: Model, raw: bool = False) -> Column:
    """The score of a text column, or with ``raw`` its mass."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        mass = np.concatenate([np.zeros(0), *(masses(text_column(p, "text"), model) for p in parts(batch, "text"))])
        return pa.array(mass if raw else model.score(mass), pa.float64())

    return run(text)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score and predicted, one row per document."""
    scored = docs.select(id_col, held_out(id_col).alias("held_out"), score_of(F.col(text_col), fit(docs, labels, id_col=id_col, text_col=text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
