"""Secret scan: known forms of secrets, and random strings told from ordinary ones by character Markov models.

The base finds three forms by pattern. The method adds tokens, maximal stretches of ``CHARACTERS``, of ``LEAST_LENGTH`` or more,
whose characters follow one another as in random strings rather than as in ordinary identifiers and words: the
log-likelihood ratio of two first-order models, summed over the token, reaches ``LEAST_RATIO`` thousandths of a nat.

The labelled samples are the corpus itself. Random are the values that the base has found: the second group of assignments,
access keys and hexadecimal strings whole; a value that two forms find counts twice. Ordinary are all tokens of texts in which the base finds nothing.
Each transition between two characters is counted over all rows, with one added to each cell; sums of whole numbers, so
neither partitioning nor order matters. The counts, two for each pair of characters, are all that the driver sees. Weights
are whole thousandths, so scores do not depend on the order of summation.

A text is scanned once: its base spans and long tokens are written with the counts, and scored from there.

Defined cases: a null text counts as empty and has no spans; places are code points; a token that overlaps a base span is
not added; without any base value the random model knows no pair and so is uniform; repeated rows and null ids are returned as they come; an
empty table gives no rows; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglow.llm.common import drop_held, parts, text_column, written

#: Names before an assigned secret, letters in either case, and the base forms with their least lengths.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
CHARACTERS = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/_=-"
LEAST_LENGTH, LEAST_RATIO = 20, 10_000


def either_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


ASSIGN = "(" + "|".join(map(either_case, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A stretch too short fails, and so does what is left of it: the least length can stand in the pattern.
ACCESS, HEX = f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}", f"[0-9a-f]{{{LEAST_HEX},}}"
TOKEN = r"[A-Za-z0-9+/_=-]"
#: What a text must hold for the patterns to be tried on it.
_MAY = {"assign": "(" + "|".join(map(either_case, NAMES)) + r""")["']?\x20*[:=]""", "access": "AKIA[A-Z0-9]", "hex": f"[0-9a-f]{{{LEAST_HEX}}}", "long": f"{TOKEN}{{{LEAST_LENGTH}}}"}
_ASSIGN, _ACCESS, _HEX, _LONG = (re.compile(p) for p in (ASSIGN, ACCESS, HEX, f"{TOKEN}{{{LEAST_LENGTH},}}"))

_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(CHARACTERS.encode(), np.uint8)] = np.arange(len(CHARACTERS))
SIZE = len(CHARACTERS)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Start, kind, end and value of the base findings, in order; kinds are places in ``KINDS``."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(m.start(), kind, m.end(), m[0]) for kind, form in ((1, _ACCESS), (2, _HEX)) for m in form.finditer(text)]
    return sorted(found)


def transitions(data: np.ndarray) -> np.ndarray:
    """How often each character of ``CHARACTERS`` follows each, in bytes of UTF-8; other bytes part the tokens."""
    code = _CODE[data]
    pairs = code[:-1] * SIZE + code[1:]
    return np.bincount(pairs[(code[:-1] >= 0) & (code[1:] >= 0)], minlength=SIZE * SIZE)


def _bytes(texts: pa.Array) -> np.ndarray:
    """The bytes of all texts with a zero behind each."""
    return np.frombuffer("\0".join(texts.to_pylist()).encode() + b"\0", np.uint8)


def _read(part: pa.RecordBatch, counts: np.ndarray) -> pa.RecordBatch:
    texts = text_column(part, "text")
    may = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in _MAY.items()}
    suspect, long = may["assign"] | may["access"] | may["hex"], may["long"]
    spans: list[list[dict]] = [[] for _ in range(len(texts))]
    tokens: list[list[dict]] = [[] for _ in range(len(texts))]
    values, plain = [], ~suspect
    for i in np.flatnonzero(suspect | long).tolist():
        text = texts[i].as_py()
        base = base_spans(text) if suspect[i] else []
        plain[i] = not base
        spans[i] = [{"kind": k, "start": s, "stop": e} for s, k, e, _ in base]
        values += [v for *_, v in base]
        if long[i]:
            tokens[i] = [{"start": m.start(), "stop": m.end(), "token": m[0]} for m in _LONG.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e, _ in base)]
    counts[0] += transitions(np.frombuffer("\0".join([*values, ""]).encode(), np.uint8))
    counts[1] += transitions(_bytes(texts.filter(pa.array(plain))))
    rows = part.num_rows
    none = [pa.nulls(rows, t) for t in (pa.int32(), pa.int64(), pa.int64())]
    arrays = [part.column("id"), pa.array(spans, pa.list_(_SPAN)), pa.array(tokens, pa.list_(_LONG_TOKEN)), *none]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
_LONG_TOKEN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("token", pa.string())])
_NAMES = ["id", "spans", "tokens", "cell", "random", "ordinary"]
SPANS = "array<struct<kind int, start long, stop long>>"


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One scan: rows of documents with base spans and long tokens, and rows of transition counts, a few thousand a task."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        counts, like = np.zeros((2, SIZE * SIZE), np.int64), None
        for batch in batches:
            like = batch.column("id").type
            for part in parts(batch, "text"):
                yield _read(part, counts)
        cells = np.flatnonzero(counts.any(axis=0))
        if len(cells):
            empty = [pa.nulls(len(cells), t) for t in (like, pa.list_(_SPAN), pa.list_(_LONG_TOKEN))]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(cells, pa.int32()), *(pa.array(c[cells]) for c in counts)], _NAMES)

    return slim.mapInArrow(run, f"id {kind}, spans {SPANS}, tokens array<struct<start long, stop long, token string>>, cell int, random long, ordinary long")


def weights(counts: np.ndarray) -> np.ndarray:
    """Thousandths of the log-likelihood ratio of each transition, from counts (random, ordinary) by pair of characters."""
    r, o = (c.reshape(SIZE, SIZE) for c in counts)
    out = np.zeros((SIZE, SIZE), np.int64)
    for a in range(SIZE):
        for b in range(SIZE):
            random, ordinary = (int(m[a, b]) + 1 for m in (r, o))
            ratio = math.log(random / (int(r[a].sum()) + SIZE)) - math.log(ordinary / (int(o[a].sum()) + SIZE))
            out[a, b] = math.floor(1000 * ratio + 0.5)
    return out


def trained(seen: DataFrame) -> np.ndarray:
    """The weights that the counts of a scan give."""
    counts = np.zeros((2, SIZE * SIZE), np.int64)
    for cell, random, ordinary in seen.where("cell is not null").groupBy("cell").agg(F.sum("random"), F.sum("ordinary")).collect():
        counts[:, cell] = random, ordinary
    return weights(counts)


def score(token: str, model: np.ndarray) -> int:
    code = _CODE[np.frombuffer(token.encode(), np.uint8)]
    return int(model[code[:-1], code[1:]].sum())


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_ratio: int = LEAST_RATIO) -> DataFrame:
    """``id_col``, base and spans: arrays of (kind, start, stop) by start, then kind; kinds are places in ``KINDS``."""
    seen = written(scanned(docs, id_col, text_col), "secret-scan")
    model = trained(seen)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = []
            for base, tokens in zip(batch.column("spans").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                more = [{"kind": 3, "start": t["start"], "stop": t["stop"]} for t in tokens if score(t["token"], model) >= least_ratio]
                every.append(sorted(base + more, key=lambda s: (s["start"], s["kind"])) if more else base)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("spans"), pa.array(every, pa.list_(_SPAN))], ["id", "base", "spans"])

    return seen.where("cell is null").select("id", "spans", "tokens").mapInArrow(run, f"id {kind}, base {SPANS}, spans {SPANS}").withColumnRenamed("id", id_col)
