"""Quality rules: base counts and repetition measured with a suffix array over words.

The suffixes of every text are sorted by prefix doubling, many texts at once, in NumPy. Neighbours in the sorted order
give the longest-common-prefix intervals; their occurrences are the maximal repeated substrings. The union of the
spans of those with ``min_repeat`` words or more gives the covered fraction, the deepest interval the longest repeat. A
text is rejected if it fails the base rules, if repeats cover too much of it, or if one repeat is too long.

Defined cases: a null text has no words and fails the base rules; a text is measured whole whatever its length; repeats
may overlap themselves, as in "a a a a"; repeated rows and null ids are returned as they come; an empty table gives
no rows; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from pathglow.llm.common import drop_held, parts, split_words, text_column

SPACES, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: Repeats of fewer words don't count as repeated passages.
MIN_REPEAT = 8
MAX_COVERED, MAX_LONGEST = 0.4, 100
COLUMNS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "covered_words": pa.int64(), "longest_repeat": pa.int64(),
}


def longest_shared_prefixes(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For the suffix at each word, the words that it shares at its start with another suffix of its text.

    ``codes`` holds the words of all texts one after the other, ``counts`` how many each has.
    """
    n = len(codes)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    end = np.repeat(np.cumsum(counts), counts)
    key = np.repeat(np.arange(len(counts)), counts) * (int(codes.max()) + 1) + codes
    sa = np.argsort(key, kind="stable")
    first = np.r_[True, key[sa[1:]] != key[sa[:-1]]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, step = [(1, rank.copy())], 1
    tied = np.flatnonzero(~first | np.r_[~first[1:], False])
    tied_first = rank[sa]  # head of the group at each place of the order
    while len(tied):
        at = sa[tied]
        then = np.where(at + step < end[at], rank[np.minimum(at + step, n - 1)], -1)
        key = rank[at] * (n + 1) + then + 1
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[tied] = at
        first = np.r_[True, key[1:] != key[:-1]]
        heads = np.maximum.accumulate(np.where(first, tied, 0))
        rank[at] = tied_first[tied] = heads
        step *= 2
        levels.append((step, rank.copy()))
        tied = tied[~first | np.r_[~first[1:], False]]
    level = levels[0][1]
    place = np.flatnonzero(level[sa[1:]] == level[sa[:-1]])
    i, j = sa[place], sa[place + 1]
    shared = np.zeros(len(place), np.int64)
    for step, level in reversed(levels):
        a, b = i + shared, j + shared
        inside = (a < end[i]) & (b < end[j])
        shared += step * (inside & (level[np.where(inside, a, 0)] == level[np.where(inside, b, 0)]))
    np.maximum.at(best, i, shared)
    np.maximum.at(best, j, shared)
    return best


def _covered(starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Words in the union of spans, by text."""
    edge = np.zeros(len(owner) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=texts)


def _measures(texts: pa.Array) -> list[pa.Array]:
    words, counts = split_words(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    codes = pc.dictionary_encode(words).indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    shared = longest_shared_prefixes(codes, counts)
    windows = np.flatnonzero(shared >= WINDOW)
    repeats = np.flatnonzero(shared >= MIN_REPEAT)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, owner, shared)
    plain = texts.to_pylist()
    lines = [[line for line in t.split("\n") if line.strip(SPACES)] for t in plain]
    columns = [
        counts,
        [len(t) - sum(map(t.count, SPACES)) for t in plain],
        [sum(map(t.count, SYMBOLS)) for t in plain],
        [len(x) - len(set(x)) for x in lines],
        _covered(windows, np.full(len(windows), WINDOW), owner, len(texts)),
        _covered(repeats, shared[repeats], owner, len(texts)),
        longest,
    ]
    return [pa.array(c, t) for c, t in zip(columns, COLUMNS.values(), strict=True)]


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the measures: base counts, covered_words and longest_repeat. One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            for part in parts(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), *_measures(text_column(part, "text"))], ["id", *COLUMNS])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in COLUMNS)).withColumnRenamed("id", id_col)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The measures with base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    repeats = (F.col("covered_words") > max_covered * F.col("n_words")) | (F.col("longest_repeat") > max_longest)
    return repetition(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~repeats)


def _kept(text: Column, max_covered: float, max_longest: int) -> Column:
    @F.arrow_udf(BooleanType())
    def run(texts: pa.Array) -> pa.Array:
        drop_held()
        batch, out = pa.RecordBatch.from_arrays([texts], ["text"]), [np.zeros(0, bool)]
        for part in parts(batch, "text"):
            n, _, _, _, n_repeat, covered, longest = (c.to_numpy() for c in _measures(text_column(part, "text")))
            failed = (n < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n)
            out.append(~failed & (covered <= max_covered * n) & (longest <= max_longest))
        return pa.array(np.concatenate(out))

    return run(text)


def keep_good(docs: DataFrame, text_col: str = "text", max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of ``docs``, all their columns, that ``quality_verdicts`` keeps."""
    return docs.where(_kept(F.col(text_col), max_covered, max_longest))
