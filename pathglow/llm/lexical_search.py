"""Ranked lexical search: the best documents for each query, found by upper bounds from hashed max-sketches.

A term that a document holds has an impact on it, its weight times its dampened frequency, all in whole numbers. A document's
sketch has ``COORDINATES`` of them; a term's hash names its coordinate, and each keeps the greatest impact that falls on
it. The sum of a query's coordinates is no less than the query's score. Documents are taken in blocks: the sketches of a block
answer all queries of a batch, and for each query the documents are rescored exactly in order of falling bounds until
the bound falls below the k-th best score. What is left, k documents a query and block at most, is ranked by Spark.

One scan reads the texts and keeps of each document its length and the counts of those terms that a query of the batch
holds; other terms cannot add to any score, so they are left out of sketches. Document frequencies, the number of documents
and their length are aggregates over all of them. Queries are read one after the other and cut into batches of at most ``BATCH``
queries and ``BATCH_TERMS`` terms; a batch is what the driver and each task hold, whatever the number of queries.

Defined cases: null and empty texts, of documents and queries alike, match nothing; equal scores are ranked by ascending id, null ids
last; repeated documents are ranked as often as they occur, repeated queries answered as often; a query with fewer
documents of a score above 0 gets only those; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathglow.llm.common import drop_held, parts, split_words, text_column, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed values of the score: its scale, and how much a document's length dampens.
SCALE, SATURATION, FLAT, SLOPE = 1_000_000_000, 8, 10, 90
TOP, COORDINATES, BLOCK, BATCH, BATCH_TERMS, RESCORED = 10, 512, 4096, 1024, 200_000, 64

#: ASCII bytes: letters in lower case, digits as they are, all others as blanks.
_FOLD = bytes(i if i > 127 or chr(i) in string.ascii_lowercase + string.digits else i + 32 if chr(i) in string.ascii_uppercase else 32 for i in range(256))


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in one flat array, and the number of terms of each text."""
    _, offsets, data = texts.buffers()
    folded = pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_FOLD)), offset=texts.offset)
    return split_words(folded)


def dampened(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """The frequency part of a term's impact: counts of a term, and the terms of its document."""
    m = 100 - SLOPE + (SLOPE * n * documents) // length
    return (SCALE * tf) // (1000 * tf + SATURATION * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str]) -> DataFrame:
    """id, n, and the numbers and counts of the vocabulary's terms in each document; documents without terms go."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        known = pa.array(vocabulary, pa.large_string())
        for batch in batches:
            for part in parts(batch, "text"):
                flat, counts = terms(text_column(part, "text"))
                number = pc.fill_null(pc.index_in(flat, known), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(counts)), counts)[number >= 0]
                key, tf = np.unique(owner * len(vocabulary) + number[number >= 0], return_counts=True)
                cuts = np.searchsorted(key, np.arange(len(counts) + 1) * len(vocabulary)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v, pa.int32())) for v in (key % max(len(vocabulary), 1), tf)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts), *lists], ["id", "n", "terms", "tf"]).filter(pa.array(counts > 0))

    return slim.mapInArrow(run, f"id {kind}, n long, terms array<int>, tf array<int>")


def coordinate(term: int, coordinates: int) -> int:
    """The place of a term, by its number, in sketches (multiplicative hash)."""
    return ((term * 0x9E3779B1) & 0xFFFFFFFF) * coordinates >> 32


class Block:
    """Documents of a block with their impacts and sketches."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, coordinates: np.ndarray, width: int, documents: int, length: int):
        lists = batch.column("terms")
        self.term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.sizes = sizes
        owner = np.repeat(np.arange(batch.num_rows), sizes)
        tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        self.impact = weights[self.term] * dampened(tf, n[owner], documents, length)
        self.sketch = np.zeros((width, batch.num_rows), np.int64)
        np.maximum.at(self.sketch, (coordinates[self.term], owner), self.impact)
        # documents by id: equal scores are ranked by it
        self.by_id = np.empty(batch.num_rows, np.int64)
        self.by_id[pc.sort_indices(batch.column("id"), null_placement="at_end").to_numpy()] = np.arange(batch.num_rows)

    def scores(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; ``asked`` tells which terms the query holds."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) - np.repeat(ends - sizes - self.first[rows], sizes)
        total = np.r_[0, np.cumsum(self.impact[at] * asked[self.term[at]])]
        return total[ends] - total[ends - sizes]

    def best(self, asked: np.ndarray, places: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``top`` documents with a score of ``floor`` or more, and above 0: places in the block and scores."""
        bounds = self.sketch[places].sum(axis=0)
        able = np.flatnonzero(bounds >= max(floor, 1))
        able = able[np.argsort(-bounds[able], kind="stable")]
        rows, scores, at, chunk = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, RESCORED
        while at < len(able) and (len(rows) < top or bounds[able[at]] >= scores[-1]):
            more = able[at : at + chunk]
            rows, scores = np.r_[rows, more], np.r_[scores, self.scores(more, asked)]
            keep = scores >= max(floor, 1)
            rows, scores = rows[keep], scores[keep]
            order = np.lexsort((self.by_id[rows], -scores))[:top]
            rows, scores, at, chunk = rows[order], scores[order], at + chunk, 2 * chunk
        return rows, scores


def _batches(items: DataFrame, id_col: str, text_col: str, most: int, most_terms: int) -> Iterator[list[tuple[object, list[str]]]]:
    """Queries as (id, distinct terms), in batches of bounded size; those without terms are left out."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    asked = items.select(F.col(id_col).alias("id"), F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("terms")).where("size(terms) > 0")
    now: list[tuple[object, list[str]]] = []
    held = 0
    for r in asked.toLocalIterator():
        if now and (len(now) >= most or held + len(r["terms"]) > most_terms):
            yield now
            now, held = [], 0
        now.append((r["id"], list(r["terms"])))
        held += len(r["terms"])
    if now:
        yield now


def _ranked(docs: DataFrame, queries: list[tuple[object, list[str]]], doc_id: str, text: str, top: int, width: int) -> DataFrame:
    """query (a place in the batch), id and score of the best documents of each query of a batch."""
    kind = docs.schema[doc_id].dataType.simpleString()
    vocabulary = sorted(set(chain.from_iterable(t for _, t in queries)))
    number = dict(zip(vocabulary, range(len(vocabulary)), strict=True))
    held = written(_postings(docs, doc_id, text, vocabulary), "postings")
    documents, length = held.agg(F.count("*"), F.sum("n")).first()
    length = length or 1
    weights = np.full(len(vocabulary), weight(0, documents), np.int64)
    for term, df in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect():  # the batch's terms at most
        weights[term] = weight(df, documents)
    places = np.array([coordinate(t, width) for t in range(len(vocabulary))], np.int64)
    lists = [np.array(sorted(map(number.__getitem__, t)), np.int64) for _, t in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        floors, asked = [0] * len(lists), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(a, BLOCK)
                block, out = Block(rows, weights, places, width, documents, length), []
                for i, mine in enumerate(lists):
                    asked[mine] = 1
                    found, scores = block.best(asked, places[mine], top, floors[i])
                    asked[mine] = 0
                    if len(scores) >= top:
                        floors[i] = max(floors[i], int(scores[-1]))
                    out.append((found, scores))
                at, scores = (np.concatenate(x) for x in zip(*out, strict=True))
                query = np.fromiter(chain.from_iterable(repeat(i, len(f)) for i, (f, _) in enumerate(out)), np.int32, len(at))
                yield pa.RecordBatch.from_arrays([pa.array(query), rows.column("id").take(pa.array(at)), pa.array(scores)], ["query", "id", "score"])

    # documents spread evenly: a task holds a block and the queries, and hands on a few rows a query
    found = held.mapInArrow(run, f"query int, id {kind}, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, width: int = COORDINATES, batch: int = BATCH, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """``item_id``, rank, ``doc_id`` and score: the ``top`` documents of each query with a score above 0, the best first."""
    spark, key = docs.sparkSession, items.schema[item_id].dataType
    out = None
    for queries in _batches(items, item_id, item_text, batch, batch_terms):
        ids = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(queries)], f"query int, item {key.simpleString()}")
        ranked = _ranked(docs, queries, doc_id, doc_text, top, width).join(F.broadcast(ids), "query")
        rows = ranked.select(F.col("item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_id), "score")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.limit(0).select(F.lit(None).cast(key).alias(item_id), F.lit(0).alias("rank"), F.col(doc_id).alias(doc_id), F.lit(0).cast("long").alias("score"))
    return out
