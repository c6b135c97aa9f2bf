"""SimHash near-duplicates found by anchor-point covering.

A covering code supplies anchors. The 64 bits of a fingerprint are cut into two blocks of 23 bits, each coded by the
perfect binary Golay code (covering radius 3), and 18 bits that the anchors leave free. A fingerprint's home is the
anchor within the radius in both blocks. It is replicated to every anchor whose distance exceeds the radius by no
more than the threshold, summed over the blocks. If two fingerprints differ in at most ``threshold`` bits, the home
of one is therefore among the replicas of the other: flipping f bits of a block moves it at most f away from an anchor.
So comparing homes with replicas, anchor by anchor, misses no pair.

Defined cases: a null text counts as empty; texts without words get fingerprint zero, which links like any other; equal
fingerprints are one node, so copies are never paired; rows with a null id get a fingerprint and, when their
group has no other row, a null component; repeated rows are returned as often as they occur; an empty table gives
no rows; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathglow.llm.common import drop_held, parts, split_words, text_column, written
from pathglow.llm.components import connected_components

SEED = 42
BLOCK_BITS, RADIUS = 23, 3
#: More ids than these are never broadcast, whatever the size of their file.
MOST_BROADCAST = 1_000_000
#: Fixed value: the generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


def _fingerprints(texts: pa.Array, width: int) -> np.ndarray:
    """Fingerprint of each text as uint64."""
    words, counts = split_words(pc.ascii_lower(texts))
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts > 0)
    if not len(full):
        return out
    grams = np.maximum(counts[full] - width + 1, 1)
    at = np.repeat(starts[full] - (np.cumsum(grams) - grams), grams) + np.arange(grams.sum())
    last = np.repeat(ends[full], grams)
    words = words.cast(pa.large_binary())
    joined = words.take(pa.array(at))
    for k in range(1, width):
        inside = at + k < last
        more = words.take(pa.array(np.where(inside, at + k, 0)))
        longer = pc.binary_join_element_wise(joined, more, pa.scalar(b" ", pa.large_binary()))
        joined = longer if inside.all() else pc.if_else(pa.array(inside), longer, joined)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, SEED) for g in joined.to_pylist()), "<u8", len(joined))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, np.cumsum(grams) - grams, axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * ones > grams[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Columns ``id_col`` and fp (the 64 bits as a signed long), one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            for part in parts(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(_fingerprints(text_column(part, "text"), width).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


@lru_cache
def _tables(threshold: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Syndromes of all 23-bit words, and by excess j the error patterns that reach radius + j, grouped by syndrome."""
    single = []
    for i in range(BLOCK_BITS):
        v = 1 << i
        for k in range(i, 10, -1):
            if v >> k & 1:
                v ^= GOLAY << (k - 11)
        single.append(v)
    syndrome = np.zeros(1 << BLOCK_BITS, np.uint16)
    for i in range(BLOCK_BITS):
        syndrome[1 << i : 2 << i] = syndrome[: 1 << i] ^ single[i]
    levels = []
    for j in range(threshold + 1):
        weights = range(RADIUS + 1) if j == 0 else [RADIUS + j]
        errors = np.array([sum(1 << b for b in c) for w in weights for c in combinations(range(BLOCK_BITS), w)], np.uint32)
        order = np.argsort(syndrome[errors], kind="stable")
        starts = np.searchsorted(syndrome[errors][order], np.arange((1 << 11) + 1))
        levels.append((errors[order], starts))
    return syndrome, levels


def _anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors: all anchors whose excess over the radius sums to ``threshold`` at most."""
    syndrome, levels = _tables(threshold)
    mask = (1 << BLOCK_BITS) - 1
    halves = [(fp & mask).astype(np.uint32), (fp >> BLOCK_BITS & mask).astype(np.uint32)]
    near = []
    for half in halves:
        s = syndrome[half]
        near.append([])
        for errors, starts in levels:
            n = starts[s + 1] - starts[s]
            row = np.repeat(np.arange(len(fp)), n)
            at = np.arange(n.sum()) + np.repeat(starts[s] - (np.cumsum(n) - n), n)
            near[-1].append((n, (half[row] ^ errors[at]).astype(np.int64)))
    rows, anchors = [], []
    for i in range(threshold + 1):
        for j in range(threshold + 1 - i):
            (n, a), (m, b) = near[0][i], near[1][j]
            start_a, start_b = np.cumsum(n) - n, np.cumsum(m) - m
            pairs = n * m
            row = np.repeat(np.arange(len(fp)), pairs)
            k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            rows.append(row)
            anchors.append(a[start_a[row] + k // m[row]] << BLOCK_BITS | b[start_b[row] + k % m[row]])
    return np.concatenate(rows), np.concatenate(anchors)


def _at_anchors(fps: DataFrame, threshold: int, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            row, anchor = _anchors(fp, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row])], ["anchor", name])

    return fps.mapInArrow(run, f"anchor long, {name} long")


def fingerprint_links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) that differ in ``threshold`` bits or fewer, each pair once.

    Both sides are sorted: replicas are dozens a fingerprint, but Spark sizes them by the fingerprints' file, and would broadcast them.
    """
    homes, replicas = _at_anchors(fps, 0, "x"), _at_anchors(fps, threshold, "y")
    near = (F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= threshold)
    return homes.join(replicas.hint("merge"), (homes.anchor == replicas.anchor) & near).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: int) -> DataFrame:
    """``id_col``, fp, root (a fingerprint that stands for the group) and component_id, one row per document.

    None of the joins is a broadcast: all tables have a row a fingerprint, and their compressed size tells little of what they hold.
    """
    prints = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    member = connected_components(fingerprint_links(nodes.select("fp"), threshold))
    rooted = nodes.join(member.hint("merge"), nodes.fp == member.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(least.hint("merge"), "root").select("fp", "root", "component_id"), "named")
    return prints.join(named.hint("merge"), "fp").select(id_col, "fp", "root", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, threshold: int = 2) -> DataFrame:
    """Columns ``id_col``, fingerprint (16 hex digits), component_id (least id reachable over links)."""
    return _grouped(docs, id_col, text_col, width, threshold).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _fingerprint_of(text: Column, width: int) -> Column:
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        found = [_fingerprints(text_column(p, "text"), width) for p in parts(batch, "text")]
        return pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))

    return run(text)


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, threshold: int = 2) -> DataFrame:
    """One row of ``docs`` for each group, one that has the least id; rows with a null id all stay.

    If an id stands for several texts, each of its rows is judged by its own group, so no group is lost; of the rows of a
    group that share the least id one with the least text stays. Only the ids that go or that repeat are joined back, so
    texts are shuffled only if these are too many to be broadcast: by Spark's own limit, or more than ``MOST_BROADCAST``. Shingles of ``width`` words and ``threshold``
    differing bits are by default those of the op9 contract.
    """
    names = iter(f"_{k}" for k in range(len(docs.columns) + 6))
    judged, least, least_fp, root, doc, fp = (next(n for n in names if n not in docs.columns) for _ in range(6))  # no column of docs
    groups = _grouped(docs, id_col, text_col, width, threshold).where(F.col(id_col).isNotNull())
    verdict = groups.groupBy(F.col(id_col).alias(judged)).agg(F.max(F.col(id_col) == F.col("component_id")).alias("stays"), F.count("*").alias("copies"))
    verdict = written(verdict.where("not stays or copies > 1"), "verdicts")
    if verdict.count() > MOST_BROADCAST:
        verdict = verdict.hint("merge")
    once = docs.join(verdict.select(judged), F.col(id_col) == F.col(judged), "left_anti")
    repeated = verdict.where("stays and copies > 1").select(judged)
    if not repeated.head(1):
        return once
    leasts = groups.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(least), F.col("fp").alias(least_fp), F.col("root").alias(root))
    rows = docs.join(repeated, F.col(id_col) == F.col(judged), "left_semi").select(F.struct("*").alias(doc), _fingerprint_of(F.col(text_col), width).alias(fp))
    rows = rows.join(leasts.distinct().hint("merge"), (F.col(f"{doc}.{id_col}") == F.col(least)) & (F.col(fp) == F.col(least_fp)))
    one = F.min_by(doc, F.coalesce(F.col(f"{doc}.{text_col}"), F.lit("")))
    return once.unionByName(rows.groupBy(least, root).agg(one.alias(doc)).select(f"{doc}.*"))
