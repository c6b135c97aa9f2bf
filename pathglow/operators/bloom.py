"""Bloom filters as one-row tables, so that a scan drops most rows that a later exact join would, before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathglow.operators.shared import written

#: Bits for each value, probes of a value, and bits at least and at most: 8 MB, which is what a filter's broadcast may take.
BITS_EACH, PROBES, LEAST_BITS, MOST_BITS = 12, 4, 1 << 10, 1 << 26


def _places(value: Column, bits: int) -> Column:
    """The bits that a value sets: steps of one hash from another (an odd step visits different bits)."""
    first, step = F.xxhash64(value), F.xxhash64(value, F.lit(1)).bitwiseOR(F.lit(1).cast("long"))
    mask = F.lit(bits - 1).cast("long")
    return F.array(*[(F.shiftright(first, 6) + F.lit(i).cast("long") * F.shiftright(step, 8)).bitwiseAND(mask) for i in range(PROBES)])


def bloom_filter(values: DataFrame, column: str, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """One row with the filter's words, and its number of bits, a power of two. Nulls are no values.

    Bits are united by a partial aggregate; the one task that puts the words in order sees at most ``most_bits`` / 64 of them. Beyond ``most_bits``
    the filter lets more pass and stays right.
    """
    n = values.agg(F.approx_count_distinct(column)).first()[0]
    bits = min(most_bits, max(LEAST_BITS, 1 << (BITS_EACH * max(n, 1) - 1).bit_length()))
    at = values.where(F.col(column).isNotNull()).select(F.explode(_places(F.col(column), bits)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    every = values.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    listed = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("w"))
    return written(listed.select(F.transform("w", lambda w: w["bits"]).alias("_words")), "bloom"), bits


def may_hold(rows: DataFrame, column: str, bloom: tuple[DataFrame, int], besides: Column | None = None) -> DataFrame:
    """The rows whose value may be among the filter's, or that ``besides`` keeps. The filter, one row of bounded size, is broadcast."""
    words, bits = bloom
    held = F.lit(True)
    for i in range(PROBES):
        at = _places(F.col(column), bits)[i]
        held = held & (F.expr("0L") != F.get("_words", F.shiftright(at, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))))
    return rows.join(F.broadcast(words), held if besides is None else besides | held).drop("_words")
