"""Shards cut from a Hilbert curve over several metadata dimensions.

Language and source (by hash) and size (by logarithm) are quantised, rows are sorted by their place on the curve, and the
order is cut into runs of equal row counts. Rows near one another in all dimensions so share files, and a reader that
filters on any of them skips most files. Only ids and metadata are sorted, never texts. Ranks come from a range
partitioning: place within the partition plus the rows of the partitions before, one number a partition.

Defined cases: a null text has size 1 and the checksum of the empty string; null metadata is a value of its own; equal
texts with equal metadata lie side by side; repeated rows are dealt as often as they occur; with fewer rows than shards
some shards stay empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pathglow.llm.common import written

SHARDS, BITS = 16, 8


def hilbert_index(axes: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits``-bit coordinates, by Skilling's transposed form."""
    x = [np.asarray(a, np.int64).copy() for a in axes]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess rotations, from the coarsest bit down
        low = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        fix ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for a in x:
            index = index << 1 | ((a ^ fix) >> bit & 1)
    return index


@F.arrow_udf(LongType())
def _curve(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
    return pa.array(hilbert_index([x.to_numpy(zero_copy_only=False) for x in (a, b, c)]))


def _hashed(column: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("\x00"))), F.lit(1 << BITS))


def _size_and_level(text: Column) -> tuple[Column, Column]:
    size = F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1
    return size, F.least(F.floor(F.log2(size.cast("double")) * 10), F.lit((1 << BITS) - 1)).cast("long")


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``id_col``, size, text_crc32, curve, shard and slot: runs of the curve whose row counts differ by one at most."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, level = _size_and_level(text)
    rows = docs.select(
        F.col(id_col).alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        _hashed(lang_col).alias("a"), _hashed(source_col).alias("b"), level.alias("c"), F.monotonically_increasing_id().alias("row"),
    )
    return _dealt(rows, shards).select(F.col("id").alias(id_col), "size", "text_crc32", "curve", "shard", "slot")


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    """id, size, text_crc32, row, curve, shard and slot of rows (id, size, text_crc32, a, b, c, row)."""
    placed = written(rows.select("id", "size", "text_crc32", "row", _curve("a", "b", "c").alias("curve")), "curve")
    keys = ["curve", "text_crc32", "id", "row"]
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the number restarts in each partition: its upper bits are the partition's
    ordered = ordered.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ordered = written(ordered, "ordered")
    before, offsets = 0, []
    for part, n in sorted(ordered.groupBy("part").count().collect()):  # one row a partition
        offsets.append((part, before))
        before += n
    known = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "part int, before long")
    rank = F.col("before") + F.col("place")
    numbered = ordered.join(F.broadcast(known), "part").withColumn("rank", rank).withColumn("shard", F.expr(f"cast(rank * {shards} div {max(before, 1)} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {before} + {shards - 1}) div {shards}")
    return numbered.select("id", "size", "text_crc32", "row", "curve", "shard", (F.col("rank") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> str:
    """Writes ``docs`` to ``path``, one folder a shard, its rows in the order of the curve; returns the folders' column.

    That column is ``_shard``, with more underscores where ``docs`` has one of that name. The rows are numbered in a
    written copy and dealt by number, so rows that share an id, or are alike, are written as often as they occur.
    """
    numbered = written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    size, level = _size_and_level(F.col(f"doc.{text_col}"))
    rows = numbered.select(
        F.col(f"doc.{id_col}").alias("id"), size.alias("size"), F.crc32(F.coalesce(f"doc.{text_col}", F.lit("")).cast("binary")).alias("text_crc32"),
        _hashed(f"doc.{lang_col}").alias("a"), _hashed(f"doc.{source_col}").alias("b"), level.alias("c"), "row",
    )
    folder = "_shard"
    while folder in docs.columns:
        folder = "_" + folder
    joined = numbered.join(_dealt(rows, shards).select("row", "shard", "slot"), "row").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    joined.select("doc.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
    return folder
