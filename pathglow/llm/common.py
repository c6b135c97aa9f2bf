"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where all run in one process may it be unset and one of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", shared)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return shared


_made: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder."""
    _made.append(f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def removed(spark: SparkSession, *paths: str) -> None:
    """Removes folders made by ``shared_path``; without names, all that this process has made. The DataFrames that read
    them are spent: call it once the results have been written."""
    for path in paths or tuple(_made):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _made.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    return written_at(df, shared_path(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Memo(dict):
    """A dict that computes what it lacks and starts anew when it holds ``most`` entries.

    ``map(memo.__getitem__, keys)`` stays in C for the hits, so frequent words cost one lookup.
    """

    def __init__(self, compute: Callable, most: int = 400_000):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


_held: dict[tuple, object] = {}


def held(kind: str, key, build: Callable):
    """A large object that a worker process keeps for the tasks to come: one at a time, so that the memos of operators
    that ran before in the same process do not add up."""
    if (kind, key) not in _held:
        _held.clear()
        _held[kind, key] = build()
    return _held[kind, key]


def drop_held() -> None:
    """For operators that keep nothing: frees what another one has left in this process."""
    _held.clear()


#: Rows are handed on in parts of about so many bytes of text, so that one batch of long texts stays small.
PART_BYTES = 1 << 20


def parts(batch: pa.RecordBatch, text: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``most`` bytes of text or a single row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The text as a string array of 64-bit offsets; null becomes empty.

    The copy is needed: a slice shares the buffers of its batch, and Arrow's ``ascii_lower`` reads these from their start.
    """
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "").take(pa.array(np.arange(batch.num_rows)))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in one flat array, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    if len(flat):
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if not full.all():
            flat, owner = flat.filter(pa.array(full)), owner[full]
    return flat, np.bincount(owner, minlength=len(texts)).astype(np.int64)
