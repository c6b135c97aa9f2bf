"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A document longer than a window first gives off full windows; what
is left goes to the open window that it fills best. If none has room, the fullest is emitted and a new one is opened.
The windows still open at the end of a partition are leftovers. They are merged with those of other partitions in tasks
that hold a bounded number of windows each: laid end to end and cut every ``capacity`` ids, so that a task leaves one
sequence short at most, and a piece is cut in two at most.

Defined cases: a null text counts as empty, and its document is the end mark alone; documents of the size of a window
fill one exactly; repeated rows are packed as often as they occur; null ids are carried along, and ids may be of any type;
an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglow.llm.bpe import encoder
from pathglow.llm.common import parts, text_column, written

CAPACITY, OPEN_WINDOWS, MERGED_TOGETHER = 4096, 64, 4096
PIECE = "start long, length long, ids binary, doc_tokens long, window long, offset long, fill long, is_open boolean"


class OpenWindows:
    """At most ``most`` windows being filled; ``place`` returns the pieces of the windows that it emits."""

    def __init__(self, first_id: int, capacity: int, most: int):
        self.next_id, self.capacity, self.most = first_id, capacity, most
        self.room: list[tuple[int, int]] = []  # (room left, window), ascending
        self.held: dict[int, list[list]] = {}

    def place(self, piece: list, length: int) -> list[list]:
        """``piece`` is a row that lacks window, offset, fill and is_open."""
        out: list[list] = []
        if length == self.capacity:
            self.next_id += 1
            return [[*piece, self.next_id, 0, length, False]]
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            if len(self.room) == self.most:
                out = self.emit(*self.room.pop(0), is_open=False)
            self.next_id += 1
            room, window = self.capacity, self.next_id
            self.held[window] = []
        self.held[window].append([*piece, window, self.capacity - room])
        if room == length:
            return out + self.emit(0, window, is_open=False)
        insort(self.room, (room - length, window))
        return out

    def emit(self, room: int, window: int, is_open: bool) -> list[list]:
        return [[*p, self.capacity - room, is_open] for p in self.held.pop(window)]

    def leftovers(self) -> list[list]:
        return [p for room, window in self.room for p in self.emit(room, window, is_open=True)]


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids by the tokenizer at ``path`` and then ``end_id``. start counts its ids before the piece; offset
    the sequence's ids before it. Only leftovers, a bounded number of windows a partition, keep their ids until they are
    merged; the others' crc is taken while the ids are at hand, and by start and length they can be had again.
    """
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = OpenWindows(TaskContext.get().partitionId() << 36, capacity, open_windows)
        encode, kind = encoder(path).encode, pa.null()
        for batch in batches:
            kind = batch.schema.field("id").type
            for part in parts(batch, "text"):
                rows: list[list] = []
                for key, text in zip(part.column("id").to_pylist(), text_column(part, "text").to_pylist(), strict=True):
                    ids = encode(text) + end
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        own = ids[4 * start : 4 * (start + capacity)]
                        rows += windows.place([key, start, len(own) // 4, own, total], len(own) // 4)
                yield from batches_of(rows, kind)
        yield from batches_of(windows.leftovers(), kind)

    names = ["id", *(c.strip().split(" ")[0] for c in PIECE.split(","))]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def batches_of(rows: list[list], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 2000):
            columns = list(zip(*rows[at : at + 2000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *types], strict=True)], names)

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = slim.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, {PIECE}")
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).withColumn("ids", F.when(F.col("is_open"), F.col("ids")))
    pieces = written(pieces, "pieces")
    merged = _merged_leftovers(pieces.where("is_open and offset = 0").select("window", "fill"))
    placed = pieces.where("is_open").join(merged, "window").withColumn("at", F.col("base") + F.col("offset"))
    first = F.least("length", capacity - F.col("at") % capacity)
    cut = placed.withColumn("part", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("skip"), first.alias("n")), F.struct(first.alias("skip"), (F.col("length") - first).alias("n"))))).where("part.n > 0")
    skip, n = F.col("part.skip"), F.col("part.n")
    columns = [F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens"]
    return (
        pieces.where("not is_open").select(*columns, F.col("window").alias("sequence_id"), "offset")
        .unionByName(cut.select(
            F.col("id").alias(id_col), (F.col("start") + skip).alias("start"), n.alias("length"), F.crc32(F.substring("ids", 4 * skip + 1, 4 * n)).alias("ids_crc32"), "doc_tokens",
            (F.col("task") + F.floor((F.col("at") + skip) / capacity)).alias("sequence_id"), ((F.col("at") + skip) % capacity).alias("offset"),
        ))
    )


def _merged_leftovers(leftovers: DataFrame) -> DataFrame:
    """window, task and base, for the open windows of all partitions: the ids before it among those of its task.

    A task's number is the first of its sequences', above those of all windows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = list(frames)
        if not whole:
            return
        frame = pd.concat(whole).sort_values("window")
        yield pd.DataFrame({"window": frame["window"], "task": (1 << 62) + (TaskContext.get().partitionId() << 36), "base": frame["fill"].cumsum() - frame["fill"]})

    tasks = max(1, -(-leftovers.count() // MERGED_TOGETHER))
    dealt = leftovers.repartition(tasks, F.xxhash64("window"))
    return written(dealt.mapInPandas(run, "window long, task long, base long"), "merged")
