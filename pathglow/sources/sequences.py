"""A splittable source of feature sequences: tasks read byte ranges of a file and own the records that start inside.

Records are parted by line breaks or record marks. A file that holds one document over several lines is no sequence; it is
read by one task, which hands on the features one by one as their braces close, so that no task holds it whole. The files are found by
Spark's own file systems; the tasks read them through ``pyarrow.fs``. Each record has its place in the file, its first
byte, so rows are the same for any size of the ranges.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SPLIT_BYTES, READ_BYTES, BATCH_BYTES = 32 << 20, 1 << 20, 4 << 20
RECORD = "path string, at long, record string"
BOM = b"\xef\xbb\xbf"
#: Schemes that pyarrow's file systems know; other stores are read by Spark's reader of lines.
KNOWN = ("file", "hdfs", "s3", "s3a", "gs")


def opened(address: str) -> tuple[pafs.FileSystem, str]:
    scheme, _, rest = address.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), os.path.abspath("/" + rest.lstrip("/"))
    return pafs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{rest}")


def records(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """First byte and text of the records that start in [start, end); a record ends at a line break or record mark."""
    at = max(start - 1, 0)
    file.seek(at)
    owed = start > 0  # the record before the first mark belongs to the range before
    held, place = [], at
    while more := file.read(READ_BYTES):
        pieces = re.split(rb"[\n\x1e]", more)
        for i, piece in enumerate(pieces):
            if i:
                if not owed and held:
                    yield place, b"".join(held)
                owed, held, place = False, [], at
                if place >= end:
                    return
            if piece:
                held.append(piece)
            at += len(piece) + (i < len(pieces) - 1)
    if not owed and held:
        yield place, b"".join(held)


#: What matters outside of strings, and what ends a string.
_STRUCTURE, _STRING = re.compile(rb'["{}\[\]]'), re.compile(rb'["\\]')


def features(file: pa.NativeFile) -> Iterator[tuple[int, bytes]]:
    """First byte and text of the features of one document: a feature itself, or the objects of its outermost list."""
    inside, escaped, stack, kept, start = False, False, [], bytearray(), -1
    base, want, head = 0, None, bytearray()
    while more := file.read(READ_BYTES):
        at = taken = 0
        while at < len(more):
            if escaped:
                escaped, at = False, at + 1
                continue
            m = (_STRING if inside else _STRUCTURE).search(more, at)
            if not m:
                break
            c, at = m[0], m.end()
            if inside:
                escaped, inside = c == b"\\", c == b"\\"
            elif c == b'"':
                inside = True
            elif c in b"{[":
                if c == b"[" and want is None and len(stack) <= 1 and (not stack or re.search(rb'"features"\s*:\s*$', (bytes(head[-64:]) + more[max(taken, at - 65) : at - 1])[-64:])):
                    want = len(stack) + 1  # objects at this depth are features
                stack.append(c)
                if want is not None and len(stack) == want + 1 and c == b"{":
                    start, taken, kept = base + at - 1, at - 1, bytearray()
            else:
                stack.pop()
                if start >= 0 and want is not None and len(stack) == want:
                    yield start, bytes(kept) + more[taken:at]
                    start, kept, taken = -1, bytearray(), at
                elif want is not None and len(stack) < want:
                    want = -1  # the list is over
        if start >= 0:
            kept += more[taken:]
        elif want is None:
            head += more[taken:]  # what stands before the list of features: a feature that is the document itself is one
        base += len(more)
    if want is None and head.strip():
        yield 0, bytes(head)


def is_sequence(file: pa.NativeFile) -> bool:
    """Whether the first record is whole JSON and more may follow, or the document ends with it."""
    first, size = b"", READ_BYTES
    for _, record in records(file, 0, 1 << 62):
        first = record.removeprefix(BOM).strip()
        if first:
            break
    try:
        value = json.loads(first)
    except (ValueError, UnicodeDecodeError):
        return False
    # one long line that is a whole collection is better read feature by feature
    return not (len(first) > size and isinstance(value, (list, dict)) and (isinstance(value, list) or "features" in value))


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, whole: bool):
        self.path, self.start, self.end, self.whole = path, start, end, whole


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files: list[tuple[str, int]] = [tuple(f) for f in json.loads(options["files"])]
        self.split = int(options.get("splitbytes") or options.get("splitBytes") or SPLIT_BYTES)

    def partitions(self) -> list[_Range]:
        out = []
        for path, size in self.files:
            fs, name = opened(path)
            with fs.open_input_file(name) as file:
                sequence = is_sequence(file)
            step = self.split if sequence else max(size, 1)
            out += [_Range(path, a, min(a + step, size), not sequence) for a in range(0, size, step)]
        return out

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        fs, name = opened(partition.path)
        with fs.open_input_file(name) as file:
            rows, held = [], 0
            for at, record in features(file) if partition.whole else records(file, partition.start, partition.end):
                text = record.removeprefix(BOM).strip() if at == 0 else record.strip()
                if text:
                    rows.append((at, text.decode("utf-8", "replace")))
                    held += len(text)
                if held >= BATCH_BYTES:
                    yield self._batch(partition.path, rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(partition.path, rows)

    @staticmethod
    def _batch(path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        at, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(at, pa.int64()), pa.array(texts)], ["path", "at", "record"])


class FeatureSequence(DataSource):
    """``spark.read.format("feature_sequence")``; options: files, a JSON list of (address, bytes), and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "feature_sequence"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def found_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Address and size of the files that a path, a folder or a pattern names; hidden ones are left out."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    todo, out = list(fs.globStatus(where) or []), []
    if not todo:
        raise FileNotFoundError(path)
    while todo:
        status = todo.pop()
        if status.isDirectory():
            todo += [s for s in fs.listStatus(status.getPath()) if not s.getPath().getName().startswith(("_", "."))]
        elif status.getLen():
            out.append((status.getPath().toString(), status.getLen()))
    return sorted(out)


def read_records(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, at and record of feature files: sequences in ranges of ``split_bytes``, documents feature by feature."""
    files = found_files(spark, path)
    if any(f.partition(":")[0] not in KNOWN for f, _ in files):
        from pyspark.sql import functions as F

        lines = spark.read.text(path).select("_metadata.file_path", F.explode(F.split("value", "\x1e")).alias("record"))
        return lines.select(F.col("file_path").alias("path"), F.monotonically_increasing_id().alias("at"), F.trim("record").alias("record")).where("record <> ''")
    spark.dataSource.register(FeatureSequence)
    return spark.read.format("feature_sequence").option("files", json.dumps(files)).option("splitBytes", split_bytes).load()
