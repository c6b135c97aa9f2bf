"""BPE encoding, decoding and counting as narrow table scans; no row leaves its partition.

Defined cases: a null text counts as empty and gives no tokens; texts are encoded whole whatever their length; repeated
rows and null ids are returned as they come; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglow.llm.bpe import counter, encoder
from pathglow.llm.common import parts, text_column


def _scan(docs: DataFrame, id_col: str, text_col: str, run, schema: str) -> DataFrame:
    """``run`` gets the texts of a small part as a list and returns the columns that follow the id."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), *run(text_column(part, "text"))], names)

    names = ["id", *(c.strip().split(" ")[0] for c in schema.split(","))]
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(over, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id_col``, ids (binary: little-endian unsigned 32-bit integers) and decoded (string)."""

    def run(texts: pa.Array) -> list[pa.Array]:
        codec = encoder(path)
        ids = [codec.encode(t) for t in texts.to_pylist()]
        return [pa.array(ids, pa.binary()), pa.array([codec.decode(i) for i in ids], pa.string())]

    return _scan(docs, id_col, text_col, run, "ids binary, decoded string")


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id_col``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""

    def run(texts: pa.Array) -> list[pa.Array]:
        count = counter(path).count
        return [pc.binary_length(texts).cast(pa.int64()), pa.array([count(t) for t in texts.to_pylist()], pa.int64())]

    return _scan(docs, id_col, text_col, run, "n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
