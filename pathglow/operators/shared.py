"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame


_made: dict[int, tuple[str, weakref.ref]] = {}
_every: list = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _made[id(made)] = path, weakref.ref(made, lambda _, key=id(made): _made.pop(key, None))
    _every.append((spark, path))
    return made


def removed(*spent: DataFrame) -> None:
    """Removes the tables behind DataFrames that ``written`` returned and that nothing reads any more.

    Without any, all that this process has written: call it so once the results have been written.
    """
    paths = [_made[id(df)][0] for df in spent if id(df) in _made] if spent else [p for _, p in _every]
    for spark, path in [e for e in _every if e[1] in set(paths)]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _every.remove((spark, path))
