"""The corpus pipeline: toxic documents go, then those of low quality, then near copies; what stays is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``docs``. Between
stages the rows are written as Parquet and read again, so a lost executor costs no more than the stage at hand.

Defined cases are those of the operators. Rows with a null text pass the toxicity stage and fail the quality rules. An
empty table passes through every stage and gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathglow.llm.common import shared_path, table
from pathglow.llm.packing import pack
from pathglow.llm.quality_rules import keep_good
from pathglow.llm.simhash import keep_one_of_each_group
from pathglow.llm.toxicity import THRESHOLD, fit, score_of

TOKENIZER = "word_bpe_49k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches the threshold; learns from the labels of the rows that are not held out."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(score_of(F.col("text"), model) < THRESHOLD)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that with the least id.

    Near copies are those of the op9 contract, three-word shingles and fingerprints that differ in 2 bits at most, not
    those of similarity 0.8 over five words.
    """
    return keep_one_of_each_group(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; one row a piece."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", toxicity), ("quality rules", quality), ("simhash near-dedup", near_dedup), ("packing", packing)]

#: SQL has no fingerprints of this kind and no byte-pair encoding; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return STAGES[-1][1](spark, rows, sf_dir)
