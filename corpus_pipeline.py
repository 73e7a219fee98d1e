"""The corpus pipeline: documents through five stages, each written as Parquet and read again as the next one's input.

Toxic documents go; of near copies (80 % of their five-word shingles) the one with the smallest doc_id stays; contaminated documents go and what is left loses the windows of test items that it
holds; sources are mixed; documents are dealt to shards. Stages take (spark, docs, sf_dir) and keep the columns of ``documents``, with other columns of any name; the last adds shard and slot. Between stages the rows lie in the
folder that all machines share (spark.checkpoint.dir), so a lost executor costs the tasks of one stage only;
a stage's input is removed once its output is written. Defined cases are those of the operators: null and empty texts stay, rows without doc_id stay, repeated rows are one document to
near-dedup, empty tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleanworks.llm import decontamination, mixing, near_dedup, sharding, toxicity
from gleanworks.llm.common import read, remove
from gleanworks.session import checkpoint_dir

NEAR_PERCENT = 80  # similarity of word shingles from which one of two documents goes
MIX_SHARE, MIX_EPOCHS = 0.8, 1  # tokens kept of those that came, and how often a row may be given
BATCH_ROWS = 1_000  # rows that go to a Python worker at a time: whole texts lie on both sides, beside what earlier stages have left in an executor


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return near_dedup.keep_one(docs, percent=NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return mixing.take(docs, MIX_SHARE, MIX_EPOCHS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]
ORACLE_SQL = None  # the first stage fits a classifier


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
