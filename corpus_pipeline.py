"""Corpus pipeline: documents in, token ids of the clean ones out.

Each stage calls one operator of ``barfold.llm`` and its decisions take effect: documents that
language ID rejects go, repeated lines go, one document of each near-duplicate group stays,
documents that hold a benchmark item go, and what is left is encoded.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from barfold.llm import decontaminate, language_id, line_dedup, simhash_pivots
from barfold.llm.common import table
from barfold.llm.queries import bpe_digests
from barfold.session import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.drop_rejected(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no line is left are copies as a whole and go."""
    left = line_dedup.dedup_lines(docs)
    return left.where("not (n_dropped > 0 and trim(both ' \n' from text) = '')").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_pivots.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("decontamination", benchmark),
    ("byte_bpe", encode),
]

#: The pattern of the tokenizer, fingerprints and the edit distance of runs are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
