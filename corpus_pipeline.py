"""The corpus pipeline: quality filter, near-duplicates, personal data, packing. Each stage works on what the one before it kept.

Before each stage the garbage of the driver, as each makes many plans, and of the executors is collected, whose heaps would stay as large as a stage before made them.

Cases. Null texts count as empty and are judged, kept and packed as such. Rows without doc_id are kept by the first three stages and packed. Rows that repeat id and
text are one document after the second stage; one id with several texts is several documents. Further columns, whatever their names, pass through
the first three stages unchanged. An empty table of documents or labels gives no rows or, without labels, keeps every document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from callweave.llm import minhash, packing, pii, quality
from callweave.llm.common import collected, collected_on_executors, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, trained on the table of labels, does not reject."""
    collected(spark)
    collected_on_executors(spark)
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, weights)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies, the one of the smallest id."""
    collected(spark)
    collected_on_executors(spark)
    return minhash.deduplicated(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    collected(spark)
    collected_on_executors(spark)
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its sequence and its place there."""
    collected(spark)
    collected_on_executors(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("near_copies", drop_near_copies), ("personal_data", redact), ("packing", pack)]

#: The stages' models and signatures can't be said in SQL; tests/llm recomputes what is kept, redacted and packed with the operators, each of which it holds against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
