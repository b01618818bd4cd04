"""Training-corpus pipeline: classify, de-duplicate, decontaminate, mix, encode.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet in the shared folder and the next stage reads that.  All
but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reqlens.llm import op1_decontamination, op4_minhash, op5_mixing, op8_quality_classifier, op9_token_ids
from reqlens.llm.common import land, read_table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return op8_quality_classifier.keep_good(docs, read_table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return op4_minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return op1_decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their targets."""
    return op5_mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token-id shards and return each document's place in them."""
    import public_tokenizers
    return op9_token_ids.token_table(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", classify),
    ("near duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("mix sources", mix_sources),
    ("token ids", encode),
]

#: SQL expresses neither compression, signatures, edit search nor tokenising
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
