"""The training-data pipeline: stages over the documents table, each one's result written and read back as the next one's input."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textguard.llm import bbit_minhash, packing, pii_tagger, weak_quality
from textguard.llm.common import small_batches, stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the quality classifier accepts; it is fitted anew on the documents given."""
    return weak_quality.accepted(small_batches(docs))


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return bbit_minhash.one_of_each(small_batches(docs), words=5, threshold_percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii_tagger.redact(small_batches(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each tokenised document goes in sequences of 2048 tokens."""
    return packing.pack_documents(small_batches(docs), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [("quality classifier", good_documents), ("near duplicates", different_documents), ("personal data", without_personal_data), ("packing", packed_sequences)]
#: The classifier's and the tagger's weights cannot be stated in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if k < len(STAGES) else docs
    return docs
