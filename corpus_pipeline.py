"""A training corpus from the documents table, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import decontamination, minhash, packing, pii, toxicity
from assayer.llm.common import release, settled, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the grammar, learned from the labels, finds toxic."""
    sample = toxicity.sample_of(docs, table(spark, sf_dir, "labels"), "doc_id", "toxic", 20_000)
    return toxicity.accepted(docs, toxicity.learn(sample))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return minhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each span of personal data."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("minhash", without_copies),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: The stages use trained models, sampling and a tokenizer, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of packing (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of what all stages kept.

    Each stage's documents are written before the next one reads them, and go when that
    one is done, with all that it wrote on the way. Documents with a null id, a null or
    empty text or repeated rows pass through as the stages define it; an empty table gives
    no rows. Other columns of documents go along and are dropped by the last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        release(before)
    return docs
