"""The queries opN_<name> over the test tables, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embeddings, html, langid, lm, minhash, packing, pii, quotation, toxicity
from .common import table


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return lm.score(table(spark, sf_dir, "documents"), remainder != 1, remainder == 4)


def op4_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.learn(docs.where(remainder != 2), "doc_id")
    return langid.predict(docs, model, ["doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out")])


def op5_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.link(table(spark, sf_dir, "conversations"))


def op8_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    n = [pii.count(base, name).alias(f"n_{name}") for name in pii.BASE_KINDS]
    return found.select("doc_id", *n, F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op10_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    learned = toxicity.learn(toxicity.sample_of(docs, labels.where(remainder != 0), "doc_id", "toxic", 20_000))
    scored = toxicity.score(docs, learned, ["doc_id"])
    return scored.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_main_text, op2_best_fit_packing, op3_deleted_interpolation, op4_language_families, op5_pruned_graph, op6_weighted_minhash, op7_quotation_links, op8_simhash_windows, op9_personal_data, op10_toxic_grammar)}
ORACLE_SQL: dict[str, str] = {}
