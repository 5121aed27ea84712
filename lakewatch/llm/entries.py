"""Queries of the training-data operators, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewatch.llm import alignment, centroids, language_id, line_dedup, media, metric_tree, mixing, packing, pii, quality_gam, quality_rules, secret_scan, simhash
from lakewatch.llm.common import read_documents, read_embeddings


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(read_documents(spark, sf_dir)))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read_documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read_documents(spark, sf_dir)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.ledger(read_documents(spark, sf_dir)))


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir), with_ids=False)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read_documents(spark, sf_dir))  # shard and offset differ between runs


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(read_documents(spark, sf_dir).select("doc_id", "text"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return quality_gam.score(docs, quality_gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_embeddings(spark, sf_dir))


def op12_metric_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.top_k(read_embeddings(spark, sf_dir))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_simhash_near_dedup, op3_mix_sources, op4_language_id, op5_pii, op6_quality_rules, op7_harmonic_packing, op8_media_columns, op9_line_dedup, op10_quality_classifier,
    op11_sharded_lloyd, op12_metric_tree_search, op13_tokenizer_alignment,
)}
ORACLE_SQL = {"op3_mix_sources": mixing.ORACLE_SQL, "op6_quality_rules": quality_rules.ORACLE_SQL}
