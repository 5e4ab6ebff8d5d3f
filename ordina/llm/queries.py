"""The registered queries of this subpackage, over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordina.llm import best_fit, byte_cnn, jaccard_join, language_id, link_rank, piece_lattice, quality_rules, suffix_dedup, token_counts, vector_tree
from ordina.llm.oracles import ORACLE_SQL  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_read(spark, sf_dir, "documents")).drop("passages")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_histogram(_read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.digest(_read(spark, sf_dir, "documents"))


def op5_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tree.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(_read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return byte_cnn.classify(docs, byte_cnn.train(docs, _read(spark, sf_dir, "labels")))


def op9_link_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_rank.judge(_read(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_suffix_dedup, op3_token_counts, op4_sentencepiece, op5_vector_tree, op6_language_id, op7_best_fit_packing, op8_quality_classifier, op9_link_rank, op10_jaccard_join)}
