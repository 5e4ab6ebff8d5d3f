"""A training corpus out of the table documents: filter, deduplicate, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but
the last return the columns of docs, of whatever names; the last returns the pieces of the packed
sequences. In every stage a null or empty text is a document without words: the rules reject it, all
other stages would keep it as it is. Repeated rows are alike to the first two stages, one document
to the third; a null id is no reason to go. Texts are whole, however long. Ties (equal ids of one
class) leave one row. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ordina.llm import best_fit, byte_cnn, jaccard_join, quality_rules, suffix_dedup
from ordina.llm._store import durable, forget


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the table labels, scores 0.3 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return byte_cnn.keep(docs, byte_cnn.train(docs, labels))


def host_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules themselves and come from a host that passes."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return jaccard_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere too."""
    return suffix_dedup.strip(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return best_fit.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", host_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packing),
]

#: A learned classifier, approximate candidates and a tokenizer are nothing SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            forget(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
