"""From raw documents to packed training sequences, in stages that each write Parquet for the next.

The stages keep what they are given but for their own decisions: the quality classifier and the quality rules drop the documents that they reject, the
near-duplicate stage keeps one document of each group, the secret scan replaces what it finds, and packing returns where each piece of each document lies.
Rows with a null doc_id pass all stages; a null text has no words, so both quality stages reject it; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltgrain.llm import line_crf, near_dedup, packing, quality_rules, secret_scan
from siltgrain.llm.common import Scratch
from siltgrain.llm.queries import word_bpe

#: No SQL expresses a trained model, weighted sampling or a tokenizer; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_crf.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.5)


def weak_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, threshold=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, word_bpe(), capacity=2048, end_id=0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", weak_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secrets),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir; each stage's rows wait in the shared folder, and the last one's are returned."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
