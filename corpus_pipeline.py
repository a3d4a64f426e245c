"""Cleaning a corpus: quality, exact copies, near copies, personal data, packing; each stage by an operator of llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import exact_dedup, packing, pii, quality, setjoin
from folioframe.llm.common import durable

WORD_VOCABULARY = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of the documents before it, does not reject.

    A document is rejected if its score is under the threshold; rows that repeat an id stand or fall together, and a
    row without an id stays.
    """
    scores = durable(quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rejected = scores.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("predicted").alias("best")).filter("best = 0")
    return exact_dedup.drop_ids(docs, rejected.select("doc_id"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setjoin.drop_near_duplicates(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows and columns, with surrogates in the text and n_chars as long as the new text."""
    masked = pii.replace_entities(docs).select(*docs.columns)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES = [("quality", keep_quality), ("exact dedup", drop_copies), ("near duplicates", drop_near_copies), ("pii", mask_private), ("packing", pack)]

#: Fitted scores, shingle components and keyed surrogates have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
