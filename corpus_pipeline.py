"""A corpus through five stages: quality rules, near-dedup, personal data, mixing, encoding.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and its result is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotledger.llm import bpe, mixing, near_dup, pii, quality_rules
from lotledger.llm.columns import unused
from lotledger.session import shared_dir

VOCABULARY = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    mark = unused(docs, "rejected_by")
    return quality_rules.cascade(docs, rejected_by=mark).filter(F.col(mark).isNull()).drop(mark)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id."""
    return near_dup.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced by its kind; n_chars is counted anew."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of the sources ask for."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document of the mix."""
    out = bpe.encode(docs, public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("near-dedup", dedup), ("personal data", private), ("mixing", mix), ("encoding", encode)]

#: Near-dedup and encoding can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
