"""A training-data pipeline over ``documents``: five stages, each written and reread."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialflow.llm import bpe, mixing, near_dups, quality, toxicity
from trialflow.llm.queries import table
from trialflow.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7; null and empty texts are not toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3; texts without terms score as the labels' share."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.of_quality(docs, quality.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by a similarity of 0.8 or more."""
    table(spark, sf_dir, "documents")
    return near_dups.without_near_duplicates(docs, 4, 5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: sources lifted by the root of their size."""
    return mixing.in_mix_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, mix_position, n_tokens, ids and decoded of each document.

    Files that are read again promise no order, so the place in the mix is a column. Rows
    and seed determine it: it is the one that ``mix_sources`` laid the rows out by.
    """
    table(spark, sf_dir, "documents")
    placed = mixing.mixed(docs.select("doc_id", "source", "text")).select("doc_id", "source", "mix_position", "text")
    out = bpe.encoded(placed, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "source", "mix_position", F.size("ids").alias("n_tokens"), "ids", "decoded")


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near_duplicates", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: classifiers and tokenizers have no SQL; the tests hold the pipeline against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
