"""The corpus pipeline: five stages, each one of the package's operators over all its predecessor kept.

1. toxicity: documents that the classifier rejects go.
2. exact_dedup: of equal texts one row stays.
3. near_dedup: of each group of near duplicates (five-word shingles, similarity 0.8) one row stays,
   whether ids are repeated or null.
4. mixing: rows are put into the order of the target weights; none goes.
5. packing: tokens in sequences, numbered in the order of mixing; the last stage's rows are pieces.

Each stage's result is written as Parquet in the session's shared checkpoint folder
and read again as the next stage's documents, so a lost executor costs a task of
one stage.  Empty and null texts, repeated rows and extra columns are treated as
the operators say; extra columns are carried to the fourth stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from twinlake.llm import exact_dedup, mixing, ngram_join, packing, textkit, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, textkit.labels(spark, sf_dir))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, n=5, percent=80, spare_null_ids=False)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_in_order(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlake.session import ensure_checkpoint_dir

    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline/{uuid.uuid4().hex}"
    docs = textkit.documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
