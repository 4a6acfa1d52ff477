"""The corpus pipeline: quality rules, quality classifier, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents; the last returns packed pieces.

Every stage reads whole texts of any length and takes a null text for an empty one, null ids and nulls in any other
column, and further columns of any name, which pass through untouched but for the last stage. An empty table gives an
empty table. What a stage does with ties and repeated rows stands with it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkstone.llm import exact_dedup, near_dedup, packing, quality_gam, quality_rules
from inkstone.llm.common import settle, table
from inkstone.llm.queries import END_ID, SEQUENCE_TOKENS, TOKENIZER


#: Rows that go to a Python worker at once. Spark's ten thousand would hold a whole input split, some fifty megabytes of
#: texts, in the executor and again in each of its workers, of which it may keep more than it has cores.
BATCH_ROWS = 250


def in_short_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with the session set to short Arrow batches while it runs. What a stage does in Python it does before it
    returns, so its result, which is lazy, needs the setting no more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = spark.conf.get(name)
        spark.conf.set(name, BATCH_ROWS)
        try:
            return stage(spark, docs, sf_dir)
        finally:
            spark.conf.set(name, before)

    return run_stage


@in_short_batches
def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep; equal texts, repeated rows too, get the same verdict, and
    texts without words go."""
    return quality_rules.keep_good(docs)


@in_short_batches
def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; equal texts get the same score, and a score of exactly the threshold
    keeps. Without labelled rows every score is one half and all stay."""
    return quality_gam.keep_good(docs, table(spark, sf_dir, "labels"))


@in_short_batches
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the document with the largest doc_id; null ids come last, one of repeated rows stays."""
    return exact_dedup.keep_one(docs)


@in_short_batches
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest doc_id; a null id counts as smallest, one of
    repeated rows stays, and texts without words are one class."""
    return near_dedup.keep_one(docs)


@in_short_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token pieces, packed into sequences; repeated rows are packed as often as they occur, and an
    empty text is one piece that holds only the end mark."""
    return packing.pack(docs, TOKENIZER, SEQUENCE_TOKENS, END_ID)


STAGES = [
    ("quality_rules", by_rules),
    ("quality_classifier", by_classifier),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("best_fit_packing", packed),
]

#: Weak supervision, the classifier, banding and the local search have no SQL form; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
