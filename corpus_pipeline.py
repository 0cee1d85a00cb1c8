"""A corpus from raw documents to packed sequences, stage by stage.

Each stage reads the Parquet table that the one before it wrote, and all but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import exact_dedup, jaccard_join, packing, quality, secrets
from corpusloom.llm.common import small_batches, stage
from corpusloom.session import delete, tracked

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the last stage wrote on its way, by application. When the next one begins its result has been written, and they are spent.
_SPENT: dict[str, list[str]] = {}


def cleaned_up(function: Stage) -> Stage:
    """Deletes what the stage before has left. The first stage deletes nothing: what came before it may still be read."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = spark.sparkContext.applicationId
        spent = _SPENT.pop(key, [])
        if function.__name__ != STAGES[0][1].__name__:
            delete(spark, spent)
        with tracked() as paths:
            found = function(spark, docs, sf_dir)
        _SPENT[key] = paths
        return found

    return run_stage


@cleaned_up
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a certified rule rejects go."""
    return quality.keep_good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@cleaned_up
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


@cleaned_up
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked texts the smallest doc_id stays; texts link by five words and a similarity of 0.8."""
    return jaccard_join.keep_one_of_each_group(docs, n=5, percent=80)


@cleaned_up
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    with small_batches(spark):  # the caller's job would send larger ones
        return stage(secrets.redact(docs), "redacted")


@cleaned_up
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its sequence and offset."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Near copies, secrets and packing are beyond SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"stage-{i}")
    return docs
