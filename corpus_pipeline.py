"""The corpus pipeline: language identification, near-duplicate removal, secret scans, source mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. SQL cannot
express a stage (models, sets), so ORACLE_SQL is None; tests/llm holds the stages against brute force and exact round trips.
Nulls, empty and very long texts, repeated rows, ties and empty tables go through each stage as its operator defines. Stages
bound what tasks hold at once by settings of the session (common.bounded), which stay for results that are computed later.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import jaccard, langid, mixing, packing, secrets
from folioloom.llm.common import bounded, stage


def in_bounds(apply: Callable) -> Callable:
    @wraps(apply)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded(spark)
        return apply(spark, docs, sf_dir)

    return run


@in_bounds
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unknown or whose text no model expects go."""
    return langid.accepted(docs)


@in_bounds
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return jaccard.keep_first(docs)


@in_bounds
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported spans are masked; no document goes."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


@in_bounds
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


@in_bounds
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences."""
    return packing.pack(docs, "word_bpe_49k.json").withColumnRenamed("id", "doc_id")


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan), ("mixing sources to target weights", mix), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and reread as the next stage's input."""
    bounded(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
