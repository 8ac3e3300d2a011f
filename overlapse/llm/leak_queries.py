"""Evaluation passages in ``documents`` (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.llm.leaks import WORDS, leaks
from overlapse.plans.session import load


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))
    exact = found.where(F.col("run_words") >= WORDS)
    return exact.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p9_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region within the edit budget, with its evidence."""
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")).withColumnsRenamed(
        {"doc": "doc_id", "item": "item_id"}
    )


QUERIES = {"p9_found": p9_found, "p9_regions": p9_regions}
SQL: dict[str, str] = {}
