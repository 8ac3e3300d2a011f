"""Text quality of ``documents`` (problem 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.llm.quality import STATISTICS, outlierness
from overlapse.plans.session import load


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlierness(load(spark, sf_dir, "documents"), load(spark, sf_dir, "common_words"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where(~F.col("is_prose")).select(F.col("doc").alias("doc_id")).distinct()


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's statistics, its distance from prose and the statistic that adds most to it."""
    top = F.element_at(
        F.array_sort(F.transform(F.map_entries("contributions"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), 1
    )
    return _judged(spark, sf_dir).select(
        F.col("doc").alias("doc_id"),
        "lang",
        "n_words",
        *(F.col("statistics")[s].alias(s) for s in STATISTICS if s != "log_words"),
        "distance",
        top["k"].alias("outlying_statistic"),
        "is_prose",
    )


QUERIES = {"p10_found": p10_found, "p10_statistics": p10_statistics}
SQL: dict[str, str] = {}
