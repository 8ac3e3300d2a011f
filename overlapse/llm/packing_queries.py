"""Packing ``documents`` into the capacities of ``pack_sizes`` (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.llm.packing import pack, pieces, token_counts
from overlapse.plans.session import load


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document, or piece of one that exceeds the capacity, is put."""
    return pack(pieces(token_counts(load(spark, sf_dir, "documents")), load(spark, sf_dir, "pack_sizes"))).withColumnRenamed("doc", "doc_id")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = p8_pack(spark, sf_dir)
    used = [F.sum("length").alias("used"), F.sum(F.col("length").cast("long") * F.col("length")).alias("cost")]
    fillers = F.count_if(F.col("tier") > F.col("box_tier")).alias("fillers")
    return placed.groupBy("pack_id", "container", "box_tier", "step_group").agg(*used, fillers)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, fill and balance of each capacity."""
    caps = load(spark, sf_dir, "pack_sizes")
    steps = _boxes(spark, sf_dir).groupBy("pack_id", "step_group").agg(F.count(F.lit(1)).alias("boxes"), F.sum("used").alias("used"), F.sum("cost").alias("cost"))
    return (
        steps.groupBy("pack_id")
        .agg(F.sum("boxes").alias("n_containers"), F.sum("used").alias("n_tokens"), (F.max("cost") / F.avg("cost")).alias("cost_imbalance"))
        .join(caps, "pack_id")
        .withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
    )


def p8_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, fill, and fillers from shorter tiers, of each tier of each capacity."""
    each = _boxes(spark, sf_dir).groupBy("pack_id", "box_tier").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.sum("fillers").alias("n_fillers"))
    fill = F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))
    return each.join(load(spark, sf_dir, "pack_sizes"), "pack_id").withColumn("fill", fill)


QUERIES = {"p8_pack": p8_pack, "p8_fill": p8_fill, "p8_tiers": p8_tiers}
SQL: dict[str, str] = {}
