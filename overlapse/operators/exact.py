"""Exact baselines: Jaccard of covered bases and of k-mer sets, and overlaps between intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapse.operators.registers import merged_intervals

BIN = 1 << 12


def covered_bases(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return merged.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


def overlaps(one: DataFrame, two: DataFrame, keys: Sequence[str], width: int = BIN) -> DataFrame:
    """(keys_1, keys_2, chrom, bases, fresh): overlaps between two tables of ``merged_intervals``; ``fresh`` isn't set
    for those that go on from another one before a tile's border.

    Both are spread over bins of the axis and joined on chromosome and bin; an overlap counts in the
    first bin both intervals reach only.
    """
    bins = F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}"))).alias("bin")
    left = one.select(*(F.col(k).alias(f"{k}_1") for k in keys), "chrom", F.col("start").alias("s1"), F.col("end").alias("e1"), F.col("continued").alias("c1"), bins)
    right = two.select(*(F.col(k).alias(f"{k}_2") for k in keys), "chrom", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("continued").alias("c2"), bins)
    met = left.join(right, ["chrom", "bin"]).where("s1 < e2 and s2 < e1").where(f"bin = greatest(s1, s2) div {width}")
    return met.select(*(f"{k}_{i}" for i in (1, 2) for k in keys), "chrom", (F.least("e1", "e2") - F.greatest("s1", "s2")).alias("bases"), (~(F.col("c1") & F.col("c2"))).alias("fresh"))


def interval_jaccard(one: DataFrame, two: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys_1, keys_2, intersection, union_bases, n_intersections, jaccard) of the pairs that overlap; others are 0.
    ``n_intersections`` counts the stretches that two merged intervals share."""
    a, b = merged_intervals(one, keys), merged_intervals(two, keys)
    k1, k2 = [f"{k}_1" for k in keys], [f"{k}_2" for k in keys]
    size = lambda df, side: covered_bases(df, keys).withColumnsRenamed({**{k: f"{k}_{side}" for k in keys}, "bases": f"b{side}"})
    shared = overlaps(a, b, keys).groupBy(*k1, *k2).agg(F.sum("bases").alias("intersection"), F.count_if("fresh").alias("n_intersections"))
    both = shared.join(size(a, 1), k1).join(size(b, 2), k2).withColumn("union_bases", F.col("b1") + F.col("b2") - F.col("intersection"))
    return both.select(*k1, *k2, "intersection", "union_bases", "n_intersections", (F.col("intersection") / F.col("union_bases")).alias("jaccard"))


def set_jaccard(one: DataFrame, two: DataFrame, keys: Sequence[str], element: str) -> DataFrame:
    """(keys_1, keys_2, intersection, union_size, jaccard) of the pairs of distinct sets that share an
    element."""
    k1, k2 = [f"{k}_1" for k in keys], [f"{k}_2" for k in keys]
    side = lambda df, i: df.select(*(F.col(k).alias(f"{k}_{i}") for k in keys), element).distinct()
    a, b = side(one, 1), side(two, 2)
    na = a.groupBy(*k1).agg(F.count(F.lit(1)).alias("n1"))
    nb = b.groupBy(*k2).agg(F.count(F.lit(1)).alias("n2"))
    met = a.join(b, element).groupBy(*k1, *k2).agg(F.count(F.lit(1)).alias("intersection"))
    full = met.join(na, k1).join(nb, k2).withColumn("union_size", F.col("n1") + F.col("n2") - F.col("intersection"))
    return full.select(*k1, *k2, "intersection", "union_size", (F.col("intersection") / F.col("union_size")).alias("jaccard"))
