"""Counting over catalogues of experiments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Blanks in runs of one, none at the ends, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def slug(text: Column) -> Column:
    """Lower-case letters and digits in runs joined by underscores."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def split_rows(rows: DataFrame, column: str, name: str) -> DataFrame:
    """One row per entry of a comma-separated list."""
    return rows.withColumn(name, F.explode(F.filter(F.transform(F.split(column, ","), F.trim), lambda x: x != "")))


def last_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that comes last in ``order``, by partial aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *(F.col(c).alias(f"_{c}") for c in rest))).alias("best"))
    return best.select(*keys, *(F.col(f"best._{c}").alias(c) for c in rest))


def best_of(rows: DataFrame, keys: Sequence[str], *ranks: Column) -> DataFrame:
    """The first row of each key by several ranks."""
    order = Window.partitionBy(*keys).orderBy(*ranks)
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def pair_count(n: Column) -> Column:
    """n (n - 1) / 2 in whole numbers: one of two neighbours is even."""
    n = n.cast("bigint")
    even = n.bitwiseAND(F.lit(1).cast("bigint")) == 0
    return F.when(even, F.shiftright(n, 1) * (n - 1)).otherwise(n * F.shiftright(n - 1, 1))


def looked_up(rows: DataFrame, column: str, known: Mapping[str, str], name: str, missing: str | None = None) -> DataFrame:
    """Adds ``name``: what a dictionary says of ``column``, or ``missing``.  The dictionary is part of the plan."""
    pairs = [F.lit(v) for item in sorted(known.items()) for v in item]
    found = F.element_at(F.create_map(*pairs), F.col(column)) if pairs else F.lit(None).cast("string")
    return rows.withColumn(name, F.coalesce(found, F.lit(missing).cast("string")))


def reason_counts(rows: DataFrame, by: Sequence[str], reason: str) -> DataFrame:
    """(by, reason, n): how often each reason was given; rows without one don't count."""
    return rows.where(F.col(reason).isNotNull()).groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n"))


def rollup_counts(rows: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """Rows and distinct items of each group, its subtotals and the grand total, which counts items
    anew and isn't the sum of the groups.  ``level`` tells a total's null from a missing value."""
    return rows.rollup(*by).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(item).alias("n_items"))


def top_shared(rows: DataFrame, marker: str, resource: str, resources: Sequence[str], n: int) -> DataFrame:
    """The ``n`` markers present in all resources with most pairs within a resource; then most rows,
    then the marker, descending."""
    wide = rows.where(F.col(marker).isNotNull()).groupBy(F.col(marker).alias("marker")).pivot(resource, list(resources)).agg(F.count(F.lit(1)))
    for r in resources:
        wide = wide.where(F.col(f"`{r}`") > 0)
    counts = [F.col(f"`{r}`") for r in resources]
    total = sum(counts[1:], counts[0])
    pairs = sum((pair_count(c) for c in counts[1:]), pair_count(counts[0]))
    return wide.select("marker", pairs.alias("pairs"), total.alias("total")).orderBy(F.desc("pairs"), F.desc("total"), F.desc("marker")).limit(n)


def series_faults(rows: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """Rows of a series whose position is missing or doesn't exceed the one before, in ``by`` order
    of arrival given by ``seq``."""
    order = Window.partitionBy(*by).orderBy("seq")
    return rows.withColumn("_before", F.lag(at).over(order)).where(F.col(at).isNull() | (F.col(at) <= F.col("_before"))).drop("_before")


def read_records(spark: SparkSession, path: str, lists: Sequence[str] = ("experiments", "data", "results")) -> DataFrame:
    """Records of a JSON file that is a list of objects, or an object with such a list under one of
    ``lists``."""
    rows = spark.read.option("multiLine", True).json(path)
    for name in lists:
        if dict(rows.dtypes).get(name, "").startswith("array<struct"):
            return rows.select(F.inline(name))
    return rows
