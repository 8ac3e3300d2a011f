"""Clusters of mutually similar items by grid density, from measured pair similarities.

An item's features are its similarities to the items it was measured with: every item is an axis of the
feature space, and an item has coordinates on the few axes it was measured with.  Such a space is
searched as subspace clustering does it, with cells of one axis first and then of two:

1. Quantise.  A measured pair has the feature (measure, level of its similarity).  The pairs in each such cell
   are counted; a cell is dense with at least ``DENSE_SHARE`` of the mean count.  Adjacent dense
   cells of a measure join to zones.  The topmost zone is what *near* means, and its lower border lies midway
   in the sparse cells beneath it.
2. Cells of one axis.  Cell (a) holds the items near a, and a; its items are counted.
3. Cells of two axes.  Cell (a, b), of items near each other, holds what cells (a) and (b) share; its items are
   counted.  It is dense with at least ``DENSE`` items, or where it holds the whole of the thinner of its two
   cells and that isn't much less than the other.  A stray value between groups that are otherwise unlike gives
   a cell of two items, which is neither.
4. Cells (a) and (b) are adjacent where (a, b) is dense.  Least labels are propagated over adjacent cells until
   nothing changes; a cluster is what carries one label, and its most typical members are the items of the
   densest cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overlapse.plans.session import cut, written

WIDTH = 0.05
#: A cell of similarities is dense with at least this share of the mean number of pairs per level.
DENSE_SHARE = 0.05
#: A cell of two axes is dense with this many items.
DENSE = 3


def similarity_cells(pairs: DataFrame, width: float = WIDTH) -> DataFrame:
    """(measure, level, n, dense): the pairs in each cell; ``measure`` is 'value', or 'fallback' where that
    alone was written.  At most 1 / width cells a measure."""
    measure = F.when(F.col("value").isNotNull(), "value").otherwise("fallback")
    level = F.floor(F.least(F.greatest(F.coalesce("value", "fallback"), F.lit(0.0)), F.lit(1.0 - 1e-9)) / width).cast("int")
    counts = pairs.groupBy(measure.alias("measure"), level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("measure"))
    return counts.withColumn("dense", F.col("n") >= DENSE_SHARE * total * width)


def near_bounds(cells: DataFrame, default: float, fallback_default: float, width: float = WIDTH) -> DataFrame:
    """(measure, bound): one row a measure, the lower border of its topmost zone of adjacent dense cells; the
    default where there is no other zone beneath it."""
    order = Window.partitionBy("measure").orderBy("level")
    dense = cells.where("dense").withColumn("below", F.lag("level").over(order))
    # A zone starts at a dense cell whose lower neighbour isn't dense; the last start is the topmost zone's.
    starts = dense.where("below is null or below < level - 1").groupBy("measure").agg(F.max_by(F.struct("level", "below"), "level").alias("top"))
    usual = F.when(F.col("measure") == "value", F.lit(default)).otherwise(F.lit(fallback_default))
    middle = (F.col("top.below") + 1 + F.col("top.level")) / 2 * width
    return starts.select("measure", F.coalesce(middle, usual).alias("bound"))


def measured(pairs: DataFrame, a: str, b: str, value: str, fallback: str, weight: Column) -> DataFrame:
    """(a, b, value, fallback): one row per unordered pair, repeated measurements averaged by weight.

    Self pairs, pairs with a null name and rows without any value are dropped; NaN counts as null.
    """
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    mean = lambda c: F.sum(F.col(c) * F.col("_w")) / F.sum(F.when(F.col(c).isNotNull(), F.col("_w")))
    return (
        pairs.where(F.col(a) != F.col(b))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), clean(value).alias("_v"), clean(fallback).alias("_f"), weight.alias("_w"))
        .where("_v is not null or _f is not null")
        .groupBy("a", "b")
        .agg(mean("_v").alias("value"), mean("_f").alias("fallback"))
    )


def near_pairs(pairs: DataFrame, default: float = 0.35, fallback_default: float = 0.45) -> DataFrame:
    """(a, b, near, value): ``measured`` pairs with the verdict of their cell; ``fallback`` counts only where
    ``value`` is null, and has cells of its own."""
    bounds = near_bounds(similarity_cells(pairs), default, fallback_default)
    measure = F.when(F.col("value").isNotNull(), "value").otherwise("fallback")
    # One row for each of the two measures.
    placed = pairs.withColumn("measure", measure).join(F.broadcast(bounds), "measure")
    return placed.select("a", "b", (F.coalesce("value", "fallback") >= F.col("bound")).alias("near"), F.coalesce("value", "fallback").alias("value"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("item"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("item"), F.col("a").alias("other"))
    )


def axis_cells(near: DataFrame) -> DataFrame:
    """(item, n): how many items the cell of each axis holds, its own one included."""
    return _both_ways(near).groupBy("item").agg((F.count(F.lit(1)) + 1).alias("n"))


def _counted(edges: DataFrame) -> DataFrame:
    n = axis_cells(edges)
    return edges.join(n.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")


def adjacent_cells(pairs: DataFrame) -> DataFrame:
    """(a, b): near pairs whose cells are adjacent, by the items in cell (a, b).

    What the two cells share is looked up from the thinner one, so a hot axis costs no more than its partners'
    own cells.  Cells of two items can be dense only where one of theirs has no third (groups of two, and
    chains of three that weren't measured all round); cells are counted again without the sparse ones for them.
    """
    near = written(_counted(pairs.where("near").select("a", "b")), "near")
    thin = F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b"))
    thick = F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a"))
    members = _both_ways(near.select("a", "b"))
    further = (
        near.select("a", "b", thin.alias("thin"), thick.alias("thick"))
        .join(members.select(F.col("item").alias("thin"), F.col("other").alias("z")), "thin")
        .where("z <> thick")
        .join(members.select(F.col("item").alias("thick"), F.col("other").alias("z")), ["thick", "z"])
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("further"))
    )
    # Both axis items are in the cell.
    counted = near.join(further, ["a", "b"], "left").withColumn("n", F.coalesce("further", F.lit(0)) + 2)
    kept = written(counted.where((F.col("n") >= DENSE) | (F.col("n") == F.least("na", "nb"))).select("a", "b", "n"), "cells")
    return _counted(kept).where((F.col("n") >= DENSE) | (F.col("n") >= F.greatest("na", "nb") - 1)).select("a", "b")


def labels(edges: DataFrame) -> DataFrame:
    """(item, label): the smallest item of each connected component.

    Each round an item takes the least label of its own label and of its neighbours' labels' labels, and
    offers the latter to its label too, so rounds grow with the logarithm of a component's size.  Every round
    is checkpointed; it ends when none changes.
    """
    both = written(_both_ways(edges), "adjacent")
    now = cut(both.groupBy("item").agg(F.least(F.col("item"), F.min("other")).alias("label")))
    while True:
        jumped = now.join(now.select(F.col("item").alias("label"), F.col("label").alias("top")), "label")
        offered = both.join(jumped.select(F.col("item").alias("other"), "top"), "other").groupBy("item").agg(F.min("top").alias("top"))
        offered = offered.join(now, "item")
        every = (
            jumped.select("item", F.col("top").alias("label"), F.col("label").alias("was"))
            .unionByName(offered.select("item", F.col("top").alias("label"), F.lit(None).alias("was")))
            .unionByName(offered.select(F.col("label").alias("item"), F.col("top").alias("label"), F.lit(None).alias("was")))
        )
        now = cut(every.groupBy("item").agg(F.min("label").alias("label"), F.max("was").alias("was")))
        moved = now.where("label <> was").limit(1).count()
        now = now.select("item", "label")
        if not moved:
            return now


def clusters(pairs: DataFrame) -> DataFrame:
    """(item, cluster, size, density): members of clusters of two or more items.

    ``density`` is the number of items in the item's cell after sparse cells are gone, itself not counted.
    Items in no cluster don't appear; an empty input gives no rows.
    """
    edges = written(adjacent_cells(pairs), "edges")
    named = labels(edges)
    size = named.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return named.join(size, "label").join(axis_cells(edges), "item").select("item", F.col("label").alias("cluster"), "size", (F.col("n") - 1).alias("density"))


def typical_members(members: DataFrame, top: int = 3) -> DataFrame:
    """(cluster, size, densest, typical): each cluster with its ``top`` members of the densest
    cells, ties by name.  Keeps the top of each partial group, never a whole cluster at once."""
    rank = F.struct((-F.col("density")).alias("d"), F.col("item").alias("item"))
    # Two steps: the best of each of 64 slices, then the best of those.
    sliced = Window.partitionBy("cluster", "slice").orderBy("rank")
    over = Window.partitionBy("cluster").orderBy("rank")
    best = (
        members.select("cluster", "size", rank.alias("rank"), F.pmod(F.xxhash64("item"), F.lit(64)).alias("slice"))
        .withColumn("place", F.row_number().over(sliced))
        .where(F.col("place") <= top)
        .withColumn("place", F.row_number().over(over))
        .where(F.col("place") <= top)
    )
    return best.groupBy("cluster", "size").agg(
        (-F.min("rank.d")).alias("densest"), F.array_join(F.transform(F.array_sort(F.collect_list("rank")), lambda r: r["item"]), ",").alias("typical")
    )
