"""Overlap sizes between many sets from bottom-k hash sketches.

A set's smallest element hashes are a uniform sample of it.  The hash range is cut at shared borders,
the powers of 1/2: *layer* j holds the hashes of [2^-(j+1), 2^-j) of the range, so a hash is in the same
layer whichever set holds it.  A set's sketch is its hashes below the lowest border that still leaves
k of them (between k and about 2k), or all of them where the set has fewer than 2k; that border is the
sketch's *level*.  Beside the hashes a sketch has, for each layer, their number and the largest one.

For a pair, both sets' hashes below the smaller set's border are merged: the merged list's length and its
last hash give the size of the union, the part of it that is in both gives the shared fraction, and their
product is the intersection.  A sketch of k hashes of a set of a million says nothing of a set of a hundred;
so the larger set is read in deeper layers there, down to the border of the smaller.  Only hashes that lie in
a second set and in some set's sketch are ever read for that; all others are known by the layers' counts.

Sketches merge by union of their hashes below the higher of their borders, and a set that comes later adds
rows of its own without any other being read again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overlapse.plans.session import written

K = 1024
SPAN = 1 << 63


def element_hash(*cols: str) -> Column:
    """63-bit hash of an element."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)


def layer_of(h: Column) -> Column:
    """Leading zeros of a 63-bit hash: j where it lies in [2^-(j+1), 2^-j) of the range."""
    for by in (1, 2, 4, 8, 16, 32):
        h = h.bitwiseOR(F.shiftrightunsigned(h, by))
    return (F.lit(63) - F.bit_count(h)).cast("int")


def distinct_elements(rows: DataFrame, set_col: str, element_cols: Sequence[str], hashed: Callable[..., Column] = element_hash) -> DataFrame:
    """(set_id, h): the distinct element hashes of each set.  Rows with a null set are dropped."""
    return rows.where(F.col(set_col).isNotNull()).select(F.col(set_col).alias("set_id"), hashed(*element_cols).alias("h")).distinct()


def _below(layers: Column, level: Column) -> Column:
    """How many hashes lie below the border of ``level``."""
    kept = F.filter(layers, lambda x: x["layer"] >= level)
    return F.aggregate(kept, F.lit(0).cast("bigint"), lambda n, x: n + x["n"])


def _last(layers: Column, level: Column) -> Column:
    """The largest hash below the border of ``level``."""
    return F.array_max(F.transform(F.filter(layers, lambda x: x["layer"] >= level), lambda x: x["last"]))


def set_layers(elements: DataFrame, k: int = K) -> DataFrame:
    """(set_id, n, level, kept, layers): each set's size, its sketch's level and number of hashes, and the
    counts of its layers (at most 63)."""
    each = elements.groupBy("set_id", layer_of(F.col("h")).alias("layer")).agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("last"))
    whole = each.groupBy("set_id").agg(F.sum("n").alias("n"), F.collect_list(F.struct("layer", "n", "last")).alias("layers"))
    enough = F.filter("layers", lambda x: _below(F.col("layers"), x["layer"]) >= k)
    level = F.coalesce(F.array_max(F.transform(enough, lambda x: x["layer"])), F.lit(0))
    return whole.withColumn("level", level).withColumn("kept", _below(F.col("layers"), F.col("level")))


def sketches(elements: DataFrame, k: int = K) -> DataFrame:
    """(set_id, level, h): the sketch of each set."""
    levels = set_layers(elements, k).select("set_id", "level")
    return elements.join(levels, "set_id").where(layer_of(F.col("h")) >= F.col("level")).select("set_id", "level", "h")


def merged_sketches(sketch: DataFrame, groups: DataFrame, k: int = K) -> DataFrame:
    """(set_id, level, h): sketches of the unions of sets that ``groups`` (set_id, group) puts together, from
    the sets' sketches alone; ``set_id`` is the group's.  The same as the sketch of the union's elements."""
    named = sketch.join(groups, "set_id")
    border = named.groupBy("group").agg(F.max("level").alias("least"))
    kept = named.join(border, "group").where(layer_of(F.col("h")) >= F.col("least"))
    union = kept.select(F.col("group").alias("set_id"), "h", "least").distinct()
    levels = set_layers(union.select("set_id", "h"), k).select("set_id", "level")
    both = union.join(levels, "set_id").withColumn("level", F.greatest("level", "least"))
    return both.where(layer_of(F.col("h")) >= F.col("level")).select("set_id", "level", "h")


class Index(NamedTuple):
    """``sets``: ``set_layers``; ``shared``: (set_id, h, sets, n, level, kept), the elements that more than
    one set has, with the number of their sets."""

    sets: DataFrame
    shared: DataFrame


def indexed(elements: DataFrame, k: int = K) -> Index:
    """Both are written: the elements are shuffled by hash once, what only one set has goes no further."""
    sets = written(set_layers(elements, k), "layers")
    by_hash = elements.repartition("h").withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("sets > 1")
    return Index(sets, written(by_hash.join(sets.select("set_id", "n", "level", "kept"), "set_id"), "shared"))


def overlaps(index: Index, least: float, sigmas: float = 5.0) -> DataFrame:
    """Pairs of sets whose shared elements may be at least ``least`` of the smaller set.

    (set_1, set_2, n_1, n_2, merged, shared, union_size, jaccard, containment_12, containment_21, error): set_1 is the
    smaller set (the lower id at a tie), ``merged`` the length of the merged list, ``shared`` the estimate,
    ``error`` the standard error of containment_12, which falls to 0 as the merged list grows to the whole union.
    Every pair whose estimate plus ``sigmas`` errors reaches ``least`` is returned.

    Candidates come from the shared hashes with a prefix filter: of a sketch only the rarest hashes are
    looked up, as many as every qualifying pair must meet at least once, so a hash that sits in a third of all
    sets is looked up only by sets that have little else.  No pair is capped.
    """
    sketch = index.shared.where(layer_of(F.col("h")) >= F.col("level"))
    share = F.pow(F.lit(0.5), F.col("level"))
    # Lowest number of common hashes a qualifying pair shows, less the noise of a sample of that share.
    noise = sigmas * F.sqrt(F.col("kept") * least * (1 - least) * (1 - share))
    need = F.greatest(F.lit(1.0), F.ceil(F.col("kept") * least - noise - 1e-9))
    rare_first = Window.partitionBy("set_id").orderBy("sets", "h")
    whole = Window.partitionBy("set_id")
    placed = sketch.withColumn("place", F.col("kept") - F.count(F.lit(1)).over(whole) + F.row_number().over(rare_first))
    prefix = placed.where(F.col("place") <= F.col("kept") - need + 1)
    small = prefix.select(F.col("set_id").alias("set_1"), F.col("n").alias("n_1"), "h")
    large = index.shared.select(F.col("set_id").alias("set_2"), F.col("n").alias("n_2"), "h")
    ordered = (F.col("n_1") < F.col("n_2")) | ((F.col("n_1") == F.col("n_2")) & (F.col("set_1") < F.col("set_2")))
    pairs = small.join(large, "h").where(ordered).select("set_1", "set_2").distinct()
    mine = sketch.select(F.col("set_id").alias("set_1"), "h")
    met = (
        pairs.join(mine, "set_1")
        .join(large.select("set_2", "h"), ["set_2", "h"], "left_semi")
        .groupBy("set_1", "set_2")
        .agg(F.count(F.lit(1)).alias("met"))
    )
    one = index.sets.select(F.col("set_id").alias("set_1"), F.col("n").alias("n_1"), "level", F.col("kept").alias("below_1"), F.col("layers").alias("layers_1"))
    two = index.sets.select(F.col("set_id").alias("set_2"), F.col("n").alias("n_2"), F.col("layers").alias("layers_2"))
    level, merged = F.col("level"), F.col("merged")
    last = F.greatest(_last(F.col("layers_1"), level), _last(F.col("layers_2"), level))
    union = F.when(level == 0, merged.cast("double")).otherwise((merged - 1) / ((last + 1) / float(SPAN)))
    both = (
        met.join(one, "set_1").join(two, "set_2")
        .withColumn("merged", F.col("below_1") + _below(F.col("layers_2"), level) - F.col("met"))
        .withColumn("union_size", union)
        .withColumn("jaccard", F.col("met") / merged)
        .withColumn("shared", F.col("jaccard") * F.col("union_size"))
    )
    # Of the fraction (binomial), the union (its relative error is 1 / sqrt(merged)) and of rounding.
    spread = F.sqrt(F.col("jaccard") * (1 - F.col("jaccard")) / merged + F.col("jaccard") * F.col("jaccard") / merged) + 0.5 / merged
    return both.select(
        "set_1",
        "set_2",
        "n_1",
        "n_2",
        "merged",
        "shared",
        "union_size",
        "jaccard",
        (F.col("shared") / F.col("n_1")).alias("containment_12"),
        (F.col("shared") / F.col("n_2")).alias("containment_21"),
        (spread * F.col("union_size") * F.sqrt(1 - F.pow(F.lit(0.5), level)) / F.col("n_1")).alias("error"),
    ).where(F.col("containment_12") + sigmas * F.col("error") >= least - 1e-12)


def at_least(elements: DataFrame, least: float, k: int = K, sigmas: float = 5.0) -> DataFrame:
    """The pairs of ``overlaps`` that do share at least ``least`` of the smaller set.

    Estimates further than ``sigmas`` errors from the bound stand; the rest is counted, from the list of those
    pairs outward.
    """
    index = indexed(elements, k)
    pairs = written(overlaps(index, least, sigmas), "overlaps")
    sure = F.col("containment_12") - sigmas * F.col("error") >= least - 1e-12
    close = pairs.where(~sure).select("set_1", "set_2", "n_1")
    counted = (
        close.join(index.shared.select(F.col("set_id").alias("set_1"), "h"), "set_1")
        .join(index.shared.select(F.col("set_id").alias("set_2"), "h"), ["set_2", "h"], "left_semi")
        .groupBy("set_1", "set_2", "n_1")
        .agg(F.count(F.lit(1)).alias("exact"))
        .where(F.col("exact") >= F.col("n_1") * least - 1e-9)
    )
    return pairs.where(sure).select("set_1", "set_2").unionByName(counted.select("set_1", "set_2"))
