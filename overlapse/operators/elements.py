"""Set elements of interval files: whole intervals, covered positions, or both, and their samplers.

Inputs hold ``chrom``, ``start`` and ``end`` (0-based, half-open) beside any key columns; outputs
hold the key columns and ``element``, the text that is hashed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlapse.functions.hashing import GATE_SEED, GATE_SPAN, SEED, gate, hashed

SEPARATOR = "\t"
SAMPLERS = ("mixed-stride", "hash-threshold", "single-hash")
#: Chromosome names whose position text can exceed 64 bytes take a plain stride from each start.
LONG_NAME = 44
#: Intervals are cut into pieces of this many positions before they are exploded.
PIECE = 1 << 16


def checked_rate(rate: float, name: str) -> float:
    if not 0.0 <= rate <= 1.0:
        raise ValueError(f"{name} must lie in [0, 1], not {rate}")
    return rate


def threshold(rate: float) -> int:
    """Gate hashes up to this one pass."""
    return int(rate * GATE_SPAN)


def interval_text(sep: str = SEPARATOR) -> Column:
    return F.concat_ws(sep, "chrom", "start", "end", F.lit("A"))


def point_text(position: Column, sep: str = SEPARATOR) -> Column:
    return F.concat_ws(sep, F.col("chrom"), position)


def interval_elements(
    intervals: DataFrame, keys: Sequence[str], rate: float = 1.0, exponent: float = 0.0, sep: str = SEPARATOR,
    gate_seed: int = GATE_SEED, gate_kind: str = "xxh32",
) -> DataFrame:
    """Mode A: one element per interval.  ``rate`` gates the interval's text; an ``exponent`` above 0
    repeats it 10^exponent times, numbered from 1."""
    checked_rate(rate, "rate")
    rows = intervals.select(*keys, interval_text(sep).alias("element"))
    if rate < 1.0:
        rows = rows.where(gate(F.col("element"), gate_seed, gate_kind) <= threshold(rate))
    copies = max(1, int(10**exponent)) if exponent > 0 else 1
    if copies > 1:
        numbered = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        rows = numbered.select(*keys, F.concat("element", F.col("copy").cast("string")).alias("element"))
    return rows


def _pieces(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long intervals in pieces, spread over tasks, so that no row explodes into millions."""
    cuts = F.sequence(F.col("start"), F.col("end") - 1, F.lit(PIECE).cast("bigint"))
    return (
        intervals.where("start < end")
        .select(*keys, "chrom", "end", F.explode(cuts).alias("start"))
        .select(*keys, "chrom", "start", F.least(F.col("end"), F.col("start") + PIECE).alias("end"))
    )


def strides(rate: float) -> tuple[int, int, float]:
    """The two whole strides around 1 / rate, and the share of chromosomes that takes the longer."""
    short, long = max(1, math.floor(1 / rate)), max(1, math.ceil(1 / rate))
    share = 0.0 if short == long else (rate - 1 / short) / (1 / long - 1 / short)
    return short, long, share


def chromosome_strides(intervals: DataFrame, rate: float, gate_seed: int = GATE_SEED, gate_kind: str = "xxh32") -> DataFrame:
    """(chrom, stride, residue) of each chromosome: positions congruent to the residue are kept, so
    the sample doesn't depend on where intervals begin."""
    short, long, share = strides(rate)
    names = intervals.select("chrom").distinct()
    picked = F.when(gate(F.col("chrom"), gate_seed, gate_kind) / GATE_SPAN < share, long).otherwise(short)
    named = names.withColumn("stride", picked.cast("bigint"))
    residue = F.pmod(gate(F.concat("chrom", F.lit("|res")), gate_seed, gate_kind), F.col("stride"))
    return named.withColumn("residue", residue)


def point_elements(
    intervals: DataFrame, keys: Sequence[str], rate: float = 1.0, method: str = "mixed-stride", sep: str = SEPARATOR,
    seed: int = SEED, gate_seed: int = GATE_SEED, kind: str = "xxh64", gate_kind: str = "xxh32",
) -> DataFrame:
    """Mode B: every covered position, or the sampled share ``rate`` of them (0 keeps none).

    ``mixed-stride`` generates only the kept positions; ``hash-threshold`` gates each position's
    text; ``single-hash`` gates by the upper half of the element's own hash.
    """
    checked_rate(rate, "rate")
    if method not in SAMPLERS:
        raise ValueError(f"unknown sampler {method}; one of {', '.join(SAMPLERS)}")
    step = F.lit(1).cast("bigint")
    position = F.explode(F.sequence(F.col("start"), F.col("end") - 1, step)).alias("position")
    if rate == 0.0:
        return intervals.where(F.lit(False)).select(*keys, F.lit("").alias("element"))
    if rate >= 1.0 or method != "mixed-stride":
        points = _pieces(intervals, keys).select(*keys, "chrom", position).select(*keys, point_text(F.col("position"), sep).alias("element"))
        if rate >= 1.0:
            return points
        if method == "single-hash":
            return points.where(F.shiftrightunsigned(hashed(F.col("element"), kind, seed), 28 if kind == "md5_60" else 32) <= threshold(rate))
        return points.where(gate(F.col("element"), gate_seed, gate_kind) <= threshold(rate))
    long_name = F.octet_length("chrom") + len(sep) + 20 > 64
    fixed = max(1, round(1 / rate))
    # One row per chromosome name; the optimiser broadcasts it where it is small.
    dimension = chromosome_strides(intervals, rate, gate_seed, gate_kind)
    first = F.col("start") + F.pmod(F.col("residue") - F.col("start"), F.col("stride"))
    strided = (
        intervals.where("start < end")
        .join(dimension, "chrom")
        .withColumn("x", F.when(long_name, F.col("start")).otherwise(first))
        .withColumn("s", F.when(long_name, F.lit(fixed).cast("bigint")).otherwise(F.col("stride")))
        .where("x < end")
    )
    kept = F.explode(F.when(F.col("x") < F.col("end"), F.sequence(F.col("x"), F.greatest("x", F.col("end") - 1), "s")).otherwise(F.array().cast("array<bigint>")))
    return strided.select(*keys, "chrom", kept.alias("position")).select(*keys, point_text(F.col("position"), sep).alias("element"))


def counters(
    intervals: DataFrame, keys: Sequence[str], interval_rate: float = 1.0, point_rate: float = 1.0, sep: str = SEPARATOR,
    gate_seed: int = GATE_SEED, gate_kind: str = "xxh32",
) -> DataFrame:
    """(keys, n_intervals, kept_intervals, n_points, sampled_points): what modes A to C take of each key, repeated
    intervals and positions counted as often as they occur; points are sampled by mixed strides, whose numbers
    follow from the intervals' ends."""
    checked_rate(interval_rate, "rate")
    checked_rate(point_rate, "rate")
    rows = intervals.where("start < end")
    kept = F.lit(True) if interval_rate >= 1.0 else gate(interval_text(sep), gate_seed, gate_kind) <= threshold(interval_rate)
    n = F.col("end") - F.col("start")
    sampled = n if point_rate >= 1.0 else F.lit(0).cast("bigint")
    if 0.0 < point_rate < 1.0:
        rows = rows.join(chromosome_strides(intervals, point_rate, gate_seed, gate_kind), "chrom")
        first = F.col("start") + F.pmod(F.col("residue") - F.col("start"), F.col("stride"))
        sampled = F.when(first < F.col("end"), F.floor((F.col("end") - 1 - first) / F.col("stride")) + 1).otherwise(0)
        long_name, step = F.octet_length("chrom") + len(sep) + 20 > 64, max(1, round(1 / point_rate))
        sampled = F.when(long_name, F.floor((n - 1) / step) + 1).otherwise(sampled)
    return rows.select(*keys, kept.alias("kept"), n.alias("n"), sampled.cast("bigint").alias("sampled")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_intervals"), F.count_if("kept").alias("kept_intervals"), F.sum("n").alias("n_points"), F.sum("sampled").alias("sampled_points")
    )


def hybrid_elements(
    intervals: DataFrame, keys: Sequence[str], interval_rate: float = 1.0, point_rate: float = 1.0, exponent: float = 0.0,
    method: str = "mixed-stride", **options: object,
) -> DataFrame:
    """Mode C: both kinds.  The interval gate drops only the interval's own element, not its points."""
    shared = {k: v for k, v in options.items() if k in ("sep", "gate_seed", "gate_kind")}
    return interval_elements(intervals, keys, interval_rate, exponent, **shared).unionByName(
        point_elements(intervals, keys, point_rate, method, **options)
    )
