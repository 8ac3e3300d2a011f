"""Distinct counts from registers of minimum exponential hash values.

Every element has an exponential hash value for each of 2^p registers, and a register keeps the minimum
over the set's elements.  With n distinct elements each register is exponential with rate n, so the sum over the
registers is gamma-distributed: (2^p - 1) / sum is an unbiased count, and chi-square quantiles over that sum
are its bounds, exact but for the quantile's approximation.  Registers merge by elementwise minimum.

An element's values are the arrivals of a race: exponential gaps of mean 1, each arrival at a register that
the hash draws.  The first arrival at a register, over 2^p, is exponential, and independent from register to
register.  An element drops out once its next arrival comes after every register's present value, so a set costs
about n + 2^p log 2^p arrivals instead of n 2^p.  The low p bits of an arrival's draw are its register, hence a
sketch of precision p folds into any lower one, where it equals what would have been built there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Precisions outside this range are moved to its nearer end, as documented bounds of the sketch.
LOWEST, HIGHEST = 4, 24
#: Rows of a group that one task sketches, sketches that one task merges, and arrivals drawn at least at once.
TASK_ROWS, TASK_SKETCHES, DRAWN = 250_000, 64, 1 << 17


def clamped(precision: Column) -> Column:
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), precision)).cast("int")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose results look random."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def race(h: np.ndarray, p: int) -> np.ndarray:
    """The 2^p registers of the elements with hashes ``h``; infinite for none."""
    m = 1 << p
    out = np.full(m, np.inf)
    seeds = _mixed(np.unique(h.view(np.uint64)))
    at, no, drawn_at_once = np.zeros(len(seeds)), 0, max(DRAWN, m // 4)
    while len(seeds):
        # Some arrivals of each element at a time: as many as its registers may still need.
        horizon = out.max()
        want = m * (p + 1) / len(seeds) if np.isinf(horizon) else horizon - at.min()
        count = int(min(max(1, want), max(1, drawn_at_once // len(seeds))))
        for lo in range(0, len(seeds), drawn_at_once):
            some = slice(lo, lo + drawn_at_once)
            with np.errstate(over="ignore"):
                key = seeds[some, None] + (no + np.arange(1, count + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            drawn = _mixed(key)
            # 40 bits for the gap, the low 24 for the register.
            gaps = -np.log1p(-((drawn >> np.uint64(24)) + 0.5) / float(1 << 40))
            arrivals = at[some, None] + np.cumsum(gaps, axis=1)
            np.minimum.at(out, (drawn & np.uint64(m - 1)).astype(np.int64).ravel(), arrivals.ravel())
            at[some] = arrivals[:, -1]
        no += count
        left = at < out.max()
        seeds, at = seeds[left], at[left]
    return out


def folded(registers: np.ndarray, p: int) -> np.ndarray:
    return registers.reshape(-1, 1 << p).min(axis=0)


def _table(key: Sequence[pa.Scalar], by: Sequence[str], kinds: Sequence[pa.DataType], p: int, rows: int, registers: np.ndarray) -> pa.Table:
    columns = [pa.array([k.as_py()], kind) for k, kind in zip(key, kinds)]
    columns += [pa.array([p], pa.int32()), pa.array([rows], pa.int64()), pa.array([registers], pa.list_(pa.float64()))]
    return pa.Table.from_arrays(columns, names=[*by, "p", "n_rows", "registers"])


def _schema(rows: DataFrame, by: Sequence[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "p int, n_rows long, registers array<double>"])


def registers(rows: DataFrame, by: Sequence[str], elements: Sequence[str], precision: str) -> DataFrame:
    """(*by, p, n_rows, registers): the sketch of each group, at the lowest precision that occurs in it.

    Repeated elements are counted before anything else; a group's elements are then spread over one task for
    each ``TASK_ROWS`` of its rows, and the partial sketches merged.  ``n_rows`` counts the group's rows, repeated ones included.  Null group values form
    groups of their own; null elements are values like others; a null precision is ignored, and a group that has
    no other gets the lowest.
    """
    flat = rows.select(*by, F.col(precision).alias("_p"), F.xxhash64(*elements).alias("_h"))
    sizes = flat.groupBy(*(F.col(c).alias(f"_g_{c}") for c in by)).agg(
        clamped(F.coalesce(F.min("_p"), F.lit(LOWEST))).alias("_lowest"), (F.expr(f"count(1) div {TASK_ROWS}") + 1).alias("_parts")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by] or [F.lit(True)]
    once = flat.groupBy(*by, "_h").agg(F.count(F.lit(1)).alias("_n"))
    near = once.join(sizes, same).select(*by, "_lowest", "_h", "_n", F.pmod(F.shiftrightunsigned("_h", 20), F.col("_parts")).alias("_part"))
    schema = _schema(rows, by)

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        p = table.column("_lowest")[0].as_py()
        kinds = [table.schema.field(c).type for c in by]
        return _table(key, by, kinds, p, pc.sum(table.column("_n")).as_py(), race(table.column("_h").to_numpy(), p))

    return merged(near.groupBy(*by, "_part").applyInArrow(sketch, schema), by)


def merged(partial: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merges sketches (of parts, finer groups, days or files) into groups ``by``, at the lowest precision that
    meets there.  A task takes a slice of a group's sketches first, then one takes the slices'."""
    schema = _schema(partial, by)

    def union(key: tuple, table: pa.Table) -> pa.Table:
        kinds = [table.schema.field(c).type for c in by]
        p = min(table.column("p").to_pylist())
        least = None
        for chunk in table.column("registers").chunks:
            for i in range(len(chunk)):
                own = folded(chunk[i].values.to_numpy(), p)
                least = own if least is None else np.minimum(least, own)
        return _table(key, by, kinds, p, sum(table.column("n_rows").to_pylist()), least)

    slice_ = F.pmod(F.xxhash64("p", "n_rows", F.get("registers", F.lit(0))), F.lit(TASK_SKETCHES))
    narrow = partial.select(*by, "p", "n_rows", "registers", slice_.alias("_slice"))
    once = narrow.groupBy(*by, "_slice").applyInArrow(union, schema)
    return once.groupBy(*by).applyInArrow(union, schema)


def _chi2(z: float, freedom: Column) -> Column:
    """Chi-square quantile at normal quantile z (cube of a normal)."""
    a = F.lit(2.0) / (F.lit(9.0) * freedom)
    return freedom * F.pow(F.greatest(F.lit(0.0), 1 - a + z * F.sqrt(a)), F.lit(3.0))


def estimates(sketches: DataFrame, by: Sequence[str], z: float = 1.96) -> DataFrame:
    """(*by, p, n_rows, n_distinct, low, high, error): counts with bounds at normal quantile ``z``.

    ``error`` is the relative standard error that the precision grants, 1 / sqrt(2^p - 2).
    """
    m = F.pow(F.lit(2.0), F.col("p"))
    # The race counts time in arrivals of one element, of which a register gets one in m.
    total = F.aggregate("registers", F.lit(0.0), lambda s, x: s + x) / m
    return sketches.withColumn("_sum", total).select(
        *by,
        "p",
        "n_rows",
        ((m - 1) / F.col("_sum")).alias("n_distinct"),
        (_chi2(-z, 2 * m) / (2 * F.col("_sum"))).alias("low"),
        (_chi2(z, 2 * m) / (2 * F.col("_sum"))).alias("high"),
        (1 / F.sqrt(m - 2)).alias("error"),
    )


def combinations(partial: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of every combination of the group columns, from the finest groups' sketches.

    A column that a combination leaves out is null, and bit i of ``left_out`` is set for it.
    """
    n = len(by)
    every = F.explode(F.array(*(F.lit(mask) for mask in range(1 << n)))).alias("left_out")
    wide = partial.select(*by, "p", "n_rows", "registers", every)
    spread = wide.select(
        *(F.when(F.col("left_out").bitwiseAND(1 << i) == 0, F.col(c)).alias(c) for i, c in enumerate(by)),
        "left_out", "p", "n_rows", "registers",
    )
    return merged(spread, [*by, "left_out"])
