"""Overlap and similarity of large collections of sets, expressed as Spark jobs.

Sub-packages: ``sources`` (readers and writers), ``functions`` (column expressions and
estimators), ``operators`` (DataFrame in, DataFrame out), ``streaming`` (stateful operators),
``plans`` (sessions, checkpoints, registered queries).  ``llm`` is optional and self-contained.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

__version__ = "0.1.0"


def sketch(intervals: DataFrame, keys: Sequence[str], precision: int = 18, mode: str = "B", **options: object) -> DataFrame:
    """(keys, sketch): one dense sketch per set of intervals (keys, chrom, start, end); options are those of the
    mode's elements, and ``seed``."""
    from overlapse.operators import elements, registers

    if mode == "B" and not options.keys() - {"seed"}:
        return registers.point_sketches(intervals, keys, precision, **options)
    made = {"A": elements.interval_elements, "B": elements.point_elements, "C": elements.hybrid_elements}[mode]
    seed = options.get("seed", registers.SEED)
    of = made(intervals, keys, **{k: v for k, v in options.items() if mode != "A" or k != "seed"})
    return registers.dense(registers.registers(of, keys, precision, seed=seed), keys, precision)


def pairwise(queries: DataFrame, references: DataFrame, keys: Sequence[str], precision: int = 18, shape: str = "full") -> DataFrame:
    """The metrics of every query sketch with every reference sketch; both should be written tables."""
    from overlapse.operators import pairwise as P

    found = P.dense_pairs(queries, references, keys, precision, shape=shape)
    return P.shaped(found, shape, [f"{k}_{i}" for i in (1, 2) for k in keys])


def cardinalities(sketches: DataFrame, keys: Sequence[str], precision: int = 18) -> DataFrame:
    """(keys, cardinality) of dense sketches."""
    from overlapse.operators import registers

    return registers.cardinality(registers.sparse(sketches, keys), keys, precision, every=sketches)
