"""Cardinality from HyperLogLog register histograms: Ertl's improved raw estimator and its fallback,
as a Column expression and for numpy, in the same order of operations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 64
ALPHA_INF = 1 / (2 * math.log(2))
TINY = 1e-10


def alpha(m: int, bits: int = 64) -> float:
    """Bias constant of the classical estimator, which steps in where every register is full."""
    wide = bits > 32
    # Fixed values.
    table = {1 << 14: 0.351, 1 << 15: 0.532, 1 << 16: 0.625} if wide else {16: 0.673, 32: 0.697, 64: 0.709}
    return table.get(m, 0.7213 / (1 + 1.079 / m) * (0.85 if wide else 1.0))


def _sigma(x: Column) -> Column:
    """x + sum of x^(2^k) 2^(k-1), iterated to where doubles no longer change."""
    start = F.struct(x.alias("x"), F.lit(1.0).alias("y"), x.alias("z"))
    step = lambda a, _: F.struct((a["x"] * a["x"]).alias("x"), (a["y"] + a["y"]).alias("y"), (a["z"] + a["x"] * a["x"] * a["y"]).alias("z"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["z"]


def _tau(x: Column) -> Column:
    """(1 - x - sum of (1 - x^(2^-k))^2 2^-k) / 3; by the reference's convergence test, which
    compares the first partial sum with x itself, the series is not entered at x = 0.5."""
    start = F.struct(x.alias("x"), F.lit(1.0).alias("y"), (1 - x).alias("z"))

    def step(a: Column, _: Column) -> Column:
        r, h = F.sqrt(a["x"]), a["y"] * 0.5
        return F.struct(r.alias("x"), h.alias("y"), (a["z"] - (1 - r) * (1 - r) * h).alias("z"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["z"] / 3
    return F.when((x == 0) | (x == 1), 0.0).when(x == 0.5, (1 - x) / 3).otherwise(series)


def cardinality(counts: Column, precision: int, bits: int = 64) -> Column:
    """Distinct elements from ``counts``: registers holding 0, 1, ..., q + 1, where q = bits - p."""
    m, q = float(1 << precision), bits - precision
    at = lambda k: F.get(counts, F.lit(k)).cast("double")
    top = m * _tau((m - at(q + 1)) / m)
    middle = F.aggregate(F.reverse(F.slice(counts, 2, q)), top, lambda z, c: (z + c.cast("double")) * 0.5)
    z = middle + m * _sigma(at(0) / m)
    powers = F.aggregate(F.reverse(counts), F.lit(0.0), lambda s, c: s * 0.5 + c.cast("double"))
    return F.when(at(0) == m, 0.0).when(z < TINY, alpha(1 << precision, bits) * m * m / powers).otherwise(ALPHA_INF * m * m / z)


def cardinalities(counts: np.ndarray, precision: int, bits: int = 64) -> np.ndarray:
    """``cardinality`` of each row of a matrix of counts."""
    m, q = float(1 << precision), bits - precision
    c = counts.astype(np.float64)
    x = (m - c[:, q + 1]) / m
    z, y, r = 1 - x, 1.0, x.copy()
    for _ in range(STEPS):
        r = np.sqrt(r)
        y *= 0.5
        z = z - (1 - r) * (1 - r) * y
    tau = np.where((x == 0) | (x == 1), 0.0, np.where(x == 0.5, (1 - x) / 3, z / 3))
    z = m * tau
    for k in range(q, 0, -1):
        z = (z + c[:, k]) * 0.5
    s = c[:, 0] / m
    r, y, sigma = s.copy(), 1.0, s.copy()
    with np.errstate(over="ignore", invalid="ignore"):
        for _ in range(STEPS):
            r = r * r
            sigma = sigma + r * y
            y += y
        z = z + m * sigma
        powers = c @ np.power(2.0, -np.arange(c.shape[1]))
        out = np.where(z < TINY, alpha(1 << precision, bits) * m * m / powers, ALPHA_INF * m * m / np.where(z == 0, 1, z))
    return np.where(c[:, 0] == m, 0.0, out)
