"""Differences between two copies of a table, row by row and field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.FloatType, T.DoubleType)


def _text(c: Column) -> Column:
    return c.cast("string")


def _differs(a: Column, b: Column, kind: T.DataType, tolerance: float) -> Column:
    if not isinstance(kind, FLOATS):
        return ~a.eqNullSafe(b)
    # NaN equals NaN and an infinity itself; either against anything else differs.
    odd = F.isnan(a) | F.isnan(b) | (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    close = F.when(odd, a == b).otherwise(F.abs(a - b) <= tolerance)
    return F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).otherwise(~close)


def _stand_in(kind: str) -> Column:
    """A value of the type, for null keys."""
    special = {"boolean": "false", "date": "1970-01-01", "timestamp": "1970-01-01", "timestamp_ntz": "1970-01-01"}
    text = special.get(kind, "" if kind in ("string", "binary") else "0")
    return F.lit(text).cast(kind)


def _side(df: DataFrame, keys: Sequence[str], fields: Sequence[str], tag: str) -> DataFrame:
    """One row per key.  A key is kept as value and null flag, so that plain equality is null-safe
    and the grouping's partitioning serves the join as well."""
    kinds = dict(df.dtypes)
    flat = df.select(
        *(F.coalesce(F.col(k), _stand_in(kinds[k])).alias(f"_k{i}") for i, k in enumerate(keys)),
        F.concat(*(F.when(F.col(k).isNull(), "1").otherwise("0") for k in keys)).alias("_nulls"),
        *(F.col(f).alias(f"{tag}{j}") for j, f in enumerate(fields)),
    )
    by = [*(f"_k{i}" for i in range(len(keys))), "_nulls"]
    return flat.groupBy(*by).agg(
        *(F.max(f"{tag}{j}").alias(f"{tag}{j}") for j in range(len(fields))), F.count(F.lit(1)).alias(f"{tag}_rows")
    )


def compare_copies(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    tolerance: float = 1e-9,
) -> DataFrame:
    """Keys, ``status`` (``left_only``, ``right_only``, ``changed``, ``same``) and ``differences``:
    an array of (field, left_value, right_value), empty unless both sides have the key.

    * A null key value equals a null; doubles differ when more than ``tolerance`` apart, NaN equals
      NaN, and null differs from every value.
    * Repeated keys on a side count once: of rows that differ, the largest non-null value of each
      field stands for the key (``left_rows`` and ``right_rows`` tell how many there were).
    * Columns other than keys and fields are ignored on both sides, so they may clash or be missing.
    * An empty side leaves every key of the other one as ``left_only`` or ``right_only``.

    Two aggregations and a full outer join share one hash partitioning by key.
    """
    clash = {"status", "differences", "left_rows", "right_rows"} & {*keys}
    if clash:
        raise ValueError(f"key columns clash with the result's own: {sorted(clash)}")
    by = [*(f"_k{i}" for i in range(len(keys))), "_nulls"]
    both = _side(left, keys, fields, "l").join(_side(right, keys, fields, "r"), by, "full_outer")
    diffs = [
        F.when(
            _differs(F.col(f"l{j}"), F.col(f"r{j}"), left.schema[f].dataType, tolerance),
            F.struct(F.lit(f).alias("field"), _text(F.col(f"l{j}")).alias("left_value"), _text(F.col(f"r{j}")).alias("right_value")),
        )
        for j, f in enumerate(fields)
    ]
    in_both = F.col("l_rows").isNotNull() & F.col("r_rows").isNotNull()
    none = F.array().cast("array<struct<field:string,left_value:string,right_value:string>>")
    found = both.withColumn("differences", F.when(in_both, F.filter(F.array(*diffs), lambda d: d.isNotNull())).otherwise(none))
    status = (
        F.when(F.col("r_rows").isNull(), "left_only")
        .when(F.col("l_rows").isNull(), "right_only")
        .when(F.size("differences") > 0, "changed")
        .otherwise("same")
    )
    return found.select(
        *(F.when(F.substring("_nulls", i + 1, 1) == "0", F.col(f"_k{i}")).alias(k) for i, k in enumerate(keys)),
        status.alias("status"),
        "differences",
        F.coalesce("l_rows", F.lit(0)).alias("left_rows"),
        F.coalesce("r_rows", F.lit(0)).alias("right_rows"),
    )
