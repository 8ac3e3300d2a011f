"""Result files: names, columns and writers."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapse.operators.pairwise import SHAPES
from overlapse.sources.files import ALIASES, ASSEMBLIES, located

#: Metric columns as they are headed in result files.
HEADINGS = {"containment_ab": "containment_AB", "containment_ba": "containment_BA"}


def result_name(
    prefix: str, mode: str, precision: int, shape: str = "ie", interval_rate: float = 1.0, point_rate: float = 1.0,
    exponent: float = 0.0, k: int = 8, w: int = 40,
) -> str:
    """A result's name without suffix: sketch, precision, mode, sampling, k and w, shape.

    Rates have two decimals, point rates below 0.01 four, so that small ones stay apart.
    """
    parts = [prefix, "mnmzr" if mode == "D" else "hll", f"p{precision}", f"jacc{mode}"]
    if exponent > 0:
        parts.append(f"expA{exponent:.2f}")
    elif interval_rate != 1.0:
        parts.append(f"A{interval_rate:.2f}")
    if point_rate != 1.0:
        parts.append(f"B{point_rate:.{4 if point_rate < 0.01 else 2}f}")
    if mode == "D":
        parts += [f"k{k}", f"w{w}"]
    return "_".join([*parts, shape])


def reference_tag(spec: str) -> str:
    """A reference's short name for file names."""
    name = spec.strip().lower()
    name = ALIASES.get(name, name)
    if name in ASSEMBLIES:
        return name
    base = os.path.basename(spec.rstrip("/")).partition("?")[0]
    base = re.sub(r"(?i)\.gz$", "", base)
    base = re.sub(r"(?i)\.(fa|fasta|fna)$", "", base)
    return re.sub(r"[^\w.-]", "_", base) or "ref"


def result_table(
    pairs: DataFrame, mode: str, precision: int, shape: str = "ie", interval_rate: float = 1.0, point_rate: float = 1.0,
    exponent: float = 0.0, k: int = 8, w: int = 40, refs: tuple[str, str] = ("NA", "NA"),
) -> DataFrame:
    """The public columns of a result, from pairs with ord_1, ord_2, label_1, label_2 and metrics,
    in the order of the lists."""
    extra = {"subA": interval_rate, "subB": point_rate, "expA": exponent} if mode == "C" else {}
    return pairs.orderBy("ord_1", "ord_2").select(
        F.col("label_1").alias("file1"),
        F.col("label_2").alias("file2"),
        F.lit("minimizer" if mode == "D" else "hyperloglog").alias("sketch_type"),
        F.lit(mode).alias("mode"),
        F.lit(precision).alias("precision"),
        F.lit("NA").alias("num_hashes"),
        F.lit(k).alias("kmer_size"),
        F.lit(w).alias("window_size"),
        *(F.lit(v).alias(c) for c, v in extra.items()),
        *(F.col(m).alias(HEADINGS.get(m, m)) for m in SHAPES[shape]),
        *([F.lit(refs[0]).alias("ref1"), F.lit(refs[1]).alias("ref2")] if mode == "D" else []),
    )


def query_table(pairs: DataFrame, shape: str = "ie") -> DataFrame:
    """The narrow form of a result: query, reference and the metrics, in the order of the lists."""
    names = [F.col("label_1").alias("query"), F.col("label_2").alias("reference")]
    return pairs.orderBy("ord_1", "ord_2").select(*names, *(F.col(m).alias(HEADINGS.get(m, m)) for m in SHAPES[shape]))


def write_result(table: DataFrame, path: str, form: str = "csv") -> None:
    """Writes a folder of part files that follow each other in the result's order: ``csv``, ``tsv`` or ``query-tsv``
    with a header each, or ``parquet``."""
    path = located(table.sparkSession, path)
    if form == "parquet":
        table.write.mode("overwrite").parquet(path)
    else:
        table.write.mode("overwrite").option("header", True).option("sep", "," if form == "csv" else "\t").csv(path)


def read_results(rows: DataFrame) -> DataFrame:
    """Results under their present names: ``jaccard_similarity`` of old files is ``reg_eq_similarity``."""
    if "reg_eq_similarity" in rows.columns:
        return rows
    return rows.withColumnRenamed("jaccard_similarity", "reg_eq_similarity") if "jaccard_similarity" in rows.columns else rows.withColumn("reg_eq_similarity", F.lit(None).cast("double"))


def matrix_rows(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(item, one column per name): the symmetric matrix in wide form, both directions averaged, 1 on
    the diagonal.  No item may be called ``item``."""
    if "item" in columns:
        raise ValueError("an item's name clashes with the result's own column: item")
    both = pairs.select("a", "b", "similarity").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    wide = both.where("a <> b").groupBy("a").pivot("b", list(columns)).agg(F.avg("similarity"))
    placed = wide.toDF("item", *(f"c{i}" for i in range(len(columns))))
    return placed.select("item", *(F.when(F.col("item") == c, 1.0).otherwise(F.col(f"c{i}")).alias(c) for i, c in enumerate(columns)))
