"""``pair_results`` against its copy ``pair_mirror`` (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.operators.reconcile import compare_copies
from overlapse.plans.session import load

KEYS = ["run_id", "file1", "file2"]
FIELDS = ["sketch_mode", "sketch_precision", "reg_eq_similarity", "jaccard_similarity_ie", "containment_ab", "containment_ba"]


def base_name(path: Column) -> Column:
    """The last element of a path; a trailing slash doesn't count."""
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [
        load(spark, sf_dir, t).select("run_id", base_name(F.col("file1")).alias("file1"), base_name(F.col("file2")).alias("file2"), *FIELDS)
        for t in ("pair_results", "pair_mirror")
    ]
    return compare_copies(*sides, KEYS, FIELDS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (
        F.when(F.col("status") == "left_only", F.array(F.lit("missing_in_mirror")))
        .when(F.col("status") == "right_only", F.array(F.lit("missing_in_results")))
        .otherwise(F.col("differences.field"))
    )
    return _compared(spark, sf_dir).where("status <> 'same'").select(*KEYS, F.explode(names).alias("diff_field"))


def p3_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows and how many differences of each field."""
    return (
        p3_found(spark, sf_dir).groupBy("diff_field").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("run_id").alias("n_runs"))
    )


_FOUND = """
WITH l AS (SELECT run_id, regexp_extract(file1, '[^/]*$') AS file1, regexp_extract(file2, '[^/]*$') AS file2,
                  max(sketch_mode) AS m, max(sketch_precision) AS p, max(reg_eq_similarity) AS r,
                  max(jaccard_similarity_ie) AS j, max(containment_ab) AS ab, max(containment_ba) AS ba
           FROM pair_results GROUP BY ALL),
r AS (SELECT run_id, regexp_extract(file1, '[^/]*$') AS file1, regexp_extract(file2, '[^/]*$') AS file2,
             max(sketch_mode) AS m, max(sketch_precision) AS p, max(reg_eq_similarity) AS r,
             max(jaccard_similarity_ie) AS j, max(containment_ab) AS ab, max(containment_ba) AS ba
      FROM pair_mirror GROUP BY ALL),
b AS (SELECT run_id, file1, file2, l.m AS lm, r.m AS rm, l.p AS lp, r.p AS rp, l.r AS lr, r.r AS rr,
             l.j AS lj, r.j AS rj, l.ab AS lab, r.ab AS rab, l.ba AS lba, r.ba AS rba
      FROM l JOIN r USING (run_id, file1, file2)),
f AS (
SELECT run_id, file1, file2, 'missing_in_mirror' AS diff_field FROM l ANTI JOIN r USING (run_id, file1, file2)
UNION ALL SELECT run_id, file1, file2, 'missing_in_results' FROM r ANTI JOIN l USING (run_id, file1, file2)
UNION ALL SELECT run_id, file1, file2, 'sketch_mode' FROM b WHERE lm IS DISTINCT FROM rm
UNION ALL SELECT run_id, file1, file2, 'sketch_precision' FROM b WHERE lp IS DISTINCT FROM rp
UNION ALL SELECT run_id, file1, file2, 'reg_eq_similarity' FROM b WHERE (lr IS NULL) <> (rr IS NULL) OR abs(lr - rr) > 1e-9
UNION ALL SELECT run_id, file1, file2, 'jaccard_similarity_ie' FROM b WHERE (lj IS NULL) <> (rj IS NULL) OR abs(lj - rj) > 1e-9
UNION ALL SELECT run_id, file1, file2, 'containment_ab' FROM b WHERE (lab IS NULL) <> (rab IS NULL) OR abs(lab - rab) > 1e-9
UNION ALL SELECT run_id, file1, file2, 'containment_ba' FROM b WHERE (lba IS NULL) <> (rba IS NULL) OR abs(lba - rba) > 1e-9)
"""

SQL = {
    "p3_found": _FOUND + "SELECT * FROM f",
    "p3_differences": _FOUND + "SELECT diff_field, count(*) AS n_rows, count(DISTINCT run_id) AS n_runs FROM f GROUP BY diff_field",
}
QUERIES = {"p3_found": p3_found, "p3_differences": p3_differences}
