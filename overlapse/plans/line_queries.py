"""Raw lines: rows that fail to parse (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.plans.session import load
from overlapse.sources.delimited import faults, records


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults(load(spark, sf_dir, "bed_lines")).select("line_id", "fault")


def p7_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that load."""
    return records(load(spark, sf_dir, "bed_lines")).select(
        "line_id", "chrom", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "name", "score", "strand"
    )


CHECKED = r"""
WITH t AS (SELECT line_id, rtrim(line_text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS line FROM bed_lines
           WHERE line_text IS NOT NULL),
k AS (SELECT line_id, line, regexp_full_match(line, '([^"\t]*|"([^"]|"")*")(\t([^"\t]*|"([^"]|"")*"))*', 's') AS quoted,
             regexp_extract_all(chr(9) || line, '\t("(?:[^"]|"")*"|[^"\t]*)', 1) AS f
      FROM t WHERE line <> '' AND NOT regexp_matches(line, '^(#|@|track|browser)')),
u AS (SELECT line_id, quoted, len(f) AS n,
             list_transform(f, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:len(x) - 1], '""', '"') ELSE x END) AS f FROM k),
c AS (SELECT line_id, f, CASE WHEN NOT quoted THEN 'quoting' WHEN n <> 6 THEN 'columns'
        WHEN trim(f[1]) = '' THEN 'values'
        WHEN NOT regexp_full_match(f[2], '[+-]?[0-9]+') OR NOT regexp_full_match(f[3], '[+-]?[0-9]+') THEN 'values'
        WHEN try_cast(f[2] AS BIGINT) IS NULL OR try_cast(f[3] AS BIGINT) IS NULL THEN 'values'
        WHEN try_cast(f[2] AS BIGINT) < 0 OR try_cast(f[3] AS BIGINT) <= try_cast(f[2] AS BIGINT) THEN 'values' END AS fault FROM u)
"""
SQL = {
    "p7_found": CHECKED + "SELECT line_id, fault FROM c WHERE fault IS NOT NULL",
    "p7_loaded": CHECKED
    + """SELECT line_id, f[1] AS chrom, CAST(f[2] AS BIGINT) AS start_pos, CAST(f[3] AS BIGINT) AS end_pos,
                f[4] AS name, f[5] AS score, f[6] AS strand FROM c WHERE fault IS NULL""",
}
QUERIES = {"p7_found": p7_found, "p7_loaded": p7_loaded}
