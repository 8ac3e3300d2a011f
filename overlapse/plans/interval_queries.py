"""Queries on ``intervals``: covered periods and gaps (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.plans.session import load
from overlapse.streaming.coverage import ROWS_PER_SHARD, SHARDS, gaps, periods, run_to_table, valid_interval


def interval_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the valid records as (entity, start, end); entity is ``file_id:chrom``."""
    schema = load(spark, sf_dir, "intervals").schema
    # A pattern, because the stream source takes a single file only as a match of one.
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/intervals.parquet*")
    ok = F.col("file_id").isNotNull() & valid_interval(F.col("chrom"), F.col("start_pos"), F.col("end_pos"))
    return rows.where(ok).select(
        F.concat_ws(":", F.col("file_id").cast("string"), "chrom").alias("entity"),
        F.col("start_pos").alias("start"),
        F.col("end_pos").alias("end"),
    )


def _split_entity(df: DataFrame) -> DataFrame:
    at = F.instr("entity", ":")
    return df.withColumns(
        {
            "file_id": F.substring("entity", F.lit(1), at - 1).cast("bigint"),
            "chrom": F.substring("entity", at + 1, F.length("entity")),
        }
    )


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of all records; shards grow in number with the table, so each stays small."""
    rows = load(spark, sf_dir, "intervals").count()
    return run_to_table(interval_entities(spark, sf_dir), shards=max(SHARDS, rows // ROWS_PER_SHARD))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gaps(_covered(spark, sf_dir))
    return _split_entity(found).select("file_id", "chrom", "gap_start", "gap_end")


def p4_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods(_covered(spark, sf_dir))
    return _split_entity(found).select("file_id", "chrom", "period_start", "period_end")


_RUNS = """
WITH v AS (SELECT DISTINCT file_id, chrom, start_pos, end_pos FROM intervals
           WHERE file_id IS NOT NULL AND chrom IS NOT NULL AND start_pos >= 0 AND end_pos > start_pos),
r AS (SELECT *, max(end_pos) OVER (PARTITION BY file_id, chrom ORDER BY start_pos, end_pos
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_pos > reach THEN 1 ELSE 0 END)
                OVER (PARTITION BY file_id, chrom ORDER BY start_pos, end_pos
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM r)
"""

SQL = {
    "p4_found": _RUNS
    + "SELECT file_id, chrom, reach AS gap_start, start_pos AS gap_end FROM i WHERE start_pos > reach",
    "p4_periods": _RUNS
    + """SELECT file_id, chrom, min(start_pos) AS period_start, max(end_pos) AS period_end
         FROM i GROUP BY file_id, chrom, island""",
}

QUERIES = {"p4_found": p4_found, "p4_periods": p4_periods}
