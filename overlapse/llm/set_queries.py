"""Set overlaps (problem 5) and distinct counts (problem 6) over ``intervals``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.llm import distinct as D
from overlapse.llm.bottomk import K, SPAN, at_least, distinct_elements, indexed, overlaps
from overlapse.plans.hash_sql import xxh64
from overlapse.plans.session import load, written

LEAST = 0.3
RECORD = ["chrom", "start_pos", "end_pos"]


def valid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "intervals")
    return rows.where("file_id is not null and chrom is not null and start_pos >= 0 and end_pos > start_pos")


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(distinct_elements(valid_records(spark, sf_dir), "file_id", RECORD), "elements")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_least(_elements(spark, sf_dir), LEAST).select(
        F.least("set_1", "set_2").alias("file_id_1"), F.greatest("set_1", "set_2").alias("file_id_2")
    )


def p5_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated shared records and both containments of every pair whose sketches meet in a hash.

    The bound of ``p5_found`` doesn't hold here.  Of sets of fewer than 2 k records the sketch is the whole set,
    so all their overlaps are there; of a larger smaller set, k hashes show an overlap of a share c with
    probability 1 - (1 - c)^k: 95 % from c = 3 / k = 0.003 on.
    """
    found = overlaps(indexed(_elements(spark, sf_dir)), 0.0).withColumnsRenamed({"set_1": "file_id_1", "set_2": "file_id_2"})
    return found.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes))


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid records with load day, tissue, mark and the file's precision."""
    files = load(spark, sf_dir, "bed_files").select("file_id", "sample_id", "sketch_precision")
    mark = F.upper(F.regexp_replace("mark", "[^A-Za-z0-9]", ""))
    samples = load(spark, sf_dir, "sample_meta").select("sample_id", "tissue", mark.alias("mark"))
    known = files.join(samples, "sample_id").where("tissue is not null").select("file_id", "tissue", "mark", "sketch_precision")
    day = F.date_format("loaded_at", "yyyy-MM-dd").alias("load_day")
    rows = valid_records(spark, sf_dir).where("loaded_at is not null").select("file_id", day, "chrom", "start_pos")
    return rows.join(known, "file_id").select("load_day", "tissue", "mark", "sketch_precision", "chrom", "start_pos")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["load_day", "tissue"]
    rows = _sampled(spark, sf_dir)
    sketches = D.registers(rows, by, ["chrom", "start_pos"], "sketch_precision")
    est = written(D.estimates(sketches, by, z=4.5), "estimates")
    bound = F.col("n_rows") / 2
    clear = est.where(F.col("high") < bound).select(*by)
    close = est.where((F.col("high") >= bound) & (F.col("low") < bound)).select(*by, "n_rows")
    counted = (
        rows.join(close, by)
        .groupBy(*by, "n_rows")
        .agg(F.countDistinct("chrom", "start_pos").alias("exact"))
        .where(F.col("exact") < F.col("n_rows") / 2)
        .select(*by)
    )
    return clear.unionByName(counted)


def p6_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct positions of every combination of load day, tissue and mark, with 95 % bounds."""
    by = ["load_day", "tissue", "mark"]
    sketches = written(D.registers(_sampled(spark, sf_dir), by, ["chrom", "start_pos"], "sketch_precision"), "sketches")
    return D.estimates(D.combinations(sketches, by), [*by, "left_out"]).withColumnRenamed("p", "sketch_precision")


_VALID = "chrom IS NOT NULL AND start_pos >= 0 AND end_pos > start_pos AND file_id IS NOT NULL"
# Layers are the leading zeros of the 63-bit hash; a set's level the highest layer with k hashes in it and above.
_SKETCHED = f"""WITH v AS (SELECT DISTINCT file_id, chrom, start_pos, end_pos FROM intervals WHERE {_VALID}),
e AS (SELECT file_id AS s, CAST({xxh64("chrom", "start_pos", "end_pos")} >> 1 AS BIGINT) AS h FROM v),
l AS (SELECT s, h, CASE WHEN h = 0 THEN 63 ELSE 63 - length(ltrim(bin(h), '0')) END AS j FROM e),
g AS (SELECT s, j, count(*) AS n, max(h) AS last FROM l GROUP BY ALL),
up AS (SELECT s, j, sum(n) OVER (PARTITION BY s ORDER BY j DESC) AS n FROM g),
z AS (SELECT s, sum(n) AS n, coalesce(max(j) FILTER (un >= {K}), 0) AS lv FROM (SELECT g.*, up.n AS un FROM g JOIN up USING (s, j)) GROUP BY s),
m AS (SELECT a.s AS s1, b.s AS s2, x.n AS n1, y.n AS n2, x.lv, count(*) AS met FROM l a JOIN l b USING (h) JOIN z x ON x.s = a.s JOIN z y ON y.s = b.s
      WHERE a.j >= x.lv AND (x.n < y.n OR (x.n = y.n AND a.s < b.s)) GROUP BY ALL),
b AS (SELECT m.*, (SELECT sum(n) FROM g WHERE s = s1 AND j >= lv) + (SELECT sum(n) FROM g WHERE s = s2 AND j >= lv) - met AS merged,
      greatest((SELECT max(last) FROM g WHERE s = s1 AND j >= lv), (SELECT max(last) FROM g WHERE s = s2 AND j >= lv)) AS last FROM m),
u AS (SELECT *, met / merged AS jaccard, CASE WHEN lv = 0 THEN merged::DOUBLE ELSE (merged - 1) / ((last + 1) / {float(SPAN)!r}) END AS union_size FROM b)
SELECT s1 AS file_id_1, s2 AS file_id_2, n1::BIGINT AS n_1, n2::BIGINT AS n_2, merged::BIGINT AS merged, round(jaccard * union_size, 6) AS shared,
 round(union_size, 6) AS union_size, round(jaccard, 6) AS jaccard, round(jaccard * union_size / n1, 6) AS containment_12, round(jaccard * union_size / n2, 6) AS containment_21,
 round((sqrt(jaccard * (1 - jaccard) / merged + jaccard * jaccard / merged) + 0.5 / merged) * union_size * sqrt(1 - 0.5 ^ lv) / n1, 6) AS error FROM u"""
SQL = {
    "p5_overlaps": _SKETCHED,
    "p5_found": f"""
WITH v AS (SELECT DISTINCT file_id, chrom, start_pos, end_pos FROM intervals WHERE {_VALID}),
n AS (SELECT file_id, count(*) AS n FROM v GROUP BY file_id),
s AS (SELECT a.file_id AS file_id_1, b.file_id AS file_id_2, count(*) AS c FROM v a
      JOIN v b USING (chrom, start_pos, end_pos) WHERE a.file_id < b.file_id GROUP BY ALL)
SELECT file_id_1, file_id_2 FROM s JOIN n x ON x.file_id = file_id_1 JOIN n y ON y.file_id = file_id_2
WHERE c >= 0.3 * least(x.n, y.n)""",
    "p6_found": f"""
SELECT strftime(loaded_at, '%Y-%m-%d') AS load_day, tissue FROM intervals JOIN bed_files USING (file_id)
JOIN sample_meta USING (sample_id) WHERE {_VALID} AND tissue IS NOT NULL AND loaded_at IS NOT NULL
GROUP BY ALL HAVING count(DISTINCT (chrom, start_pos)) < 0.5 * count(*)""",
}
QUERIES = {"p5_found": p5_found, "p5_overlaps": p5_overlaps, "p6_found": p6_found, "p6_combinations": p6_combinations}
