"""Clusters of archive files from ``pair_results`` (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.llm import gridcluster as G
from overlapse.plans.session import load, written


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = load(spark, sf_dir, "bed_files").where("file_kind = 'archive'").select("label").distinct()
    rows = load(spark, sf_dir, "pair_results").select("file1", "file2", "sketch_precision", "reg_eq_similarity", "jaccard_similarity_ie")
    rows = rows.join(archive.withColumnRenamed("label", "file1"), "file1", "left_semi")
    rows = rows.join(archive.withColumnRenamed("label", "file2"), "file2", "left_semi")
    weight = F.pow(F.lit(2.0), F.coalesce("sketch_precision", F.lit(4)))
    pairs = G.measured(rows, "file1", "file2", "jaccard_similarity_ie", "reg_eq_similarity", weight)
    return G.clusters(G.near_pairs(written(pairs, "pairs")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = written(_members(spark, sf_dir).select("item", "cluster"), "members")
    one, two = m.withColumnRenamed("item", "file1"), m.withColumnRenamed("item", "file2")
    return one.join(two, "cluster").where("file1 < file2").select("file1", "file2")


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster with its size and most typical members."""
    return G.typical_members(_members(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters}

_NEAR = f"""WITH RECURSIVE ar AS (SELECT DISTINCT label FROM bed_files WHERE file_kind = 'archive'),
r AS (SELECT least(file1, file2) AS a, greatest(file1, file2) AS b, CASE WHEN isnan(jaccard_similarity_ie) THEN NULL ELSE jaccard_similarity_ie END AS v,
 CASE WHEN isnan(reg_eq_similarity) THEN NULL ELSE reg_eq_similarity END AS f, 2.0 ^ coalesce(sketch_precision, 4) AS w FROM pair_results
 WHERE file1 <> file2 AND file1 IN (FROM ar) AND file2 IN (FROM ar)),
p AS (SELECT a, b, sum(v * w) / sum(w) FILTER (v IS NOT NULL) AS v, sum(f * w) / sum(w) FILTER (f IS NOT NULL) AS f FROM r WHERE v IS NOT NULL OR f IS NOT NULL GROUP BY ALL),
q AS (SELECT a, b, v IS NULL AS k, coalesce(v, f) AS s FROM p),
c AS (SELECT k, CAST(floor(least(greatest(s, 0.0), 1.0 - 1e-9) / {G.WIDTH}) AS INT) AS lv, count(*) AS n FROM q GROUP BY ALL),
d AS (SELECT *, lag(lv) OVER (PARTITION BY k ORDER BY lv) AS below FROM (SELECT *, sum(n) OVER (PARTITION BY k) AS total FROM c) WHERE n >= {G.DENSE_SHARE} * total * {G.WIDTH}),
t AS (SELECT k, coalesce((arg_max(below, lv) + 1 + max(lv)) / 2 * {G.WIDTH}, CASE WHEN k THEN 0.45 ELSE 0.35 END) AS bound FROM d
 WHERE below IS NULL OR below < lv - 1 GROUP BY k),
e AS (SELECT a, b FROM q JOIN t USING (k) WHERE s >= bound),
m AS (SELECT a AS x, b AS z FROM e UNION ALL SELECT b, a FROM e), n AS (SELECT x, count(*) + 1 AS n FROM m GROUP BY x),
j AS (SELECT a, b, count(*) AS n FROM e JOIN m y ON y.x = a JOIN m z ON z.x = b AND z.z = y.z GROUP BY ALL),
one AS (SELECT e.a, e.b, coalesce(j.n, 0) + 2 AS n FROM e LEFT JOIN j USING (a, b) JOIN n x ON x.x = e.a JOIN n y ON y.x = e.b
 WHERE coalesce(j.n, 0) + 2 >= {G.DENSE} OR coalesce(j.n, 0) + 2 = least(x.n, y.n)),
m1 AS (SELECT x, count(*) + 1 AS n FROM (SELECT a AS x FROM one UNION ALL SELECT b FROM one) GROUP BY x),
two AS (SELECT a, b FROM one JOIN m1 x ON x.x = a JOIN m1 y ON y.x = b WHERE one.n >= {G.DENSE} OR one.n >= greatest(x.n, y.n) - 1),
g AS (SELECT a AS x, b AS y FROM two UNION ALL SELECT b, a FROM two),
reach AS (SELECT x, x AS y FROM g UNION SELECT reach.x, g.y FROM reach JOIN g ON g.x = reach.y),
named AS (SELECT x AS item, min(y) AS cluster FROM reach GROUP BY x)
"""
SQL: dict[str, str] = {
    "p1_found": _NEAR + "SELECT l.item AS file1, r.item AS file2 FROM named l JOIN named r USING (cluster) WHERE l.item < r.item",
    "p1_clusters": _NEAR
    + """, ranked AS (SELECT cluster, item, deg, row_number() OVER (PARTITION BY cluster ORDER BY deg DESC, item) AS i, count(*) OVER (PARTITION BY cluster) AS size
 FROM named JOIN (SELECT x AS item, count(*) AS deg FROM g GROUP BY x) USING (item))
SELECT cluster, size, max(deg) AS densest, string_agg(item, ',' ORDER BY i) FILTER (i <= 3) AS typical FROM ranked GROUP BY cluster, size""",
}
