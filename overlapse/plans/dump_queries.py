"""Result files of ``run_dumps`` (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.plans.session import load, written
from overlapse.sources.drift import changes, consistent, distinct_columns, held_beside, name_classes, numeric_names, path_values, type_statistics


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = changes(load(spark, sf_dir, "run_dumps"), "dump_id", "feed_name", "written_at", "body", ["file1", "file2"])
    return found.select(F.col("id").alias("dump_id"), F.col("name").alias("field_name"), F.col("kind").alias("change_kind")).distinct()


def p2_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_found(spark, sf_dir).groupBy("field_name", "change_kind").agg(F.count(F.lit(1)).alias("n_dumps"))


def p2_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judged type of each column of each file, with its number of values."""
    dumps = load(spark, sf_dir, "run_dumps").dropDuplicates(["dump_id"])
    return type_statistics(path_values(dumps, "dump_id", "body")).withColumnRenamed("id", "dump_id")


PAIR = ("file1", "file2")


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of all files in one table, each column under one name whatever a file calls it.

    Every column of any file is there with its judged type, so mixed ones as text; these have their
    numbers in a second column, NAME_value.  Where a file holds two names of one column, the later one
    also has a column of its own.  ``failed_casts`` is a JSON list of the values that aren't in a
    column as its type.
    """
    dumps = load(spark, sf_dir, "run_dumps").dropDuplicates(["dump_id"])
    found = written(changes(dumps, "dump_id", "feed_name", "written_at", "body", list(PAIR)), "changes")
    rows = written(path_values(dumps, "dump_id", "body"), "rows")
    stats = written(type_statistics(rows), "types")
    classes = name_classes(found, stats)
    twice, numeric = held_beside(stats, classes), numeric_names(rows)
    wanted: list[tuple[str, str, list[str], list[str]]] = []
    for c, (kind, names) in classes.items():
        each = [(c, names, []), *((n, [n], names[:i]) for i, n in enumerate(names) if n in twice)]
        for name, own, others in each:
            wanted.append((name, kind, own, others))
            if kind == "string" and name not in PAIR and numeric & set(own):
                wanted.append((f"{name}_value", "double", own, others))
    labels = distinct_columns([w[0] for w in wanted], ["id", "dump_id", "row_no", "header", "values", "failed_casts", "failed_values"])
    columns = {label: (kind, own) for label, (_, kind, own, _) in zip(labels, wanted)}
    beside = {label: others for label, (_, _, _, others) in zip(labels, wanted) if others}
    table = consistent(rows, columns, beside).withColumnRenamed("id", "dump_id")
    failed = F.when(F.size("failed_values") > 0, F.to_json("failed_values")).otherwise("")
    return table.withColumn("failed_casts", failed).drop("failed_values")


QUERIES = {"p2_found": p2_found, "p2_change_counts": p2_change_counts, "p2_types": p2_types, "p2_table": p2_table}

_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
_BARE = f"""list_transform(list_transform(list_transform({{0}}, lambda x: trim(replace(x, chr(65279), ''), {_TRIM})),
 lambda x: CASE WHEN len(x) >= 2 AND x[1] IN (chr(34), chr(39)) AND x[1] = x[-1] THEN x[2:len(x) - 1] ELSE x END), lambda x: trim(x, {_TRIM}))"""
_PARSED = f"""
WITH d AS (SELECT dump_id, feed_name, written_at, replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS b FROM run_dumps),
l AS (SELECT dump_id, feed_name, written_at, list_filter(string_split(b, chr(10)), lambda x: trim(replace(x, chr(65279), '')) <> '') AS ls FROM d),
s AS (SELECT *, CASE WHEN contains(ls[1], chr(9)) THEN chr(9) WHEN contains(ls[1], ',') THEN ',' WHEN contains(ls[1], ';') THEN ';'
      WHEN contains(ls[1], '|') THEN '|' ELSE chr(9) END AS sep FROM l),
h AS (SELECT *, {_BARE.format("string_split(ls[1], sep)")} AS hd FROM s),
r AS (SELECT dump_id, hd, unnest(range(1, len(ls))) AS i, ls, sep FROM h),
c AS (SELECT dump_id, hd, i, {_BARE.format("string_split(ls[i + 1], sep)")} AS cells FROM r),
v AS (SELECT dump_id, i, unnest(hd) AS name, unnest(list_resize(cells, len(hd))) AS v FROM c)"""
_FOUND = (
    _PARSED
    + """,
t AS (SELECT dump_id, i, name, v, CASE WHEN v IS NULL OR v IN ('', 'NA') THEN NULL WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'integer'
      WHEN regexp_full_match(v, '[+-]?([0-9]+[.][0-9]*|[.][0-9]+|[0-9]+(?:[.][0-9]*)?[eE][+-]?[0-9]+)([eE][+-]?[0-9]+)?') THEN 'real'
      WHEN regexp_full_match(v, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)%') THEN 'percentage' ELSE 'text' END AS t FROM v),
k AS (SELECT dump_id, name, list_sort(list(DISTINCT t) FILTER (t IS NOT NULL)) AS ts FROM t GROUP BY ALL),
y AS (SELECT dump_id, name, CASE WHEN len(ts) = 1 THEN ts[1] WHEN ts = ['integer', 'real'] THEN 'real' WHEN len(ts) > 1 THEN 'text' END AS t FROM k),
ch AS (SELECT dump_id, lag(dump_id) OVER (PARTITION BY feed_name ORDER BY written_at, dump_id) AS prev FROM run_dumps),
nw AS (SELECT ch.dump_id, prev, name, t FROM ch JOIN y USING (dump_id) WHERE prev IS NOT NULL),
od AS (SELECT ch.dump_id, prev, name, t FROM ch JOIN y ON y.dump_id = prev),
gain AS (SELECT * FROM nw ANTI JOIN od USING (dump_id, name)), lost AS (SELECT * FROM od ANTI JOIN nw USING (dump_id, name)),
q AS (SELECT dump_id, i, name, CASE WHEN t IS NULL THEN NULL WHEN t = 'text' THEN v WHEN t = 'percentage' THEN printf('%.7e', CAST(rtrim(v, '%') AS DOUBLE) / 100)
      ELSE printf('%.7e', CAST(v AS DOUBLE)) END AS v FROM t),
key AS (SELECT dump_id, i, max(v) FILTER (name = 'file1') AS f1, max(v) FILTER (name = 'file2') AS f2 FROM v GROUP BY ALL),
m AS (SELECT g.dump_id, g.name, o.name AS gone, count(*) FILTER (a.v = b.v) AS eq, count(*) FILTER (a.v <> b.v) AS ne
      FROM gain g JOIN lost o ON o.dump_id = g.dump_id JOIN key x ON x.dump_id = g.dump_id JOIN key z ON z.dump_id = g.prev AND z.f1 = x.f1 AND z.f2 = x.f2
      JOIN q a ON a.dump_id = g.dump_id AND a.i = x.i AND a.name = g.name JOIN q b ON b.dump_id = g.prev AND b.i = z.i AND b.name = o.name
      GROUP BY ALL HAVING count(*) FILTER (a.v = b.v) > 0 AND count(*) FILTER (a.v <> b.v) = 0),
w AS (SELECT *, row_number() OVER (PARTITION BY dump_id, name ORDER BY eq DESC, gone) AS p, row_number() OVER (PARTITION BY dump_id, gone ORDER BY eq DESC, name) AS r FROM m),
mt AS (SELECT dump_id, name, gone FROM w WHERE p = 1 AND r = 1),
f AS (SELECT dump_id, name AS field_name, 'renamed' AS change_kind FROM mt
UNION ALL SELECT dump_id, name, 'added' FROM gain ANTI JOIN mt USING (dump_id, name)
UNION ALL SELECT lost.dump_id, lost.name, 'removed' FROM lost ANTI JOIN mt ON mt.dump_id = lost.dump_id AND mt.gone = lost.name
UNION ALL SELECT nw.dump_id, nw.name, 'type_changed' FROM nw JOIN od ON od.dump_id = nw.dump_id AND od.name = nw.name WHERE nw.t <> od.t)
"""
)


SQL = {
    "p2_types": _FOUND.replace("k AS (SELECT dump_id, name,", "k AS (SELECT dump_id, name, count(t) AS n_values,").replace("y AS (SELECT dump_id, name,", "y AS (SELECT dump_id, name, n_values,")
    + "SELECT dump_id, name, t AS type, n_values FROM y",
    "p2_found": _FOUND + "SELECT * FROM f",
    "p2_change_counts": _FOUND + "SELECT field_name, change_kind, count(*) AS n_dumps FROM f GROUP BY ALL",
}
