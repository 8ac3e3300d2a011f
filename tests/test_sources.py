"""Faulty lines, drifting files and differing copies."""

import json

import pytest
from pyspark.sql import functions as F

from overlapse.operators.reconcile import compare_copies
from overlapse.plans.dump_queries import p2_table
from overlapse.sources import delimited as L
from overlapse.sources import drift as D

LINES = [
    ("chr1\t1\t2\tn\t0\t+", None),
    ('chr1\t1\t2\t"a\tb"\t0\t+  ', None),
    ('chr1\t1\t2\t"say ""x"""\t0\t+\r', None),
    ('chr1\t1\t2\t""\t0\t+', None),
    ('"chr1"\t"1"\t"2"\tn\t0\t.', None),
    ("chr1\t+1\t002\tn\t0\t+", None),
    ("#\"x", None), ("track\t1", None), ("browser", None), ("@run", None), ("", None), ("  \t ", None), (None, None),
    ('chr1\t1\t2\t"open\t0\t+', "quoting"),
    ('chr1\t1\t2\t"a"b\t0\t+', "quoting"),
    ('chr1\t1\t2\ta"b\t0\t+', "quoting"),
    ('"chr1\t1\t2', "quoting"),
    ("chr1\t1\t2\tn\t0", "columns"),
    ("chr1\t1\t2\tn\t0\t+\tx", "columns"),
    ("chr1 1 2 n 0 +", "columns"),
    ("\t1\t2\tn\t0\t+", "values"),
    (' \t1\t2\tn\t0\t+', "values"),
    ('" "\t1\t2\tn\t0\t+', "values"),
    ("c\t-1\t2\tn\t0\t+", "values"),
    ("c\t2\t2\tn\t0\t+", "values"),
    ("c\t1.0\t2\tn\t0\t+", "values"),
    ("c\t1\t99999999999999999999\tn\t0\t+", "values"),
    ("c\t1\t٣\tn\t0\t+", "values"),
    ("c\t\t2\tn\t0\t+", "values"),
    ("c\t 1\t2\tn\t0\t+", "values"),
    ("c\t1\t2\t" + "x" * 200_000 + "\t0\t+", None),
    ("c\t1\t2\t\"" + '""' * 60_000 + "\"\t0\t+", None),
    ("c\t1\t2\t\"" + '""' * 60_000 + "\t0\t+", "quoting"),
]


def test_faults_and_records(spark):
    rows = [(i, line, "x") for i, (line, _) in enumerate(LINES)] * 2
    table = spark.createDataFrame(rows, "line_id long, line_text string, chrom string")
    got = L.faults(table).select("line_id", "fault").collect()
    assert sorted(map(tuple, got)) == sorted((i, f) for i, (_, f) in enumerate(LINES) if f for _ in range(2))
    loaded = {r.line_id: r for r in L.records(table).collect()}
    assert sorted(loaded) == [0, 1, 2, 3, 4, 5, 30, 31]
    assert (loaded[1].name, loaded[2].name, loaded[3].name, loaded[5].start, loaded[5].end) == ("a\tb", 'say "x"', "", 1, 2)
    assert len(loaded[30].name) == 200_000 and len(loaded[31].name) == 60_000
    assert L.faults(table.limit(0)).count() == 0 == L.records(table.limit(0)).count()
    with pytest.raises(ValueError):
        L.parsed(table.withColumn("fault", F.lit(1)))


def test_what_the_reader_calls_corrupt_is_reclassified(spark):
    lenient = ["c\t1\t2\ta\"b\t0\t+", 'c\t1\t2\ta\t0\t"+', "c\t\t2\ta\t0\t+", "\t1\t2\ta\t0\t+", "c\t\u0661\t2\ta\t0\t+", "c\t-1\t2\ta\t0\t+", "c\t3\t3\ta\t0\t+"]
    corrupt = ["c\t1\t2", "c\tx\t2\ta\t0\t+", 'c\t1\t2\t"a\t0\t+', "c\t1\t99999999999999999999\ta\t0\t+", "c\t1.0\t2\ta\t0\t+", "c\t1\t2\ta\t0\t+\tx"]
    valid = ["c\t1\t2\té\t0\t+", '"c"\t"1"\t+2\t"a\tb"\t0\t+', "# a header\t1"]
    rows = L.parsed(spark.createDataFrame([(t,) for t in lenient + corrupt + valid], "line_text string")).collect()
    got = {r.line_text: (r.rec._corrupt, r.fault) for r in rows}
    assert all(got[t][0] is None for t in lenient) and all(got[t][0] == t for t in corrupt)
    assert [got[t][1] for t in lenient] == ["quoting"] * 2 + ["values"] * 5
    assert [got[t][1] for t in corrupt] == ["columns", "values", "quoting", "values", "values", "columns"] and all(got[t][1] is None for t in valid)


def dumps(spark, *bodies, feeds=None):
    rows = [(i, (feeds or ["f"] * len(bodies))[i], i, b, "x", "y") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "dump_id long, feed string, at long, body string, name string, kind string")


def found(table):
    rows = D.changes(table, "dump_id", "feed", "at", "body", ["file1", "file2"]).collect()
    return sorted((r.id, r.name, r.kind, r.was) for r in rows)


def test_changes_of_each_kind(spark):
    table = dumps(
        spark,
        "file1,file2,k,j,old\na,b,8,0.25,1\nc,d,9,0.50,2\n",
        '﻿"file2";"file1"; j ;k;fresh\r\nb;a;25.0%;8;7\r\nd;c;NA;9;8\r\n',  # retyped, lost and new column, other layout
        "file1\tfile2\tj2\tk\tfresh\na\tb\t0.25\t8\t7\nx\ty\t0.1\t3\t\n",  # renamed although the type changed back
        "file1\tfile2\tj2\tk\tfresh\na\tb\t\t8.0\t7\n",  # missing values are no change
        None,
        "file1,file2\n",
    )
    assert found(table) == [
        (1, "fresh", "added", None), (1, "j", "type_changed", "real"), (1, "old", "removed", None),
        (2, "j2", "renamed", "j"),
        (3, "k", "type_changed", "integer"),
        (4, "file1", "removed", None), (4, "file2", "removed", None), (4, "fresh", "removed", None), (4, "j2", "removed", None), (4, "k", "removed", None),
        (5, "file1", "added", None), (5, "file2", "added", None),
    ]


def test_feeds_order_and_repeats(spark):
    table = dumps(spark, "file1,file2,a\nx,y,1\n", "file1,file2,a\nx,y,1.5\n", "file1,file2,a\nx,y,1\n", feeds=["f", "g", "f"])
    assert found(table.union(table)) == []
    assert found(table.limit(0)) == [] == found(table.withColumn("feed", F.lit(None).cast("string")))
    late = table.withColumn("at", F.lit(0)).withColumn("feed", F.lit("f"))  # ties go by id
    assert [(i, k) for i, _, k, _ in found(late)] == [(1, "type_changed"), (2, "type_changed")]


def test_consistent_table_reports_failed_casts(spark):
    rows = D.path_values(dumps(spark, "file1,p,j\na,12,0.5\nb,x,50%\nc\n", "file1,precision,j\nd,14,NA\n"), "dump_id", "body")
    table = D.consistent(rows, {"file1": ("string", ["file1"]), "p": ("int", ["p", "precision"]), "j": ("double", ["j"])})
    got = {r.file1: (r.p, r.j, r.failed_casts) for r in table.collect()}
    assert got == {"a": (12, 0.5, []), "b": (None, 0.5, ["p"]), "c": (None, None, []), "d": (14, None, [])}


def test_renamed_columns_are_one(spark):
    table = dumps(spark, "file1,file2,j,k\na,b,0.5,1\n", "file1,file2,ie,k\na,b,50%,1\n", "file1,file2,ie,k\nc,d,60%,2\n", "file1,file2,k,x\na,b,3,zz\n")
    rows = D.path_values(table, "dump_id", "body")
    stats = D.type_statistics(rows)
    classes = D.name_classes(D.changes(table, "dump_id", "feed", "at", "body", ["file1", "file2"]), stats)
    assert classes == {"file1": ("string", ["file1"]), "file2": ("string", ["file2"]), "ie": ("double", ["ie", "j"]), "k": ("bigint", ["k"]), "x": ("string", ["x"])}
    got = [(r.id, r.ie, r.k, r.failed_casts) for r in D.consistent(rows, classes).orderBy("id").collect()]
    assert got == [(0, 0.5, 1, []), (1, 0.5, 1, []), (2, 0.6, 2, []), (3, None, 3, [])]


def test_table_holds_every_value(spark, tmp_path):
    bodies = [
        "file1,file2,j,k,corpus,n\na,b,0.5,1,set_a,3\n",
        "file1,file2,ie,k,corpus,n,N\na,b,50%,1,set_b,99999999999999999999,7\n",  # j is now ie; N isn't n; n fits no column
        "file1,file2,ie,j,k,n\na,b,0.5,est:0.6,1,NA\nc,d,NA,0.7,2,4\n",  # ie and j in one file
        "file1,file2,ie,k,x.y\na,b,0.5*,p1,zz\n",
    ]
    rows = [(i, "f", i, b) for i, b in enumerate(bodies)]
    spark.createDataFrame(rows, "dump_id long, feed_name string, written_at long, body string").write.parquet(f"{tmp_path}/run_dumps.parquet")
    p2_table(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")  # column names that differ in case only can't be written
    got = {(r["dump_id"], r["file1"]): r.asDict() for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 5
    first, second, third, fourth, fifth = (got[k] for k in [(0, "a"), (1, "a"), (2, "a"), (2, "c"), (3, "a")])
    assert [(r["ie"], r["ie_value"]) for r in (first, second, third, fourth, fifth)] == [("0.5", 0.5), ("50%", 0.5), ("0.5", 0.5), ("0.7", 0.7), ("0.5*", None)]
    assert [(r["j"], r["j_value"]) for r in (first, second, third, fourth)] == [(None, None), (None, None), ("est:0.6", None), ("0.7", 0.7)]
    assert [r["corpus"] for r in (first, second, third)] == ["set_a", "set_b", None]
    assert (first["n_2"], second["n_2"], second["N"], fifth["x.y"], fifth["k"], fourth["k_value"]) == (3, None, 7, "zz", "p1", 2.0)
    assert json.loads(second["failed_casts"]) == [{"column": "n_2", "name": "n", "text": "99999999999999999999"}]
    assert {(f["column"], f["text"]) for f in json.loads(fifth["failed_casts"])} == {("ie_value", "0.5*"), ("k_value", "p1")}
    assert first["failed_casts"] == ""


def copies(spark):
    schema = "k1 long, k2 string, x double, n int, extra string"
    left = [(1, "a", 1.0, 1, "l"), (1, "a", 1.0, 1, "m"), (2, None, None, 2, "l"), (None, "c", float("nan"), 3, "l"), (4, "d", 1.0, None, "l"), (5, "e", 5.0, 5, "l"), (7, "", 1.0, 1, "l")]
    right = [(1, "a", 1.0 + 1e-12, 1, "r"), (2, None, 0.0, 2, "r"), (None, "c", float("nan"), 3, "r"), (4, "d", 1.1, 4, "r"), (6, "f", 1.0, 1, "r"), (7, None, 1.0, 1, "r")]
    return spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)


def test_copies_differ_field_by_field(spark):
    left, right = copies(spark)
    got = {(r.k1, r.k2): (r.status, [tuple(d) for d in r.differences], r.left_rows, r.right_rows) for r in compare_copies(left, right, ["k1", "k2"], ["x", "n"]).collect()}
    assert got == {
        (1, "a"): ("same", [], 2, 1),
        (2, None): ("changed", [("x", None, "0.0")], 1, 1),
        (None, "c"): ("same", [], 1, 1),
        (4, "d"): ("changed", [("x", "1.0", "1.1"), ("n", None, "4")], 1, 1),
        (5, "e"): ("left_only", [], 1, 0),
        (6, "f"): ("right_only", [], 0, 1),
        (7, ""): ("left_only", [], 1, 0),
        (7, None): ("right_only", [], 0, 1),
    }


def test_copies_empty_sides_and_clashes(spark):
    left, right = copies(spark)
    assert {r.status for r in compare_copies(left, right.limit(0), ["k1", "k2"], ["x"]).collect()} == {"left_only"}
    assert compare_copies(left.limit(0), right.limit(0), ["k1"], ["x"]).count() == 0
    named = [d.withColumnRenamed("k1", "status") for d in (left, right)]
    with pytest.raises(ValueError):
        compare_copies(*named, ["status"], ["x"])
    for kind in ("date", "timestamp", "decimal(10,2)", "boolean", "double", "binary"):
        rows = spark.sql(f"select cast(null as {kind}) as k, 1 as v")
        assert compare_copies(rows, rows, ["k"], ["v"]).first().status == "same"
