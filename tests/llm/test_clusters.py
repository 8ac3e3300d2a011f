"""Grid density clusters of measured pairs."""

import random

from pyspark.sql import functions as F

from overlapse.llm import gridcluster as G

SCHEMA = "f1 string, f2 string, p int, j double, r double, near string, label string"


def pairs_of(groups, rng, strays=0, share=1.0):
    """Near pairs within groups, far ones between, and stray near ones between groups."""
    names = [n for g in groups for n in g]
    rows = []
    for g in groups:
        for i, a in enumerate(g):
            for b in g[i + 1 :]:
                if rng.random() < share or len(g) < 8:
                    rows.append((a, b, rng.uniform(0.5, 0.85)))
    own = {n: i for i, g in enumerate(groups) for n in g}
    for _ in range(len(names) * 6):
        a, b = rng.sample(names, 2)
        if own[a] != own[b]:
            rows.append((a, b, rng.uniform(0.0, 0.28)))
    big = [g for g in groups if len(g) >= 5]
    for k in range(strays):
        rows.append((big[2 * k][0], big[2 * k + 1][0], 0.7))
    return rows


def table(spark, rows, rng):
    out = []
    for a, b, s in rows:
        a, b = (a, b) if rng.random() < 0.5 else (b, a)
        floor = s + 0.17 * (1 - s)
        out.append((a, b, 12, *rng.choice([(s, None), (s, floor), (None, floor)]), "clash", "clash"))
    return spark.createDataFrame(out, SCHEMA)


def members(df):
    pairs = G.measured(df, "f1", "f2", "j", "r", F.pow(F.lit(2.0), F.coalesce("p", F.lit(4))))
    out = {}
    for r in G.clusters(G.near_pairs(pairs)).collect():
        out.setdefault(r.cluster, set()).add(r.item)
        assert r.density >= 1
    return sorted(map(sorted, out.values()))


def test_groups_are_found_and_strays_join_nothing(spark):
    rng = random.Random(5)
    sizes = [2, 2, 3, 4, 5, 6, 6, 7, 8, 9, 12, 14, 30, 40]
    groups, n = [], 0
    for s in sizes:
        groups.append([f"x{n + i:04d}" for i in range(s)])
        n += s
    rows = pairs_of(groups, rng, strays=4, share=0.7)
    df = table(spark, rows, rng)
    assert members(df) == sorted(map(sorted, groups))
    odd = [("x0000", "x0000", 8, 1.0, 1.0, "", ""), (None, "x0001", 8, 0.9, 0.9, "", ""), ("x0000", "x0050", None, None, None, "", ""), ("x0000", "x0060", 8, float("nan"), None, "", "")]
    assert members(df.union(df).union(spark.createDataFrame(odd, SCHEMA))) == sorted(map(sorted, groups))


def test_far_pairs_alone_make_no_cluster(spark):
    df = spark.createDataFrame([(f"a{i}", f"b{i}", 10, 0.01 * (i % 20), None, "", "") for i in range(60)], SCHEMA)
    assert members(df) == []
    assert members(df.limit(0)) == []


def test_typical_members_and_ties(spark):
    rows = [("c", 3, 2, "b"), ("c", 3, 2, "a"), ("c", 3, 1, "z"), ("d", 2, 1, "y"), ("d", 2, 1, "x")]
    df = spark.createDataFrame(rows, "cluster string, size long, density long, item string")
    got = {r.cluster: (r.size, r.densest, r.typical) for r in G.typical_members(df, 2).collect()}
    assert got == {"c": (3, 2, "a,b"), "d": (2, 1, "x,y")}


def test_labels_of_a_long_chain(spark):
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)], "a string, b string")
    assert {r.label for r in G.labels(chain).collect()} == {"n000"}
