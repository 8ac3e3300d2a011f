"""Bottom-k overlaps and exponential registers against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from overlapse.llm import bottomk as B
from overlapse.llm import distinct as D
from overlapse.llm.set_queries import p5_overlaps


def exact_pairs(sets, least):
    out = {}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            s = len(sets[a] & sets[b])
            if s and s >= least * min(len(sets[a]), len(sets[b])):
                out[a, b] = s
    return out


def rows_of(spark, sets):
    return spark.createDataFrame([(k, e, "clash") for k, s in sets.items() for e in s for _ in range(1 + (e % 3 == 0))], "set long, e long, h string")


def test_pairs_of_small_large_and_equal_sets(spark):
    rng = random.Random(3)
    base = [rng.randrange(10**9) for _ in range(12000)]
    sets = {1: set(base), 2: set(base[:60]), 3: set(base[:20]) | set(range(40)), 4: set(range(40)), 5: set(range(40)), 6: set(base[6000:9000]) | set(range(10**6, 10**6 + 4000)), 7: {5}, 8: set(range(10**7, 10**7 + 300))}
    sets |= {100 + i: {77} | set(range(2 * 10**7 + 50 * i, 2 * 10**7 + 50 * i + 30)) for i in range(60)}  # one element in most sets
    rows = rows_of(spark, sets).union(spark.createDataFrame([(None, 1, "")], "set long, e long, h string"))
    elements = B.distinct_elements(rows, "set", ["e"]).cache()
    for k in (64, 1024):
        got = {tuple(sorted((r.set_1, r.set_2))) for r in B.at_least(elements, 0.3, k).collect()}
        assert got == set(exact_pairs(sets, 0.3))
    est = {tuple(sorted((r.set_1, r.set_2))): r for r in B.overlaps(B.indexed(elements, 64), 0.3).collect()}
    for pair, shared in exact_pairs(sets, 0.3).items():
        r = est[pair]
        assert abs(r.containment_12 - shared / r.n_1) <= 5 * r.error + 1e-12
        assert math.isclose(r.shared, r.jaccard * r.union_size)


def test_large_sets_are_estimated_from_merged_lists(spark):
    rng = random.Random(8)
    base = rng.sample(range(10**9), 30000)
    sets = {i: set(base[500 * i : 500 * i + rng.choice([5000, 9000])]) for i in range(20)} | {99: set(base)}
    elements = B.distinct_elements(rows_of(spark, sets), "set", ["e"]).cache()
    rows = B.overlaps(B.indexed(elements, 256), 0.0).collect()
    assert {tuple(sorted((r.set_1, r.set_2))) for r in rows} >= set(exact_pairs(sets, 0.05)) and all(r.error > 0 for r in rows)
    off = []
    for r in rows:
        a, b = sets[r.set_1], sets[r.set_2]
        off.append((r.containment_12 - len(a & b) / len(a)) / r.error)
        assert abs(r.union_size / len(a | b) - 1) < 6 / math.sqrt(r.merged) and r.merged >= 256
    assert max(map(abs, off)) < 5 and abs(sum(off) / len(off)) < 1.5
    assert {tuple(sorted((r.set_1, r.set_2))) for r in B.at_least(elements, 0.3, 256).collect()} == set(exact_pairs(sets, 0.3))


def test_sketches_merge_without_their_sets(spark):
    sets = {1: range(9000), 2: range(8000, 8100), 3: range(7000, 30000), 4: range(50)}
    elements = B.distinct_elements(spark.createDataFrame([(k, e) for k, s in sets.items() for e in s], "set long, e long"), "set", ["e"]).cache()
    groups = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 11), (2, 11)], "set_id long, group long")
    union = elements.join(groups, "set_id").select(F.col("group").alias("set_id"), "h").distinct()
    parts = B.sketches(elements, 64)
    assert parts.groupBy("set_id").count().where("count > 200").count() == 0
    assert sorted(map(tuple, B.merged_sketches(parts, groups, 64).collect())) == sorted(map(tuple, B.sketches(union, 64).collect()))


def test_small_shares_are_estimated(spark, tmp_path):
    sets = {1: range(3000), 2: range(2700, 6000), 3: range(5990, 6200), 4: range(10**6, 10**6 + 50)}  # 1 and 2 share 0.1, 2 and 3 share 10 of 210
    rows = [(f, "c", e, e + 1) for f, s in sets.items() for e in s]
    spark.createDataFrame(rows, "file_id long, chrom string, start_pos long, end_pos long").write.parquet(f"{tmp_path}/intervals.parquet")
    got = {tuple(sorted((r.file_id_1, r.file_id_2))): r for r in p5_overlaps(spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 2), (2, 3)}
    assert abs(got[1, 2].containment_12 - 0.1) <= 5 * got[1, 2].error and got[1, 2].error > 0
    assert (got[2, 3].shared, got[2, 3].error) == (10.0, 0.0) and got[2, 3].union_size == 210 + 3300 - 10


def test_no_sets_no_overlaps_and_null_elements(spark):
    empty = spark.createDataFrame([], "set long, e long")
    assert B.at_least(B.distinct_elements(empty, "set", ["e"]), 0.3).count() == 0
    rows = spark.createDataFrame([(1, None), (2, None), (2, 3)], "set long, e long")
    assert B.at_least(B.distinct_elements(rows, "set", ["e"]), 0.3).count() == 1  # null is an element like others


def test_estimates_lie_within_their_bounds(spark):
    n = [0, 1, 10, 300, 5000, 60000]
    rows = None
    for g, size in enumerate(n):
        part = spark.range(size * 2).select(F.lit(g).alias("g"), (F.col("id") % max(1, size)).alias("x"), F.lit(8 + g).alias("p"))
        rows = part if rows is None else rows.union(part)
    est = {r.g: r for r in D.estimates(D.registers(rows, ["g"], ["g", "x"], "p"), ["g"], z=4).collect()}
    assert sorted(est) == [1, 2, 3, 4, 5]
    for g, r in est.items():
        assert r.low <= n[g] <= r.high and r.n_rows == 2 * n[g]
        assert abs(r.n_distinct - n[g]) <= 4 * r.error * n[g] + 1.01
        assert r.p == 8 + g and math.isclose(r.error, 1 / math.sqrt(2 ** (8 + g) - 2))


def test_registers_are_exponential_and_sums_gamma(spark):
    rng = np.random.default_rng(6)
    for n, p in ((1, 6), (7, 8), (3000, 8), (40000, 5)):
        sums, inside = [], 0
        for _ in range(150):
            r = D.race(rng.integers(-(1 << 62), 1 << 62, n), p) / 2**p * n
            assert np.isfinite(r).all() and len(r) == 1 << p
            sums.append(r.sum())
            a = 2 / (9 * 2 ** (p + 1))
            low, high = (2**p * (1 - a + z * math.sqrt(a)) ** 3 for z in (-1.96, 1.96))
            inside += low <= r.sum() <= high
        m = 2**p
        assert abs(np.mean(sums) / m - 1) < 4 / math.sqrt(m * 150) and abs(np.var(sums) / m - 1) < 0.6
        assert inside >= 150 * 0.89


def test_races_of_parts_fold_and_merge_exactly():
    rng = np.random.default_rng(2)
    h = rng.integers(-(1 << 62), 1 << 62, 5000)
    parts = np.minimum(D.race(h[:3000], 9), D.race(h[2000:], 9))
    assert (parts == D.race(h, 9)).all() and (D.folded(parts, 5) == D.race(h, 5)).all()
    assert np.isinf(D.race(h[:0], 4)).all()


def test_hot_groups_are_sketched_in_parts(spark, monkeypatch):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), (F.col("id") % 2500).alias("x"), F.lit(6).alias("p"))
    whole = sorted((r.g, r.n_rows, r.registers) for r in D.registers(rows, ["g"], ["x"], "p").collect())
    monkeypatch.setattr(D, "TASK_ROWS", 500)
    monkeypatch.setattr(D, "TASK_SKETCHES", 3)
    assert sorted((r.g, r.n_rows, r.registers) for r in D.registers(rows, ["g"], ["x"], "p").collect()) == whole


def test_bias_is_small_over_many_sketches(spark):
    for size in (20, 5000):
        rows = spark.range(size * 100).select((F.col("id") % 100).alias("g"), F.col("id").alias("x"), F.lit(8).alias("p"))
        mean = D.estimates(D.registers(rows, ["g"], ["x"], "p"), ["g"]).agg(F.avg("n_distinct")).first()[0]
        assert abs(mean / size - 1) < 4 * 0.0626 / math.sqrt(100)


def test_partial_results_merge_at_the_lowest_precision(spark):
    rows = spark.range(30000).select(
        (F.col("id") % 3).alias("day"), F.when(F.col("id") % 5 > 0, "t").alias("tissue"), (F.col("id") % 9000).alias("x"), (F.col("id") % 3 * 2 + 8).cast("int").alias("p")
    )
    fine = D.registers(rows, ["day", "tissue"], ["x"], "p")
    merged = {r.tissue: (r.p, r.n_rows, r.registers) for r in D.merged(fine, ["tissue"]).collect()}
    direct = {r.tissue: (r.p, r.n_rows, r.registers) for r in D.registers(rows, ["tissue"], ["x"], "p").collect()}
    assert merged == direct and set(merged) == {"t", None}
    every = D.estimates(D.combinations(fine, ["day", "tissue"]), ["day", "tissue", "left_out"])
    got = {(r.day, r.tissue, r.left_out): r for r in every.collect()}
    assert len(got) == 6 + 3 + 2 + 1
    total = got[None, None, 3]
    assert total.p == 8 and total.n_rows == 30000 and total.low <= 9000 <= total.high
    assert got[None, None, 1].n_rows == 6000  # the missing tissue, all days


def test_empty_and_odd_precisions(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 11), ("b", 1, 1), ("c", 1, None)], "g string, x int, p int")
    est = {r.g: r.p for r in D.estimates(D.registers(rows, ["g"], ["x"], "p"), ["g"]).collect()}
    assert est == {"a": 11, "b": 4, "c": 4}
    assert tuple(rows.select(*(D.clamped(F.lit(p)) for p in (-3, 4, 18, 40))).first()) == (4, 4, 18, 24)
    assert D.estimates(D.registers(rows.limit(0), ["g"], ["x"], "p"), ["g"]).count() == 0
