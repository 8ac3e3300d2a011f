"""Golden values of two tiny interval files, for every mode and sampler."""

import math
import os
import threading
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlapse.functions import hashing
from overlapse.operators import elements as E
from overlapse.operators import pairwise as P
from overlapse.operators import registers as R

A = [("chr1", 100, 200), ("chr1", 500, 750), ("chr1", 1000, 1100), ("chr2", 50, 150), ("chr2", 800, 900), ("chr3", 10, 60)]
B = [("chr1", 100, 200), ("chr1", 450, 750), ("chr1", 1200, 1300), ("chr2", 50, 150), ("chr2", 850, 950), ("chr4", 2000, 2050)]

GOLDEN = [
    ("A12", lambda d: E.interval_elements(d, ["f"]), 12, 6.004408886394782, 6.004410003534332, 10.01233007339977, 0.2, 0.1994030162702595),
    ("B12", lambda d: E.point_elements(d, ["f"]), 12, 685.4929501274627, 745.968908064228, 935.2640334230227, 0.5478468899521531, 0.5305430413619212),
    ("B14", lambda d: E.point_elements(d, ["f"]), 14, 696.6116019118379, 748.8606567570026, 942.605127686064, 0.5360262008733624, 0.5334865217816395),
    ("B14m", lambda d: E.point_elements(d, ["f"], 0.3), 14, 234.67057624705427, 243.8031269902204, 310.93544056173357, 0.5357142857142857, 0.538820091954998),
    ("B14h", lambda d: E.point_elements(d, ["f"], 0.3, "hash-threshold"), 14, 202.24277238804112, 235.68507053949577, 288.52817910256283, 0.5174825174825175, 0.5177992121589865),
    ("B14s", lambda d: E.point_elements(d, ["f"], 0.3, "single-hash"), 14, 210.34361715008717, 227.57138333928918, 288.5275358968568, 0.513986013986014, 0.5177580854741113),
    ("C14", lambda d: E.hybrid_elements(d, ["f"]), 14, 702.8718986230815, 755.141909914704, 953.1988594209608, 0.5323974082073434, 0.5296008740752002),
    ("C14e", lambda d: E.hybrid_elements(d, ["f"], exponent=1), 14, 756.1927473565827, 808.6281680832375, 1042.4806851510018, 0.504950495049505, 0.501055067713948),
    ("C14a", lambda d: E.hybrid_elements(d, ["f"], interval_rate=0.5), 14, 698.6976912543208, 749.9076086382121, 945.7819504729237, 0.5342763873775843, 0.5316482823215015),
    ("C14he", lambda d: E.hybrid_elements(d, ["f"], 1.0, 0.3, 0.5, "hash-threshold"), 14, 218.44844017959406, 253.95670061020232, 317.05280843764257, 0.49044585987261147, 0.4899888227380527),
]


@pytest.fixture(scope="module")
def intervals(spark):
    rows = [("a", *r) for r in A] + [("b", *r) for r in B]
    return spark.createDataFrame(rows, "f string, chrom string, start long, end long")


def close(got, want):
    return all(math.isclose(g, w, rel_tol=1e-12) for g, w in zip(got, want))


@pytest.mark.parametrize("case", GOLDEN, ids=[g[0] for g in GOLDEN])
def test_golden_row(intervals, case):
    _, build, p, *want = case
    regs = R.registers(build(intervals), ["f"], p).cache()
    row = P.sparse_pairs(regs.where("f = 'a'"), regs.where("f = 'b'"), ["f"], p).first()
    assert close([row.card_1, row.card_2, row.card_union, row.reg_eq_similarity, row.jaccard_similarity_ie], want)


def test_fused_points_and_dense_pairs_equal_the_sparse_path(intervals):
    p = 12
    fused = R.point_registers(intervals, ["f"], p)
    plain = R.registers(E.point_elements(intervals, ["f"]), ["f"], p)
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, plain.collect()))
    sketches = R.dense(plain, ["f"], p)
    assert sorted(map(tuple, R.sparse(sketches, ["f"]).collect())) == sorted(map(tuple, plain.collect()))
    dense = {(r.f_1, r.f_2): r for r in P.dense_pairs(sketches, sketches, ["f"], p).collect()}
    sparse = {(r.f_1, r.f_2): r for r in P.sparse_pairs(plain, plain, ["f"], p).collect()}
    assert dense.keys() == sparse.keys() and len(dense) == 4
    for k in dense:
        assert close(list(dense[k])[2:], list(sparse[k])[2:])
    assert dense["a", "a"].jaccard_similarity_ie == 1.0


def test_xxh32_anchors():
    span = (1 << 32) - 1
    assert hashing.xxh32([b"1", b"chrX"]).tolist() == [round(0.7654405473185332 * span), round(0.32077193267661425 * span)]
    import xxhash

    data = [bytes(range(n % 251)) * (n // 251 + 1) for n in range(300)]
    assert hashing.xxh32(data, 7).tolist() == [xxhash.xxh32(d, 7).intdigest() for d in data]


@pytest.mark.parametrize("seed", [0, 1, 7, 42, 31337, (1 << 63) + 5])
def test_xxh64_with_any_seed(spark, seed):
    import xxhash

    texts = ["", "a", "chr1\t100", "x" * 31, "y" * 75]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(hashing.xxh64(F.col("t"), seed)).collect()]
    assert [g & ((1 << 64) - 1) for g in got] == [xxhash.xxh64(t.encode(), seed).intdigest() for t in texts]


def test_phase_invariance_and_strides(spark):
    one = spark.createDataFrame([("f", "chrX", 0, 1200)], "f string, chrom string, start long, end long")
    cut = spark.createDataFrame([("f", "chrX", 0, 317), ("f", "chrX", 317, 811), ("f", "chrX", 811, 1200)], one.schema)
    a, b = (sorted(r.element for r in E.point_elements(d, ["f"], 0.3).collect()) for d in (one, cut))
    assert a == b and len(a) == 300
    other = spark.createDataFrame([("f", "1", 0, 1200)], one.schema)
    assert E.point_elements(other, ["f"], 0.3).count() == 400


def test_saturated_and_empty_sketches(spark):
    for p in (4, 6, 8):
        full = spark.range(1 << p).select(F.lit("f").alias("f"), F.col("id").alias("h"))
        regs = R.registers_of_hashes(full, ["f"], p)
        assert {r.rho for r in regs.collect()} == {64 - p + 1}
        assert R.cardinality(regs, ["f"], p).first().cardinality > 0
    every = spark.createDataFrame([("f",), ("g",)], "f string")
    got = dict(R.cardinality(R.registers_of_hashes(every.where("f = 'g'").withColumn("h", F.lit(5)), ["f"], 8), ["f"], 8, every=every).collect())
    assert got["f"] == 0.0 and got["g"] > 0.9


def test_arguments_are_checked(intervals):
    for bad in (lambda: E.point_elements(intervals, ["f"], 1.5), lambda: E.point_elements(intervals, ["f"], 0.5, "other"), lambda: R.registers(intervals.withColumn("element", F.lit("x")), ["f"], 3)):
        with pytest.raises(ValueError):
            bad()
    assert E.point_elements(intervals, ["f"], 0.0).count() == 0


def test_fused_points_of_all_lengths_equal_the_sparse_path(spark):
    edges = [0, 5, 97, 995, 9_990, 19_995, 99_990, 999_995, 10**7 - 3, 10**8 - 3, 10**9 - 3, 10**12 - 3]
    names = ["1", "chr1", "chrX", "chr10", "chr1_gl0001", "a_name_beyond_the_kernel", "é"]
    rows = [(f, c, s, s + 25 + len(c)) for f, c in zip(["a", "b", None] * 3, names) for s in edges] + [("a", "chr1", 3_000, 45_000), ("a", "chr1", 9, 9)]
    df = spark.createDataFrame(rows, "f string, chrom string, start long, end long")
    plain = R.registers(E.point_elements(df, ["f"]), ["f"], 8)
    key = lambda r: (r[0] or "", r[1:])
    assert sorted(map(tuple, R.point_registers(df, ["f"], 8).collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


def test_registers_know_their_precision(spark, tmp_path):
    e = spark.range(5000).select(F.lit("a").alias("f"), F.col("id").cast("string").alias("element"))
    ten, twelve = R.registers(e, ["f"], 10), R.registers(e, ["f"], 12)
    ten.write.parquet(f"{tmp_path}/ten")
    kept = R.merge(spark.read.parquet(f"{tmp_path}/ten").where("idx >= 0"), ["f"])
    for call in (lambda: P.sparse_pairs(kept, twelve, ["f"], 12), lambda: R.cardinality(ten, ["f"], 12), lambda: P.sparse_pairs(ten, ten, ["f"], 10, 60)):
        with pytest.raises(ValueError, match="registers of precision 10"):
            call()
    with pytest.raises(Exception, match="a sketch of 1024 registers"):
        P.dense_pairs(R.dense(ten, ["f"], 10), R.dense(twelve, ["f"], 12), ["f"], 12).collect()
    assert R.cardinality(kept, ["f"], 10).first().cardinality == pytest.approx(5000, rel=0.1)
    only = P.dense_pairs(R.dense(ten, ["f"], 10), R.dense(kept, ["f"], 10), ["f"], 10, shape="re")
    assert only.columns == ["f_1", "f_2", "matching", "active", "reg_eq_similarity"] and only.first().reg_eq_similarity == 1.0


@pytest.mark.parametrize("p, bits", [(4, 64), (10, 64), (16, 60)])
def test_blocks_compare_like_single_pairs(p, bits):
    rng = np.random.default_rng(p)
    one, two = (np.minimum(rng.geometric(0.5, (n, 1 << p)) - rng.integers(0, 2, (n, 1)), bits - p + 1).astype(np.uint8) for n in (5, 3))
    two[0] = 0
    matching, active, union = P.compare_block(one, two, p, bits)
    for i, a in enumerate(one):
        for j, b in enumerate(two):
            u = np.maximum(a, b)
            assert (matching[i, j], active[i, j]) == (((a == b) & (u > 0)).sum(), (u > 0).sum())
            assert union[i, j].tolist() == np.bincount(u, minlength=bits - p + 2).tolist()
    few = P.compare_block(one, two, p, bits, union=False)
    assert (few[0] == matching).all() and (few[1] == active).all() and few[2] is None


def _workers_mb():
    """Resident MB of the largest Python worker below this process."""
    parents, sizes = {}, {}
    for status in Path("/proc").glob("[0-9]*/status"):
        try:
            held = dict(line.split(":", 1) for line in status.read_text().splitlines() if ":" in line)
        except OSError:
            continue
        parents[int(held["Pid"])] = int(held["PPid"])
        if held["Name"].strip().startswith("python"):
            sizes[int(held["Pid"])] = int(held.get("VmRSS", "0 kB").split()[0]) / 1024

    def below(pid):
        while pid in parents and pid != os.getpid():
            pid = parents[pid]
        return pid == os.getpid()

    return max([mb for pid, mb in sizes.items() if pid != os.getpid() and below(pid)], default=0)


def test_dense_pairs_hold_a_tile_of_pairs(spark):
    n, p = 1800, 6
    rng = np.random.default_rng(1)
    rows = [(i, np.minimum(rng.geometric(0.5, 1 << p), 59).astype(np.uint8).tobytes()) for i in range(n)]
    sketches = spark.createDataFrame(rows, "f long, sketch binary").cache()
    peak, over = [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            peak[0] = max(peak[0], _workers_mb())

    thread = threading.Thread(target=watch)
    thread.start()
    P.dense_pairs(sketches, sketches, ["f"], p).write.format("noop").mode("overwrite").save()
    over.set()
    thread.join()
    assert 0 < peak[0] < 600


def _sketched(rng, n, p, share):
    cells = np.where(rng.random((n, 1 << p)) < share, np.minimum(rng.geometric(0.5, (n, 1 << p)), 64 - p + 1), 0).astype(np.uint8)
    cells[0] = 0
    return cells


def test_dense_pairs_of_many_tiles_keep_null_keys(spark):
    p, rng = 4, np.random.default_rng(2)
    cells = _sketched(rng, 530, p, 0.7)
    keys = [None, *((1 << 60) + i for i in range(1, len(cells)))]
    sketches = spark.createDataFrame([(k, c.tobytes()) for k, c in zip(keys, cells)], "f long, sketch binary")
    found = {(r.f_1, r.f_2): (r.matching, r.active) for r in P.dense_pairs(sketches, sketches.limit(300), ["f"], p).collect()}
    assert len(found) == 530 * 300
    for (f, a), (g, b) in ((x, y) for x in list(zip(keys, cells))[::53] for y in list(zip(keys, cells))[:300:29]):
        u = np.maximum(a, b)
        assert found[f, g] == (((a == b) & (u > 0)).sum(), (u > 0).sum())


def test_sparse_pairs_compare_blocks_without_a_row_per_register(spark):
    p, rng = 5, np.random.default_rng(3)
    one, two = (_sketched(rng, n, p, share) for n, share in ((300, 0.05), (270, 0.6)))
    regs = [
        spark.createDataFrame([(int(i), int(j), int(c[i, j])) for i, j in zip(*np.nonzero(c))] + [(None, 1, 1)], "f long, idx int, rho byte").selectExpr("f", "idx", "cast(rho as tinyint) as rho")
        for c in (one, two)
    ]
    pairs = P.sparse_pairs(*regs, ["f"], p)
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    found = {(r.f_1, r.f_2): r for r in pairs.collect()}
    want = [(i, j) for i, a in enumerate(one) for j, b in enumerate(two) if ((a > 0) & (b > 0)).any()]
    assert sorted(found) == want
    for i, j in want[::97]:
        a, b = one[i], two[j]
        u, r = np.maximum(a, b), found[i, j]
        assert (r.matching, r.active) == (((a == b) & (u > 0)).sum(), (u > 0).sum())
        cards = [P.estimators.cardinalities(np.bincount(x, minlength=64 - p + 2)[None], p)[0] for x in (a, b, u)]
        assert close([r.card_1, r.card_2, r.card_union], cards)
    assert P.sparse_pairs(regs[0].limit(0), regs[1], ["f"], p).count() == 0
