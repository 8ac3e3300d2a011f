"""Statistics, catalogues, sequences and exact baselines against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import overlapse
from overlapse.operators import catalog, exact, sequences
from overlapse.operators import elements as E
from overlapse.operators import registers as R
from overlapse.operators import statistics as S
from overlapse.plans import session
from overlapse.plans.session import written
from overlapse.sources import files, results
from overlapse.streaming.sketching import run_registers
from tests.test_golden import A, B


def ranks(v):
    s = sorted(v)
    return [s.index(x) + (s.count(x) + 1) / 2 for x in v]


def corr(x, y):
    return float(np.corrcoef(x, y)[0, 1])


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(3)
    rows = [(g, round(rng.random(), 2), round(rng.random() ** 2, 2)) for g in ("a", "b") for _ in range(150)]
    return rows, spark.createDataFrame([*rows, ("a", None, 0.5), ("c", 0.5, 0.5), (None, None, None)], "g string, x double, y double")


def test_rank_statistics(scores):
    rows, df = scores
    for g in ("a", "b"):
        x, y = zip(*[(a, b) for k, a, b in rows if k == g])
        sp = {r.g: r for r in S.spearman(df, ["g"], "x", "y").collect()}
        assert sp[g].spearman == pytest.approx(corr(ranks(x), ranks(y))) and sp[g].n == 150
        con = dis = 0
        for i in range(150):
            for j in range(i):
                p = (x[i] - x[j]) * (y[i] - y[j])
                con, dis = con + (p > 0), dis + (p < 0)
        k = {r.g: r for r in S.kendall(df, ["g"], "x", "y").collect()}[g]
        assert (k.concordant, k.discordant) == (con, dis) and k.tau == pytest.approx((con - dis) / (con + dis))
        e = {r.g: r for r in S.error_statistics(df, ["g"], "x", "y").collect()}
        assert e[g].mae == pytest.approx(np.mean(np.abs(np.subtract(x, y)))) and e[g].pearson == pytest.approx(corr(x, y))
        assert e["c"].pearson is None and e["c"].n == 1


def test_kendall_counts_close_values_apart(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0.5, rng.random()]) / 50, rng.choice([0.25, 0.75, rng.random()]) / 50) for _ in range(400)]  # all closer than 0.02, two heavy values
    met = [(a[0] - b[0]) * (a[1] - b[1]) for i, a in enumerate(rows) for b in rows[:i]]
    df = spark.createDataFrame(rows, "x double, y double")
    for slices in (1, 7, 256):
        k = S.kendall(df, [], "x", "y", slices=slices).first()
        assert (k.concordant, k.discordant) == (sum(m > 0 for m in met), sum(m < 0 for m in met))


def test_jackknife_leaves_each_file_out(spark):
    pairs = [("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 4.0), ("c", "d", 8.0), ("a", "a", 3.0)]
    got = S.jackknife(spark.createDataFrame(pairs, "f string, g string, v double"), "f", "g", F.col("v")).first()
    means = [np.mean([v for f, g, v in pairs if x not in (f, g)]) for x in "abcd"]
    assert got.n_files == 4 and got.mean == pytest.approx(3.6)
    assert got.se == pytest.approx(math.sqrt(3 / 4 * sum((m - np.mean(means)) ** 2 for m in means)))


def test_label_agreement(spark):
    same = spark.createDataFrame([(i % 3, "xyz"[i % 3]) for i in range(30)] + [(None, "x")], "a int, b string")
    r = S.label_agreement(same, "a", "b").first()
    assert (r.n, r.ari, r.nmi) == (30, pytest.approx(1), pytest.approx(1))
    one = S.label_agreement(same.withColumn("b", F.lit("q")), "a", "b").first()
    assert one.nmi == 0.0 and one.ari == 0.0


def test_fits_and_series(spark):
    rows = spark.createDataFrame([("g", float(n), 3.0 * n**1.5, 100.0 / n) for n in (1, 2, 4, 8, 16)], "g string, n double, cost double, other double")
    r = S.power_law(rows, ["g"], "n", "cost").first()
    assert r.exponent == pytest.approx(1.5) and r.factor == pytest.approx(3)
    flipped = S.persistent_crossover(rows, ["g"], "n", "other", "cost").first()
    assert flipped.crossover == 8.0
    cells = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, "a"), (4, "c")], "cell int, pair string")
    assert {r.cell: r.complete for r in S.same_pair_sets(cells, ["cell"], ["pair"]).collect()}[3] is False
    j = spark.createDataFrame([(x / 10, x / 10 + 0.2 * (1 - x / 10)) for x in range(10)], "j double, r double")
    fit = S.floor_fits(j, [], "j", "r").first()
    assert fit.constrained == pytest.approx(0.2) and fit.pointwise == pytest.approx(0.2) and fit.intercept == pytest.approx(0.2)
    load = S.load_factor(spark.createDataFrame([("a", 0), ("b", 10**6)], "k string, n long"), ["k"], "n", 12)
    assert {r.k: round(r.floor, 3) for r in load.collect()} == {"a": 0.0, "b": 0.17}


def test_symmetric_matrix(spark):
    pairs = spark.createDataFrame([("b", "a", 0.9), ("c", "b", 0.4), ("c", "a", 0.5)], "a string, b string, similarity double")
    wide = {r["item"]: r for r in results.matrix_rows(pairs, list("abc")).collect()}
    assert wide["a"]["a"] == 1.0 and wide["b"]["c"] == wide["c"]["b"] == pytest.approx(0.4) and wide["a"]["b"] == pytest.approx(0.9)


def test_rank_agreement(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(g, rng.choice([0.2, rng.random()]), rng.choice([0.0, 0.3, rng.random()])) for g in "ab" for _ in range(120)] + [("c", 1.0, 1.0), ("d", 1.0, 2.0), ("d", 1.0, 3.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    for slices in (256, 5):
        monkeypatch.setattr(S, "RANK_SLICES", slices)
        got = {r.g: r for r in S.rank_agreement(df, ["g"], "x", "y").collect()}
        assert sorted(got) == ["a", "b", "d"] and (got["d"].tied, got["d"].tau_a, got["d"].tau_b, got["d"].max_inverted_gap) == (1, 0.0, None, 0.0)
        for g in "ab":
            own = [(x, y) for k, x, y in rows if k == g and x is not None]
            signs = [(np.sign(a[0] - b[0]) * np.sign(a[1] - b[1]), abs(a[0] - b[0])) for i, a in enumerate(own) for b in own[:i]]
            r, n, d, t = got[g], len(signs), sum(s < 0 for s, _ in signs), sum(s == 0 for s, _ in signs)
            assert (r.comparisons, r.discordant, r.tied, r.clamped_at_zero) == (n, d, t, sum(y == 0 for _, y in own))
            untied = [sum(own[i][k] != own[j][k] for i in range(len(own)) for j in range(i)) for k in (0, 1)]
            assert r.tau_a == pytest.approx((n - 2 * d - t) / n) and r.tau_b == pytest.approx((n - 2 * d - t) / math.sqrt(untied[0] * untied[1]))
            assert r.max_inverted_gap == max(gap for s, gap in signs if s < 0)


def test_runs_ratios_and_first_pairs(spark):
    rows = [(1, "r1", "a", 2.0), (1, "r1", "b", 1.0), (1, "r2", "a", 9.0), (1, "r2", "b", 3.0), (1, "r3", "a", 5.0), (1, "r4", "b", 0.0), (1, "r4", "a", 1.0), (2, "r1", "a", None)]
    df = spark.createDataFrame(rows, "g int, rep string, arm string, v double")
    r = S.paired_ratios(df, ["g"], ["rep"], "arm", "a", "b", "v").first()
    assert (r.n, r.median, r.least, r.most) == (2, 2.5, 2.0, 3.0)
    runs = {x.g: x for x in S.run_aggregates(df, ["g"], "v").collect()}
    assert sorted(runs) == [1] and runs[1].n == 7 and runs[1].std == pytest.approx(np.std([2, 1, 9, 3, 5, 0, 1])) and runs[1].most == 9
    pairs = spark.createDataFrame([("x", "y", 3, 0.1), ("y", "x", 2, 0.7), ("y", "x", 2, 0.5), ("x", "x", 1, 0.2)], "f string, g string, t int, v double")
    assert sorted(map(tuple, S.first_per_pair(pairs, "f", "g", ["t"], ["v"]).collect())) == [("x", "x", 0.2), ("x", "y", 0.5)]
    both = {(r.a, r.b): (r.n, r.agree) for r in S.unordered_pairs(pairs, "f", "g", "v").collect()}
    assert both == {("x", "y"): (3, False)} and S.unordered_pairs(pairs, "f", "g", "v", 0.7).first().agree


def test_skewed_values_are_ranked_without_one_window(spark, monkeypatch):
    monkeypatch.setattr(S, "RANK_SLICES", 7)
    values = [math.exp(-i / 3) for i in range(300)] + [0.5] * 40
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: r.rank for r in S.average_ranks(df, [], "v", "rank").collect()}
    assert [got[v] for v in values] == ranks(values)


def test_pair_counts_are_whole_numbers(spark):
    n = [0, 1, 2, 3, 10**9 + 1, 4 * 10**9]
    got = spark.createDataFrame([(v,) for v in n], "n long").select(catalog.pair_count(F.col("n"))).collect()
    assert [r[0] for r in got] == [v * (v - 1) // 2 for v in n]
    rows = spark.createDataFrame([("hg38", "x"), ("mm10", None), (None, "x")], "r string, why string")
    assert [r.s for r in catalog.looked_up(rows, "r", {"hg38": "human"}, "s", "none").collect()] == ["human", "none", "none"]
    assert [tuple(r) for r in catalog.reason_counts(rows, [], "why").collect()] == [("x", 2)]


def test_counters_equal_the_elements(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice(["1", "chrX", "a_chromosome_name_of_more_than_forty_four_bytes"]), s := rng.randrange(3000), s + rng.randrange(1, 90)) for _ in range(300)]
    df = spark.createDataFrame(rows, "f string, chrom string, start long, end long")
    for rate, points in ((0.5, 0.3), (1.0, 1.0), (0.0, 0.0), (0.9, 0.5)):
        got = {r.f: (r.n_intervals, r.kept_intervals, r.n_points, r.sampled_points) for r in E.counters(df, ["f"], rate, points).collect()}
        count = lambda e: dict(e.groupBy("f").count().collect())
        kept, sampled = count(E.interval_elements(df, ["f"], rate)), count(E.point_elements(df, ["f"], points))
        for f in "ab":
            own = [r for r in rows if r[0] == f]
            assert got[f] == (len(own), kept.get(f, 0), sum(r[3] - r[2] for r in own), sampled.get(f, 0))


def test_scratch_is_dropped_and_clusters_need_a_shared_folder(spark):
    path = session.scratch(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and session.drop_scratch(spark) > 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)

    class Unnamed:
        master = "local-cluster[2,1,1024]"
        getConf = staticmethod(lambda: {})
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})

    cluster = type("Session", (), {"sparkContext": Unnamed})
    with pytest.raises(session.NoSharedFolder):
        session.shared_dir(cluster)
    with pytest.raises(files.InputError, match="path of this machine"):
        files.located(cluster, "out.csv")
    assert files.located(cluster, "s3a://x/out.csv") == "s3a://x/out.csv" and files.located(spark, "/out.csv") == "file:///out.csv"


def test_the_package_sketches_and_compares(spark):
    df = spark.createDataFrame([("a", *r) for r in A] + [("b", *r) for r in B], "f string, chrom string, start long, end long")
    both = written(overlapse.sketch(df, ["f"], 14), "api")
    pair = overlapse.pairwise(both.where("f = 'a'"), both.where("f = 'b'"), ["f"], 14).first()
    assert pair.jaccard_similarity_ie == pytest.approx(0.5334865217816395, rel=1e-12)
    assert dict(overlapse.cardinalities(both, ["f"], 14).collect())["a"] == pytest.approx(696.6116019118379, rel=1e-12)
    whole = overlapse.sketch(df, ["f"], 12, "A")
    assert dict(overlapse.cardinalities(whole, ["f"], 12).collect())["a"] == pytest.approx(6.004408886394782, rel=1e-12)


def test_catalogue(spark):
    rows = spark.createDataFrame([("m1", "r1", "s1", 1), ("m1", "r1", "s1", 2), ("m1", "r2", "s2", 1), ("m2", "r1", "s1", 1), (None, "r1", "s3", 1)], "m string, r string, s string, t int")
    totals = {(r.m, r.r, r.level): (r.n_rows, r.n_items) for r in catalog.rollup_counts(rows, ["m", "r"], "s").collect()}
    assert totals[None, None, 3] == (5, 3) and totals["m1", None, 1] == (3, 2) and totals[None, "r1", 0] == (1, 1)
    assert [tuple(r) for r in catalog.top_shared(rows, "m", "r", ["r1", "r2"], 5).collect()] == [("m1", 1, 3)]
    assert {(r.s, r.t) for r in catalog.last_of(rows, ["s"], ["t"]).collect()} == {("s1", 2), ("s2", 1), ("s3", 1)}
    assert catalog.split_rows(spark.createDataFrame([("a, b,,c ",)], "x string"), "x", "y").count() == 3
    one = spark.createDataFrame([("  Some  TEXT-1 ",)], "x string").select(catalog.normalised(F.col("x")), catalog.slug(F.col("x"))).first()
    assert tuple(one) == ("some text-1", "some_text_1")
    years = spark.createDataFrame([(1, 2001), (2, 2002), (3, 2002), (4, None), (5, 2005)], "seq int, year int")
    assert sorted(r.seq for r in catalog.series_faults(years, [], "year").collect()) == [3, 4]


def test_exact_interval_jaccard(spark):
    rows = spark.createDataFrame([("a", *r) for r in A] + [("b", *r) for r in B] + [("b", "chr1", 460, 700)], "f string, chrom string, start long, end long")
    (r,) = exact.interval_jaccard(rows.where("f = 'a'"), rows.where("f = 'b'"), ["f"]).collect()
    assert (r.intersection, r.union_bases) == (500, 950) and r.jaccard == pytest.approx(0.5263157894736842)
    assert r.n_intersections == 4
    edge = 1 << 22
    cut = spark.createDataFrame([("a", "c", 10, edge), ("a", "c", edge, edge + 50), ("a", "c", edge + 60, 2 * edge + 5), ("b", "c", 0, edge + 55), ("b", "c", edge + 70, 3 * edge), ("b", "c", 5, 6)], "f string, chrom string, start long, end long")
    (r,) = exact.interval_jaccard(cut.where("f = 'a'"), cut.where("f = 'b'"), ["f"]).collect()
    assert (r.n_intersections, r.intersection) == (2, edge + 40 + edge - 65)
    wide = spark.createDataFrame([("a", "c", 0, 10**7), ("b", "c", 5, 9_000_000)], "f string, chrom string, start long, end long")
    assert exact.interval_jaccard(wide.where("f = 'a'"), wide.where("f = 'b'"), ["f"]).first().intersection == 8_999_995


def test_minimizers(spark):
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(9000))
    rows = spark.createDataFrame([("a", seq), ("b", seq.lower()), ("c", seq[:40]), ("d", ""), ("e", None), ("f", "N" * 60), ("g", seq[:47])], "k string, seq string")
    got = {}
    for r in sequences.minimizers(rows, ["k"]).collect():
        got.setdefault(r.k, set()).add(r.h)
    assert got["a"] == got["b"] and len(got["c"]) == 1 and len(got["g"]) == 1 and len(got["f"]) == 1 and "d" not in got and "e" not in got
    hashes = [r[0] & 0xFFFFFFFF for r in spark.createDataFrame([(seq[i : i + 8],) for i in range(len(seq) - 7)], "s string").select(F.xxhash64("s")).collect()]
    assert got["a"] == {min(hashes[i : i + 40]) for i in range(len(hashes) - 39)}
    kmers = {r.kmer for r in sequences.kmers(rows.where("k = 'a'"), ["k"], 5).collect()}
    comp = str.maketrans("ACGT", "TGCA")
    assert kmers == {min(s, s[::-1].translate(comp)) for s in (seq[i : i + 5] for i in range(len(seq) - 4))}


def test_extraction_over_chunks(spark):
    seq = "".join(random.Random(2).choice("ACGTN") for _ in range(1000))
    ref = files.chunked(spark.createDataFrame([("c1 text", seq), ("c2", "acgt")], "name string, seq string"), width=64)
    rows = spark.createDataFrame([("f", "c1", 0, 10), ("f", "c1", 60, 200), ("f", "c1", 60, 200), ("f", "c1", 990, 1010), ("f", "c2", 1, 3), ("f", "zz", 1, 3)], "f string, chrom string, start long, end long")
    got = sorted((r.chrom, r.start, r.seq) for r in sequences.extract(rows, ref, ["f"], width=64).collect())
    assert got == sorted([("c1", 0, seq[:10]), ("c1", 60, seq[60:200]), ("c1", 60, seq[60:200]), ("c1", 990, seq[990:]), ("c2", 1, "cg")])
    assert [tuple(r) for r in sequences.unknown_chromosomes(rows, ref).collect()] == [("zz", 1)]
    assert tuple(sequences.extraction_faults(rows, ref, ["f"], 64).first()) == ("f", 6, 1, 1)
    share = sequences.share_of_n(sequences.extract(rows.limit(1), ref, ["f"], width=64), ["f"]).first()
    assert share.n_share == pytest.approx(seq[:10].count("N") / 10)


def test_streamed_registers_equal_batch(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 3).alias("f"), (F.col("id") % 1500).cast("string").alias("element"))
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, run_registers(stream, ["f"], 8).collect()))
    assert got == sorted(map(tuple, R.registers(rows, ["f"], 8).collect()))


def test_union_is_elementwise_maximum_and_monotone(spark):
    rows = spark.range(6000).select((F.col("id") % 2).alias("f"), F.col("id").cast("string").alias("element"))
    parts = R.registers(rows, ["f"], 10)
    whole = R.registers(rows.withColumn("f", F.lit(0)), ["f"], 10)
    merged = R.merge(parts.withColumn("f", F.lit(0)), ["f"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    one = {r.f: r.cardinality for r in R.cardinality(parts, ["f"], 10).collect()}
    assert R.cardinality(merged, ["f"], 10).first().cardinality >= max(one.values())
