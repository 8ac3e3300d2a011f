"""Covered periods and gaps in keyed state."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from overlapse.streaming import coverage as C

SCHEMA = "file_id long, chrom string, start_pos long, end_pos long, start string"


def brute(rows):
    """{entity: (periods, gaps)} of valid rows, position by position."""
    covered = {}
    for f, c, s, e in rows:
        if f is not None and c is not None and s is not None and e is not None and 0 <= s < e:
            covered.setdefault(f"{f}:{c}", []).append((s, e))
    out = {}
    for k, ivs in covered.items():
        periods = []
        for s, e in sorted(ivs):
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out[k] = {tuple(p) for p in periods}, {(a[1], b[0]) for a, b in zip(periods, periods[1:])}
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)), max_size=40))
def test_insertions_keep_disjoint_ordered_intervals(items):
    m = C.IntervalMap()
    for s, n in items:
        m.insert(s, s + n)
    want = brute([(1, "c", s, s + n) for s, n in items]).get("1:c", (set(), set()))[0]
    assert list(zip(m.starts, m.ends)) == sorted(want)
    assert m.gap_starts == m.ends[:-1] and m.gap_ends == m.starts[1:]


def stream(spark, tmp_path, parts, name, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    for i, part in enumerate(parts):
        rows = [(*r, "clash") for r in part]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    rows = spark.readStream.schema(schema).options(**options).parquet(str(tmp_path / name))
    ok = F.col("file_id").isNotNull() & C.valid_interval(F.col("chrom"), F.col("start_pos"), F.col("end_pos"))
    return rows.where(ok).select(
        F.concat_ws(":", F.col("file_id").cast("string"), "chrom").alias("entity"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end")
    )


def results(table, width=256):
    gaps, periods = C.gaps(table).collect(), C.periods(table, width).collect()
    out = {}
    for r in periods:
        out.setdefault(r.entity, (set(), set()))[0].add((r.period_start, r.period_end))
    for r in gaps:
        out[r.entity][1].add((r.gap_start, r.gap_end))
    assert len(gaps) == sum(len(g) for _, g in out.values()) and len(periods) == sum(len(p) for p, _ in out.values())
    return out


def test_batches_tiles_and_odd_rows(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randint(1, 3), rng.choice(["chr1", "1", "a:b"]), s := rng.randint(0, 5000), s + rng.choice([1, 5, 40, 900])) for _ in range(900)]
    rows += rows[:50]  # repeated rows
    rows += [(1, "chr1", 0, 10**12), (9, "x", 5, 6), (9, "x", 6, 7), (9, "x", 8, 9)]  # nesting, touching, a gap of one
    odd = [(None, "chr1", 1, 2), (1, None, 1, 2), (1, "chr1", None, 2), (1, "chr1", 1, None), (1, "chr1", -1, 2), (1, "chr1", 5, 5), (1, "chr1", 6, 5)]
    rng.shuffle(rows)
    want = brute(rows + odd)
    one = C.run_to_table(stream(spark, tmp_path, [rows + odd], "one"), width=256, shards=5)
    assert results(one) == want
    parts = [rows[i::4] + odd for i in range(4)]
    many = C.run_to_table(stream(spark, tmp_path, parts, "many", maxFilesPerTrigger=1), width=256, shards=5)
    assert many.select("batch").distinct().count() > 1
    assert results(many) == want


def test_hot_entity_is_spread_over_tiles(spark, tmp_path):
    rows = [(1, "hot", i * 10, i * 10 + 5) for i in range(3000)] + [(2, "cold", 1, 2)]
    table = C.run_to_table(stream(spark, tmp_path, [rows], "hot"), width=1000, shards=16)
    assert table.where("entity = '1:hot'").count() == 30
    assert results(table) == brute(rows)


def test_empty_table(spark, tmp_path):
    table = C.run_to_table(stream(spark, tmp_path, [[]], "none"))
    assert C.gaps(table).count() == 0 and C.periods(table).count() == 0
