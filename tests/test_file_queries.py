"""Queries over the interval files, list 1 with list 2, against plain Python."""

import pytest

from overlapse.plans import sketch_queries as Q


def test_positions_of_listed_files(spark, tmp_path):
    held = {1: [("1", 0, 150_000), ("1", 140_000, 200_000)], 2: [("1", 100_000, 300_000)], 3: [("1", 250_000, 300_001)], 4: [("2", 5, 9)], 5: [("1", 0, 10)]}
    rows = [(f, *r) for f, rs in held.items() for r in rs] + [(1, None, 1, 2), (2, "1", 9, 9)]
    spark.createDataFrame(rows, "file_id long, chrom string, start_pos long, end_pos long").write.parquet(f"{tmp_path}/intervals.parquet")
    sides = [(1, "interval", "list1"), (2, "interval", "list2"), (3, "interval", "list2"), (4, "interval", "list1"), (5, "archive", "list2")]
    spark.createDataFrame(sides, "file_id long, file_kind string, list_side string").write.parquet(f"{tmp_path}/bed_files.parquet")
    exact = {(r.file_id_1, r.file_id_2): (r.intersection, r.union_bases) for r in Q.exact_files_jaccard(spark, str(tmp_path)).collect()}
    assert exact == {(1, 2): (100_000, 300_000)}
    points, hybrid = ({(r.file_id_1, r.file_id_2): r for r in q(spark, str(tmp_path)).collect()} for q in (Q.pair_points_xxh64, Q.pair_hybrid_xxh64))
    assert set(points) == set(hybrid) == {(a, b) for a in (1, 4) for b in (2, 3)}
    for found in (points, hybrid):
        assert found[1, 2].jaccard_similarity_ie == pytest.approx(1 / 3, abs=0.05) and found[4, 2].jaccard_similarity_ie < 0.01
    assert points[1, 2].containment_ab == pytest.approx(0.5, abs=0.05)
