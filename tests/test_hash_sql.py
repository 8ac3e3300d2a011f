"""The SQL of the hashes against the reference implementation."""

import duckdb
import pytest
import xxhash

from overlapse.plans import hash_sql as H

TEXTS = ["", "a", "abc", "chr1", "chr1\t100", "chrX\t123456", "chr1\t20000\t20050\tA", "x" * 31, "é1234567", "12345678", "1234567890123456"]


@pytest.fixture(scope="module")
def table():
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, s VARCHAR, a VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, 'clash')", list(enumerate([*TEXTS, "y" * 32, "z" * 71, "é" * 50])))
    return con


def test_short_and_long_texts(table):
    rows = table.sql(f"SELECT s, {H.xxh64('s', long_texts=True)}, {H.signed(H.xxh64('s', long_texts=True))}, {H.xxh64('s', seed=7)} FROM t").fetchall()
    for s, h, signed, seven in rows:
        want = xxhash.xxh64_intdigest(s.encode(), 42)
        assert (h, signed) == (want, want - (1 << 64) if want >> 63 else want)
        assert len(s.encode()) > 31 or seven == xxhash.xxh64_intdigest(s.encode(), 7)


def test_gates_and_chained_numbers(table):
    for s, g in table.sql(f"SELECT s, {H.xxh32('s')} FROM t WHERE i < {len(TEXTS)}").fetchall():
        assert g == xxhash.xxh32_intdigest(s.encode(), 31337)
    first = xxhash.xxh64_intdigest(b"chr1", 42)
    second = xxhash.xxh64_intdigest((100).to_bytes(8, "little"), first)
    assert table.sql(f"SELECT {H.xxh64('s', '100', '250')} FROM t WHERE s = 'chr1'").fetchall() == [(xxhash.xxh64_intdigest((250).to_bytes(8, "little"), second),)]
