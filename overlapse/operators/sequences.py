"""Sequences: k-mers, window minimizers and extraction of intervals from a reference.

The selector hash of a k-mer is the low 32 bits of its XXH64 (upper case); a window is w consecutive
k-mers; a record shorter than k + w - 1 has no minimizer and counts as one element.  Values of other
minimizer schemes aren't claimed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapse.functions.hashing import xxh64, xxh64_bytes
from overlapse.sources.files import CHUNK

COMPLEMENT = ("ACGT", "TGCA")
#: Characters of a record that one row handles.
PIECE = 1 << 20
#: Characters of records a task handles at once.
BATCH_CHARS = 1 << 21


def _record_pieces(records: DataFrame, keys: Sequence[str], seq: str, overlap: int, piece: int = PIECE) -> DataFrame:
    """Upper-case pieces of long records that overlap, so that every window lies whole in one."""
    upper = F.upper(F.coalesce(F.col(seq), F.lit("")))
    last = F.greatest(F.lit(0), F.expr(f"(length(_s) - {overlap} - 1) div {piece}")).cast("int")
    return (
        records.select(*keys, upper.alias("_s"))
        .select(*keys, "_s", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
        .select(*keys, F.when(F.col("_i") + F.length("_s") <= piece, F.col("_s")).otherwise(F.substring("_s", F.col("_i") * piece + 1, F.lit(piece + overlap))).alias("part"))
    )


class Joined:
    """Texts of one batch end to end: UTF-8 bytes, where characters start in them, and where texts do."""

    def __init__(self, texts: Sequence[str]) -> None:
        self.bytes = np.frombuffer("".join(texts).encode(), np.uint8)
        self.starts = np.append(np.flatnonzero((self.bytes & 0xC0) != 0x80), len(self.bytes))
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_of = np.repeat(np.arange(len(texts)), self.lengths)
        self.left = np.repeat(np.cumsum(self.lengths), self.lengths) - np.arange(len(self.text_of))

    def places(self, span: int) -> np.ndarray:
        """Characters with at least ``span`` left in their text, themselves included."""
        return np.flatnonzero(self.left >= span)

    def hashes(self, k: int, seed: int) -> np.ndarray:
        """XXH64 of the k characters from each on, whatever text they belong to."""
        n = len(self.starts) - k
        if n <= 0:
            return np.empty(0, np.uint64)
        at, sizes = self.starts[:n], self.starts[k:] - self.starts[:n]
        out = np.empty(n, np.uint64)
        for size in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == size)
            windows = np.lib.stride_tricks.sliding_window_view(self.bytes, size)
            for lo in range(0, len(mine), 1 << 15):
                some = mine[lo : lo + (1 << 15)]
                rows = windows[at[some]]
                if size < 32:
                    out[some] = xxh64_bytes(rows, seed)
                else:
                    out[some] = [xxhash.xxh64_intdigest(r.tobytes(), seed) for r in rows]
        return out


def _batches(table: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Joined]]:
    """Slices of a batch of bounded text size; a longer piece is a slice of its own."""
    texts = table.column(table.num_columns - 1).to_pylist()
    ends = np.cumsum([len(t) for t in texts])
    for no in np.unique(ends // BATCH_CHARS).tolist():
        lo, hi = np.searchsorted(ends // BATCH_CHARS, [no, no + 1])
        yield table.slice(lo, hi - lo), Joined(texts[lo:hi])


def _keyed(part: pa.RecordBatch, at: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    kept = part.select(part.schema.names[:-1]).take(pa.array(at))
    return pa.RecordBatch.from_arrays([*kept.columns, *columns.values()], [*kept.schema.names, *columns])


def _schema(records: DataFrame, keys: Sequence[str], more: str) -> str:
    kinds = dict(records.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), more])


def kmers(records: DataFrame, keys: Sequence[str], k: int, seq: str = "seq", canonical: bool = True) -> DataFrame:
    """(keys, kmer): the distinct k-mers of each key; those with an N are left out, and of a k-mer and
    its reverse complement the smaller stands for both."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, joined in _batches(batch):
                at = joined.places(k)
                if not len(at):
                    continue
                codes = np.frombuffer(joined.bytes.tobytes().decode().encode("utf-32-be"), ">u4").astype(np.uint32)
                rows = np.lib.stride_tricks.sliding_window_view(codes, k)[at]
                known = ~(rows == ord("N")).any(axis=1)
                rows, of = rows[known], joined.text_of[at[known]]
                text = lambda m: np.ascontiguousarray(m.astype(">u4")).view(f"S{4 * k}")[:, 0]
                one = text(rows)
                if canonical:
                    other = rows[:, ::-1].copy()
                    for base, pair in zip(*COMPLEMENT):
                        other[rows[:, ::-1] == ord(base)] = ord(pair)
                    other = text(other)
                    one = np.where(other < one, other, one)
                both = pd.DataFrame({"of": of, "kmer": one}).drop_duplicates()
                whole = b"".join(x.ljust(4 * k, b"\0") for x in both["kmer"].tolist()).decode("utf-32-be")
                yield _keyed(part, both["of"].to_numpy(), kmer=pa.array([whole[i : i + k] for i in range(0, len(whole), k)], pa.string()))

    return _record_pieces(records, keys, seq, k - 1).mapInArrow(found, _schema(records, keys, "kmer string")).distinct()


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by least values up to and from the borders of blocks of w."""
    n = len(h) - w + 1
    if n <= 0:
        return h[:0]
    padded = np.concatenate([h, np.full(-len(h) % w, np.iinfo(h.dtype).max, h.dtype)]).reshape(-1, w)
    upto = np.minimum.accumulate(padded, axis=1).ravel()
    since = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[:n], upto[w - 1 : w - 1 + n])


def minimizers(records: DataFrame, keys: Sequence[str], k: int = 8, w: int = 40, seq: str = "seq", seed: int = 42) -> DataFrame:
    """(keys, h): the distinct window minimizers of each key, and the whole hash of each record too
    short for any; empty records give nothing."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, joined in _batches(batch):
                at = joined.places(k + w - 1)
                if len(at):
                    least = window_minima(joined.hashes(k, seed) & np.uint64(0xFFFFFFFF), w)[at].astype(np.int64)
                    of = joined.text_of[at]
                    fresh = np.append(True, (of[1:] != of[:-1]) | (least[1:] != least[:-1]))
                    both = pd.DataFrame({"of": of[fresh], "h": least[fresh]}).drop_duplicates()
                    yield _keyed(part, both["of"].to_numpy(), h=pa.array(both["h"].to_numpy()))

    long = records.where(F.length(seq) >= k + w - 1)
    short = records.where((F.length(seq) < k + w - 1) & (F.col(seq) != "")).select(*keys, xxh64(F.upper(seq), seed).alias("h"))
    pieces = _record_pieces(long, keys, seq, k + w - 2)
    return pieces.mapInArrow(found, _schema(records, keys, "h long")).unionByName(short).distinct()


def extract(intervals: DataFrame, reference: DataFrame, keys: Sequence[str], width: int = CHUNK) -> DataFrame:
    """(keys, chrom, start, end, seq): the bases [start, end) of each interval from a chunked
    reference.  An interval meets only the chunks it covers; a part beyond the chromosome's end is
    missing, and an interval on an unknown chromosome doesn't appear (see ``unknown_chromosomes``)."""
    numbered = intervals.select(*keys, "chrom", "start", "end").withColumn("_row", F.monotonically_increasing_id())
    chunks = F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}"))).alias("chunk_no")
    met = numbered.select("*", chunks).join(reference, ["chrom", "chunk_no"])
    offset = F.col("chunk_no") * width
    lo = F.greatest(F.col("start") - offset, F.lit(0))
    part = F.substring("seq", (lo + 1).cast("int"), (F.least(F.col("end") - offset, F.lit(width)) - lo).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", part.alias("part"))))
    joined = F.array_join(F.transform(parts, lambda p: p["part"]), "")
    return met.groupBy(*keys, "_row", "chrom", "start", "end").agg(joined.alias("seq")).drop("_row")


def unknown_chromosomes(intervals: DataFrame, reference: DataFrame) -> DataFrame:
    """(chrom, n): intervals whose chromosome the reference lacks."""
    names = reference.select("chrom").distinct()
    return intervals.join(names, "chrom", "left_anti").groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


def extraction_faults(intervals: DataFrame, reference: DataFrame, keys: Sequence[str], width: int = CHUNK) -> DataFrame:
    """(keys, n_intervals, unknown, beyond): of each key, the intervals on chromosomes the reference lacks, and those
    that reach beyond their chromosome's end.  Without either, ``extract`` gives every interval whole."""
    ends = reference.groupBy("chrom").agg(F.max(F.col("chunk_no") * width + F.length("seq")).alias("_length"))
    placed = intervals.join(ends, "chrom", "left")
    return placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_intervals"),
        F.count_if(F.col("_length").isNull()).alias("unknown"),
        F.count_if(F.col("end") > F.col("_length")).alias("beyond"),
    )


def share_of_n(sequences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_share): how much of the extracted bases is N, over all of them."""
    unknown = F.length("seq") - F.length(F.regexp_replace("seq", "[Nn]", ""))
    return sequences.groupBy(*keys).agg((F.sum(unknown) / F.sum(F.length("seq"))).alias("n_share"))
