"""HyperLogLog registers as tables: (keys, idx, rho) with one row per filled register.

The index is the low p bits of an element's hash, rho one more than the trailing zeros of the rest;
a register keeps the maximum.  Registers of parts merge by maximum, so partial aggregation, late
rows and incremental refresh need no more than ``groupBy(...).max``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlapse.functions import estimators
from overlapse.functions.hashing import BITS, P64_1, P64_2, P64_3, P64_4, P64_5, SEED, hashed, xxh64_bytes
from overlapse.operators.elements import SEPARATOR

LOWEST, HIGHEST = 4, 24
#: Bytes of dense sketches a task holds before it gives them out, and gives out at once.
HELD_BYTES, GIVEN_BYTES = 256 << 20, 16 << 20
#: Positions of one key that a task folds, and positions hashed at once.
TASK_POSITIONS, CHUNK = 20_000_000, 1 << 15


def checked_precision(p: int) -> int:
    if not LOWEST <= p <= HIGHEST:
        raise ValueError(f"precision must lie in [{LOWEST}, {HIGHEST}], not {p}")
    return p


def index_of(h: Column, p: int) -> Column:
    return h.bitwiseAND(F.lit((1 << p) - 1).cast("bigint")).cast("int")


def rho_of(h: Column, p: int, bits: int = 64) -> Column:
    rest = F.shiftrightunsigned(h, p)
    zeros = F.bit_count(rest.bitwiseAND(-rest) - 1)
    return F.when(rest == 0, bits - p + 1).otherwise(zeros + 1).cast("tinyint")


def checked(regs: DataFrame, p: int, bits: int = 64) -> DataFrame:
    """``regs``, unless they say they are of another precision or hash width than ``p`` and ``bits``.

    Tables of registers carry both in the metadata of ``rho``, through selections, joins and Parquet; tables
    from elsewhere carry none and are taken as they come.
    """
    made = regs.schema["rho"].metadata
    if made and (made["p"], made["bits"]) != (p, bits):
        raise ValueError(f"registers of precision {made['p']} and {made['bits']} hash bits where {p} and {bits} are needed")
    return regs


def registers_of_hashes(hashes: DataFrame, keys: Sequence[str], p: int, column: str = "h", bits: int = 64) -> DataFrame:
    """Registers from a column of hashes."""
    checked_precision(p)
    h = F.col(column)
    return hashes.select(*keys, index_of(h, p).alias("idx"), rho_of(h, p, bits).alias("rho")).groupBy(*keys, "idx").agg(F.max("rho").alias("rho", metadata={"p": p, "bits": bits}))


def registers(elements: DataFrame, keys: Sequence[str], p: int, kind: str = "xxh64", seed: int = SEED) -> DataFrame:
    """Registers of each key's set of ``element`` texts; null elements are no elements."""
    some = elements.where(F.col("element").isNotNull())
    return registers_of_hashes(some.select(*keys, hashed(F.col("element"), kind, seed).alias("h")), keys, p, "h", BITS[kind])


def merge(regs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of sets that fall together under ``keys``."""
    return regs.groupBy(*keys, "idx").agg(F.max("rho").alias("rho", metadata=regs.schema["rho"].metadata))


def histogram(regs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rho, n): filled registers by value."""
    return regs.groupBy(*keys, "rho").agg(F.count(F.lit(1)).alias("n"))


def counts_array(pairs: Column, p: int, bits: int = 64) -> Column:
    """Counts of 0, 1, ..., q + 1 from a map of value to count of filled registers."""
    top = bits - p + 1
    filled = F.aggregate(F.map_values(pairs), F.lit(0).cast("bigint"), lambda a, b: a + b)
    zero = F.array(F.lit(1 << p).cast("bigint") - filled)
    rest = F.transform(F.sequence(F.lit(1), F.lit(top)), lambda k: F.coalesce(F.element_at(pairs, k.cast("tinyint")), F.lit(0).cast("bigint")))
    return F.concat(zero, rest)


def sketch_statistics(regs: DataFrame, keys: Sequence[str], p: int, bits: int = 64) -> DataFrame:
    """(keys, filled, counts, cardinality) of each sketch that has a filled register."""
    pairs = F.map_from_entries(F.collect_list(F.struct("rho", "n")))
    by = histogram(checked(regs, p, bits), keys).groupBy(*keys).agg(pairs.alias("pairs"), F.sum("n").alias("filled"))
    counted = by.select(*keys, "filled", counts_array(F.col("pairs"), p, bits).alias("counts"))
    return counted.withColumn("cardinality", estimators.cardinality(F.col("counts"), p, bits))


def cardinality(regs: DataFrame, keys: Sequence[str], p: int, bits: int = 64, every: DataFrame | None = None) -> DataFrame:
    """(keys, cardinality); keys of ``every`` without registers get exactly 0."""
    some = sketch_statistics(regs, keys, p, bits).select(*keys, "cardinality")
    if every is None:
        return some
    return every.select(*keys).distinct().join(some, list(keys), "left").select(*keys, F.coalesce("cardinality", F.lit(0.0)).alias("cardinality"))


def dense(regs: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """(keys, sketch): each sketch's 2^p registers as bytes.

    A key's registers are brought together in order of the key, and a task fills one sketch after another as
    they pass, so no list of them is ever held.
    """
    size = 1 << checked_precision(p)
    kinds = dict(regs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", sketch binary"

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, cells = None, np.zeros(size, np.uint8)
        for pdf in batches:
            codes = pdf.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
            idx, rho = pdf["idx"].to_numpy(), pdf["rho"].to_numpy().astype(np.uint8)
            bounds = np.append(np.flatnonzero(np.append(True, codes[1:] != codes[:-1])), len(codes))
            done = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                key = tuple(None if pd.isna(pdf[k].iat[lo]) else pdf[k].iat[lo] for k in keys)
                if key != open_key:
                    if open_key is not None:
                        done.append((*open_key, cells.tobytes()))
                    open_key, cells = key, np.zeros(size, np.uint8)
                cells[idx[lo:hi]] = rho[lo:hi]
            if done:
                yield pd.DataFrame(done, columns=[*keys, "sketch"])
        if open_key is not None:
            yield pd.DataFrame([(*open_key, cells.tobytes())], columns=[*keys, "sketch"])

    return regs.select(*keys, "idx", "rho").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(fill, schema)


def sparse(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The filled registers of ``dense`` sketches."""
    kinds = dict(sketches.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", idx int, rho tinyint"

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for *key, sketch in pdf[[*keys, "sketch"]].itertuples(index=False):
                cells = np.frombuffer(sketch, np.int8)
                idx = np.flatnonzero(cells)
                yield pd.DataFrame({**{k: [v] * len(idx) for k, v in zip(keys, key)}, "idx": idx.astype(np.int32), "rho": cells[idx]})

    return sketches.mapInPandas(filled, schema)


def merged_intervals(intervals: DataFrame, keys: Sequence[str], tile: int = 1 << 22) -> DataFrame:
    """(keys, chrom, start, end, continued): disjoint intervals that cover the same positions, per key, chromosome
    and tile of the axis.  Intervals are cut at tile borders, so a long chromosome or a hot file is spread over
    many windows; ``continued`` tells those that go on from the tile before."""
    from pyspark.sql import Window

    # An interval that ends at a border leaves an empty piece beyond it, which touches what starts there.
    tiles = F.explode(F.sequence(F.expr(f"start div {tile}"), F.expr(f"end div {tile}"))).alias("tile")
    cut = (
        intervals.where("start < end")
        .select(*keys, "chrom", "start", "end", tiles)
        .select(
            *keys, "chrom", "tile", F.greatest("start", F.col("tile") * tile).alias("start"), F.least("end", (F.col("tile") + 1) * tile).alias("end"),
            (F.col("start") < F.col("tile") * tile).alias("continued"),
        )
    )
    over = Window.partitionBy(*keys, "chrom", "tile").orderBy("start", "end")
    reach = F.max("end").over(over.rowsBetween(Window.unboundedPreceding, -1))
    fresh = cut.withColumn("fresh", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    island = fresh.withColumn("island", F.sum("fresh").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    whole = island.groupBy(*keys, "chrom", "tile", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("continued").alias("continued"))
    return whole.where("start < end").select(*keys, "chrom", "start", "end", "continued")


#: Positions are hashed in blocks of this many, in which all digits but the last four stay the same.
TENS = 10**4
_U = np.uint64
_DIGITS = np.frombuffer("".join(f"{i:04d}" for i in range(TENS)).encode(), np.uint8).reshape(TENS, 4).astype(_U)
_LAST = np.ascontiguousarray((_DIGITS * _U(P64_5)).T)


def _turn(h: np.ndarray, by: int) -> None:
    high = h >> _U(64 - by)
    h <<= _U(by)
    h |= high


def _number(rows: np.ndarray) -> np.ndarray:
    """The little-endian numbers of up to eight bytes in the rows of a matrix."""
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view("<u8")[:, 0].astype(_U)


class Blocks:
    """XXH64 of texts that share all but their last four digits within a block: what comes before is
    hashed once for each block, the rest for each position from tables of the 10^4 endings."""

    def __init__(self, prefixes: np.ndarray, seed: int) -> None:
        count, n = prefixes.shape
        self.state = np.full(count, _U((seed + P64_5 + n + 4) & ((1 << 64) - 1)))
        done = n // 8 * 8
        with np.errstate(over="ignore"):
            for i in range(0, done, 8):
                word = _number(prefixes[:, i : i + 8]) * _U(P64_2)
                _turn(word, 31)
                self.state ^= word * _U(P64_1)
                _turn(self.state, 27)
                self.state *= _U(P64_1)
                self.state += _U(P64_4)
            # The next word has ``left`` bytes of the prefix and as many digits as it holds beside them.
            left = n - done
            self.long = left >= 4
            self.digits = (8 if self.long else 4) - left
            factor = _U(P64_2 if self.long else P64_1)
            self.word = _number(prefixes[:, done:]) * factor
            places = _U(8) * (_U(left) + np.arange(self.digits, dtype=_U))
            self.table = (_DIGITS[:, : self.digits] << places).sum(axis=1, dtype=_U) * factor

    def hashes(self, of: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """Of block ``of`` and the last four digits ``ending`` of each position."""
        with np.errstate(over="ignore"):
            word = self.word[of]
            word += self.table[ending]
            h = self.state[of]
            if self.long:
                _turn(word, 31)
                word *= _U(P64_1)
                h ^= word
                _turn(h, 27)
                h *= _U(P64_1)
                h += _U(P64_4)
            else:
                h ^= word
                _turn(h, 23)
                h *= _U(P64_2)
                h += _U(P64_3)
            for i in range(self.digits, 4):
                h ^= _LAST[i][ending]
                _turn(h, 11)
                h *= _U(P64_1)
            h ^= h >> _U(33)
            h *= _U(P64_2)
            h ^= h >> _U(29)
            h *= _U(P64_3)
            h ^= h >> _U(32)
        return h


def _folded(cells: np.ndarray, own: np.ndarray, h: np.ndarray, p: int) -> None:
    """Raises the registers of sketches ``own`` (rows of ``cells``) by hashes."""
    at = own * np.int64(cells.shape[1])
    at += (h & _U(cells.shape[1] - 1)).view(np.int64)
    h >>= _U(p)
    with np.errstate(over="ignore"):
        rho = np.minimum(np.bitwise_count(~h & (h - _U(1))) + np.uint8(1), np.uint8(64 - p + 1))
    flat = cells.reshape(-1)
    more = np.flatnonzero(rho > flat[at])
    np.maximum.at(flat, at[more], rho[more])


def _spread(starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, start, length) of the parts of intervals between multiples of ``width``."""
    first = starts // width
    parts = (ends - 1) // width - first + 1
    of = np.repeat(np.arange(len(starts)), parts)
    block = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    lo = np.maximum(starts[of], block * width)
    return of, lo, np.minimum(ends[of], (block + 1) * width) - lo


def _chunks(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(parts, part of each position, its place in the part) for about ``CHUNK`` positions at a time, so that
    what is at hand stays in the processor's cache."""
    before = np.cumsum(n) - n
    for some in np.split(np.arange(len(n)), np.flatnonzero(np.diff(before // CHUNK)) + 1):
        if len(some):
            row = np.repeat(some, n[some])
            yield some, row, np.arange(len(row)) - np.repeat(before[some] - before[some[0]], n[some])


def _fold(cells: np.ndarray, own: np.ndarray, part: pd.DataFrame, p: int, seed: int) -> None:
    """Folds the positions of intervals into the sketches ``own`` they belong to."""
    chrom, names = pd.factorize(part["chrom"])
    texts = [(str(n) + SEPARATOR).encode() for n in names]
    sizes = np.array([len(t) for t in texts], np.int64)
    of, lo, n = _spread(part["start"].to_numpy(np.int64), part["end"].to_numpy(np.int64), TENS)
    block = lo // TENS
    digits = np.where(block > 0, np.searchsorted(10 ** np.arange(1, 15, dtype=np.int64), block, "right") + 1, 0)
    length = sizes[chrom[of]] + digits
    for size, count in {(int(a), int(b)) for a, b in zip(length, digits)}:
        mine = np.flatnonzero((length == size) & (digits == count))
        head = size - count
        heads = np.zeros((len(texts), head), np.uint8)
        for i in np.flatnonzero(sizes == head).tolist():
            heads[i] = np.frombuffer(texts[i], np.uint8)
        if not count:
            # Positions of one to four digits.
            for some, row, place in _chunks(n[mine]):
                at = lo[mine][row] + place
                for k in range(1, 5):
                    few = np.flatnonzero((at >= 10 ** (k - 1) if k > 1 else at >= 0) & (at < 10**k))
                    if len(few):
                        rows = np.empty((len(few), head + k), np.uint8)
                        rows[:, :head] = heads[chrom[of[mine[row[few]]]]]
                        rows[:, head:] = _DIGITS[at[few], 4 - k :]
                        _folded(cells, own[of[mine[row[few]]]], xxh64_bytes(rows, seed), p)
            continue
        prefixes = np.empty((len(mine), size), np.uint8)
        prefixes[:, :head] = heads[chrom[of[mine]]]
        rest = block[mine].copy()
        for i in range(size - 1, head - 1, -1):
            rest, digit = np.divmod(rest, 10)
            prefixes[:, i] = digit + 48
        blocks, owner, ending = Blocks(prefixes, seed), own[of[mine]], lo[mine] % TENS
        for _, row, place in _chunks(n[mine]):
            place += ending[row]
            _folded(cells, owner[row], blocks.hashes(row, place), p)


def point_sketches(intervals: DataFrame, keys: Sequence[str], p: int, seed: int = SEED) -> DataFrame:
    """(keys, sketch): dense sketches of all covered positions (mode B, every position), without a
    row per position.

    A key's intervals go to one task, or to one for each ``TASK_POSITIONS`` of its positions.  A task folds them
    into one sketch per key and gives them out at its end, or when it holds ``HELD_BYTES`` of them; a key's
    partial sketches are merged by maximum in two steps, so that no group gathers more than a slice of them.
    Chromosome names too long for the short-text kernel take the path through rows.
    """
    from overlapse.operators.elements import point_elements

    size = 1 << checked_precision(p)
    most = max(1, HELD_BYTES // size)
    kinds = dict(intervals.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", sketch binary"
    fits = F.octet_length("chrom") <= 11
    flat = intervals.where(fits & (F.col("start") < F.col("end"))).select(*keys, "chrom", "start", "end")
    spans = flat.groupBy(*(F.col(k).alias(f"_g_{k}") for k in keys)).agg((F.expr(f"sum(end - start) div {TASK_POSITIONS}") + 1).alias("_parts"))
    same = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    salt = F.pmod(F.xxhash64("chrom", "start", "end"), F.col("_parts"))
    near = flat.join(spans, same).select(*keys, "chrom", "start", "end", salt.alias("_salt")).repartition(*keys, "_salt").drop("_salt")

    def rows(known: list[tuple], cells: np.ndarray) -> Iterator[pd.DataFrame]:
        step = max(1, GIVEN_BYTES // size)
        for lo in range(0, len(known), step):
            some = known[lo : lo + step]
            named = {k: [key[i] for key in some] for i, k in enumerate(keys)}
            yield pd.DataFrame({**named, "sketch": [c.tobytes() for c in cells[lo : lo + len(some)]]})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, int] = {}
        cells = np.zeros((1, size), np.uint8)
        for pdf in batches:
            codes = pdf.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
            own = [tuple(r) for r in pdf.loc[~pd.Series(codes).duplicated().to_numpy(), list(keys)].astype(object).itertuples(index=False)]
            for first in range(0, len(own), most):
                some = own[first : first + most]
                if len(known) + sum(key not in known for key in some) > most:
                    yield from rows(list(known), cells)
                    known, cells = {}, np.zeros((1, size), np.uint8)
                for key in some:
                    known.setdefault(key, len(known))
                if len(known) > len(cells):
                    grown = np.zeros((min(most, max(len(known), 2 * len(cells))), size), np.uint8)
                    grown[: len(cells)] = cells
                    cells = grown
                place = np.array([known[key] for key in some])
                mine = (codes >= first) & (codes < first + len(some))
                _fold(cells, place[codes[mine] - first], pdf[mine], p, seed)
        if known:
            yield from rows(list(known), cells)

    parts = near.mapInPandas(partial, schema)
    long = dense(registers(point_elements(intervals.where(~fits), keys), keys, p, "xxh64", seed), keys, p)
    return merged_sketches(parts.unionByName(long), keys)


def merged_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One dense sketch per key: the union of all it has."""
    kinds = dict(sketches.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def union(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.frombuffer(pdf["sketch"].iloc[0], np.uint8).copy()
        for other in pdf["sketch"].iloc[1:]:
            np.maximum(cells, np.frombuffer(other, np.uint8), out=cells)
        return pd.DataFrame([[*key[: len(keys)], cells.tobytes()]], columns=[*keys, "sketch"])

    sliced = sketches.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(32)))
    once = sliced.groupBy(*keys, "_slice").applyInPandas(union, schema + ", sketch binary")
    return once.groupBy(*keys).applyInPandas(union, schema + ", sketch binary")


def point_registers(intervals: DataFrame, keys: Sequence[str], p: int, seed: int = SEED) -> DataFrame:
    """The filled registers of ``point_sketches``."""
    return sparse(point_sketches(intervals, keys, p, seed), keys)
