"""Similarity of pairs of sketches.

Two physical forms give the same integers.  The sparse one compares filled registers only and suits
sketches with few of them; its result holds the pairs that share one.  The dense one compares every
query with every reference.  Both compare a block of one side with a block of the other at a time.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlapse.functions import estimators
from overlapse.operators.registers import checked

SHAPES = {
    "ie": ("jaccard_similarity_ie",),
    "re": ("reg_eq_similarity",),
    "full": ("reg_eq_similarity", "jaccard_similarity_ie", "containment_ab", "containment_ba", "cosketch_geom", "cosketch_arith", "cosketch_max"),
}
#: Bytes of sketches in a block, bytes of them compared with each other that are worth a task, and the pairs a task compares.
BLOCK_BYTES, TASK_BYTES, TASK_PAIRS = 64 << 20, 1 << 24, 1 << 23
#: Sketches of either side in a tile, their bytes, and registers of them that are compared at once.
TILE, TILE_BYTES, COLUMNS = 256, 16 << 20, 1 << 14
LEAST = 1e-300


def jaccard_from_containments(ab: Column, ba: Column) -> Column:
    """1 / (1/x + 1/y - 1) with both clamped to 1; 0 unless both are positive numbers."""
    ok = ~F.isnan(ab) & ~F.isnan(ba) & (ab > LEAST) & (ba > LEAST)
    x, y = F.least(ab, F.lit(1.0)), F.least(ba, F.lit(1.0))
    return F.when(ok, 1.0 / (1.0 / x + 1.0 / y - 1.0)).otherwise(0.0)


def register_equality() -> Column:
    return F.when(F.col("active") > 0, F.col("matching") / F.col("active")).otherwise(0.0)


def with_metrics(pairs: DataFrame) -> DataFrame:
    """All metrics of pairs that hold matching, active, card_1, card_2 and card_union."""
    shared = F.greatest(F.col("card_1") + F.col("card_2") - F.col("card_union"), F.lit(0.0))
    share = lambda c: F.when(F.col(c) > 0, F.col("shared") / F.col(c)).otherwise(0.0)
    ab, ba = F.col("containment_ab"), F.col("containment_ba")
    return (
        pairs.withColumn("reg_eq_similarity", register_equality())
        .withColumn("shared", shared)
        .withColumn("containment_ab", share("card_1"))
        .withColumn("containment_ba", share("card_2"))
        .withColumn("jaccard_similarity_ie", jaccard_from_containments(ab, ba))
        .withColumn("cosketch_geom", F.sqrt(F.greatest(ab * ba, F.lit(0.0))))
        .withColumn("cosketch_arith", (ab + ba) / 2)
        .withColumn("cosketch_max", F.greatest(ab, ba))
    )


def _renamed(df: DataFrame, keys: Sequence[str], side: int) -> DataFrame:
    return df.withColumnsRenamed({k: f"{k}_{side}" for k in keys})


def sparse_pairs(regs_1: DataFrame, regs_2: DataFrame, keys: Sequence[str], p: int, bits: int = 64) -> DataFrame:
    """Pairs that share a filled register, with matching, active, the cardinalities and metrics.

    The union's histogram is the sum of both sketches' less, for registers filled in both, the smaller value: no union
    is materialised.  Blocks of sketches are compared as in ``dense_pairs``, over those registers that are filled
    on both sides of a tile.  Both tables are counted first and should be written ones.
    """
    k1, k2, top = [f"{k}_1" for k in keys], [f"{k}_2" for k in keys], bits - p + 2
    known = [checked(regs, p, bits).dropna(subset=list(keys)) for regs in (regs_1, regs_2)]
    (n1, filled), (n2, _) = (regs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first() for regs in known)
    grid = _grid(n1, n2, filled * _ROW.itemsize, regs_1.sparkSession.sparkContext.defaultParallelism)

    def opened(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(cells)), [len(c) // _ROW.itemsize for c in cells]), np.frombuffer(b"".join(cells), _ROW)

    def counts(own: np.ndarray, rho: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(own * top + rho, minlength=n * top).reshape(n, top)

    def compared(one: tuple, two: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
        sizes = [int(own[-1]) + 1 for own, _ in (one, two)]
        h1, h2 = (counts(own, r["rho"], n) for (own, r), n in zip((one, two), sizes))
        met = np.intersect1d(*(np.unique(r["idx"]) for _, r in (one, two)), assume_unique=True)
        matching, lows = np.zeros(sizes, np.int64), np.zeros((*sizes, top), np.int64)
        for lo in range(0, len(met), COLUMNS):
            some, parts = met[lo : lo + COLUMNS], []
            for (own, r), n in zip((one, two), sizes):
                at = np.minimum(np.searchsorted(some, r["idx"]), len(some) - 1)
                here = np.flatnonzero(some[at] == r["idx"])
                cells = np.zeros((n, len(some)), np.uint8)
                cells[own[here], at[here]] = r["rho"][here]
                parts.append((cells, counts(own[here], r["rho"][here], n)))
            (a, c1), (b, c2) = parts
            equal, _, union = compare_block(a, b, p, bits)
            matching += equal
            lows += c1[:, None] + c2[None, :] - union
        lows[:, :, 0] = 0
        both = lows.sum(axis=2).ravel()
        at = np.flatnonzero(both)
        i, j = np.divmod(at, sizes[1])
        union = h1[i] + h2[j] - lows.reshape(-1, top)[at]
        active = union.sum(axis=1)
        union[:, 0] = (1 << p) - active
        for h in (h1, h2):
            h[:, 0] = (1 << p) - h.sum(axis=1)
        cards = (estimators.cardinalities(h, p, bits) for h in (h1, h2, union))
        card_1, card_2, card_union = cards
        return at, [matching.ravel()[at], active, card_1[i], card_2[j], card_union]

    numbers = "matching long, active long, card_1 double, card_2 double, card_union double"
    found = _blocked(*(_gathered(regs, keys) for regs in known), keys, grid, numbers, len, opened, compared)
    return with_metrics(found).select(*k1, *k2, "matching", "active", "card_1", "card_2", "card_union", "shared", *SHAPES["full"])


_ROW = np.dtype([("idx", "<i4"), ("rho", "u1")])


def _gathered(regs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _weight, _cells): each sketch's filled registers in one value."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(len(keys))
            ends, rows = np.diff(held.offsets.to_numpy()), held.flatten()
            cells = np.empty(len(rows), _ROW)
            for i, name in enumerate(_ROW.names):
                cells[name] = rows.field(i).to_numpy()
            bounds = np.append(0, ends.cumsum()).tolist()
            packed = [cells[lo:hi].tobytes() for lo, hi in zip(bounds, bounds[1:])]
            columns = [batch.column(i) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ends, pa.int64()), pa.array(packed, pa.binary())], names=[*keys, "_weight", "_cells"])

    rows = regs.groupBy(*keys).agg(F.collect_list(F.struct("idx", "rho")).alias("_rows"))
    return rows.mapInArrow(pack, f"{_key_schema(regs, keys)}, _weight long, _cells binary")


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.float32) @ b.astype(np.float32).T


def _upto(a: np.ndarray, b: np.ndarray, levels: int, top: int) -> np.ndarray:
    """(rows of ``a``, rows of ``b``, ``levels``): in how many columns both are at most 0, 1, ...

    That is a product of two matrices of flags. Where few columns hold small values it needs only those; where few
    hold larger ones, the columns in which both are larger are counted instead.
    """
    out = np.empty((levels, len(a), len(b)), np.int32)
    least, most = np.maximum(a.min(axis=0), b.min(axis=0)), np.minimum(a.max(axis=0), b.max(axis=0))
    own = [np.stack([np.bincount(r, minlength=top)[:top].cumsum() for r in side]) for side in (a, b)]
    for v in range(levels):
        low, high = np.flatnonzero(least <= v), np.flatnonzero(most > v)
        few = low if len(low) <= len(high) else high
        x, y = (side if 4 * len(few) > 3 * len(least) else side[:, few] for side in (a, b))
        if few is low:
            out[v] = _both(x <= v, y <= v) if len(few) else 0
        else:
            out[v] = own[0][:, v, None] + own[1][None, :, v] - a.shape[1]
            if len(few):
                out[v] += _both(x > v, y > v).astype(np.int32)
    return out.transpose(1, 2, 0)


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out, same = np.empty((len(a), len(b)), np.int64), np.empty(b.shape, bool)
    for i, row in enumerate(a):
        bits = np.packbits(np.equal(b, row, out=same), axis=1)
        out[i] = np.bitwise_count(bits.view(np.uint64) if bits.shape[1] % 8 == 0 else bits).sum(axis=1, dtype=np.int64)
    return out


def compare_block(one: np.ndarray, two: np.ndarray, p: int, bits: int = 64, union: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(matching, active, union histograms) of every row of ``one`` with every row of ``two``.

    A union's register is at most v where both are; without the union only v = 0 is needed.
    """
    m, top = one.shape[1], bits - p + 2
    upto = np.zeros((len(one), len(two), top if union else 1), np.int32)
    equal = np.zeros((len(one), len(two)), np.int64)
    for lo in range(0, m if len(one) and len(two) else 0, COLUMNS):
        a, b = (np.ascontiguousarray(side[:, lo : lo + COLUMNS]) for side in (one, two))
        levels = min(upto.shape[2], max(int(a.max()), int(b.max())))
        upto[:, :, :levels] += _upto(a, b, levels, top)
        upto[:, :, levels:] += a.shape[1]
        equal += _equal(a, b)
    empty = upto[:, :, 0].astype(np.int64)
    histogram = np.diff(upto, axis=2, prepend=0).astype(np.int64) if union else None
    return equal - empty, m - empty, histogram


def _grid(n1: int, n2: int, bytes_1: int, parallelism: int) -> tuple[int, int]:
    """Blocks of either side: few, as every block of one is sent to all of the other, but so many that none of the first
    is beyond ``BLOCK_BYTES``, no task has more than ``TASK_PAIRS``, and all cores have work."""
    tasks = max(1, min(3 * parallelism, bytes_1 * n2 // TASK_BYTES), -(-n1 * n2 // TASK_PAIRS))
    blocks = max(1, -(-bytes_1 // BLOCK_BYTES), min(n1, round(math.sqrt(tasks * n1 / max(1, n2)))))
    return blocks, max(1, min(n2, -(-tasks // blocks)))


def _tiles(cells: list[bytes], size_of: Callable[[bytes], int]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of at most ``TILE`` sketches and, but for single ones, ``TILE_BYTES``."""
    lo = held = 0
    for at, one in enumerate(cells):
        if at > lo and (at - lo == TILE or held + size_of(one) > TILE_BYTES):
            yield lo, at
            lo, held = at, 0
        held += size_of(one)
    if lo < len(cells):
        yield lo, len(cells)


def _blocked(
    one: DataFrame, two: DataFrame, keys: Sequence[str], grid: tuple[int, int], numbers: str,
    size_of: Callable[[bytes], int], opened: Callable, compared: Callable,
) -> DataFrame:
    """(keys_1, keys_2, ``numbers``) of sketches of ``one`` with those of ``two``; both hold the keys, ``_weight`` and ``_cells``.

    A task has one block of each side. It holds the first's sketches as they are packed, meets the second's as they
    come, and gives out the pairs of a tile at a time; by order of weight the sketches of a tile are alike.  ``opened``
    unpacks a tile's sketches, ``size_of`` tells the bytes of one; ``compared`` gives the places of the pairs of two tiles
    that are kept (None: all) and their numbers.
    """
    blocks_1, blocks_2 = grid
    hashed, width = F.xxhash64(*keys), len(keys)

    def placed(side: DataFrame, second: bool) -> DataFrame:
        own, other = (blocks_2, blocks_1) if second else (blocks_1, blocks_2)
        spread = side.withColumn("_own", F.pmod(hashed, F.lit(own)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        row, column = ("_other", "_own") if second else ("_own", "_other")
        return spread.select(*keys, "_weight", "_cells", F.lit(second).alias("_second"), (F.col(row) * blocks_2 + F.col(column)).alias("_task"))

    both = placed(one, False).unionByName(placed(two, True)).repartitionById(blocks_1 * blocks_2, "_task").sortWithinPartitions("_second", "_weight")
    schema = ", ".join(_key_schema(_renamed(side, keys, i), [f"{k}_{i}" for k in keys]) for i, side in ((1, one), (2, two))) + f", {numbers}"
    names = [*(f"{k}_{i}" for i in (1, 2) for k in keys), *(n.split()[0] for n in numbers.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[tuple[list[pa.Array], list[bytes]]] = []
        for batch in batches:
            start = pc.sum(pc.invert(batch.column(width + 1))).as_py() or 0
            for begin, rows in ((0, batch.slice(0, start)), (start, batch.slice(start))):
                cells = rows.column(width).to_pylist()
                for lo, hi in _tiles(cells, size_of):
                    columns = [rows.column(i).slice(lo, hi - lo) for i in range(width)]
                    if begin + lo < start:
                        # Copied by ``take``, or they would keep their batch.
                        first.append(([c.take(pa.array(range(len(c)))) for c in columns], cells[lo:hi]))
                        continue
                    b = opened(cells[lo:hi])
                    for named, packed in first:
                        at, found = compared(opened(packed), b)
                        i, j = np.divmod(np.arange(len(packed) * (hi - lo)) if at is None else at, hi - lo)
                        arrays = [c.take(pa.array(i)) for c in named] + [c.take(pa.array(j)) for c in columns]
                        yield pa.RecordBatch.from_arrays([*arrays, *map(pa.array, found)], names=names)

    return both.select(*keys, "_cells", "_second").mapInArrow(run, schema)


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def _packed(sketches: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """Dense sketches, compressed, since each is sent to several tasks."""
    size = 1 << p

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE):
                rows = batch.slice(lo, TILE)
                cells = rows.column("sketch").to_pylist()
                for other in set(map(len, cells)) - {size}:
                    raise ValueError(f"a sketch of {other} registers stands among those of precision {p}")
                weights = pa.array([int(np.frombuffer(c, np.uint8).sum()) for c in cells], pa.int64())
                columns = [rows.column(k) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, weights, pa.array(map(_squeezed, cells), pa.binary())], names=[*keys, "_weight", "_cells"])

    return sketches.select(*keys, "sketch").mapInArrow(pack, f"{_key_schema(sketches, keys)}, _weight long, _cells binary")


def _squeezed(cells: bytes) -> bytes:
    """Registers take few values, and hardly ever in a row."""
    made = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
    return made.compress(cells) + made.flush()


def dense_pairs(
    queries: DataFrame, references: DataFrame, keys: Sequence[str], p: int, bits: int = 64, shape: str = "full"
) -> DataFrame:
    """Every query with every reference; both hold the key columns and ``sketch`` (2^p bytes).

    Both sides are cut into blocks and a task compares one block with another, a tile at a time, so a task's memory doesn't grow
    with the lists, nothing passes through the driver and the plan is the same whatever their lengths.  Both are counted
    first and should be written tables.  A sketch of another length than 2^p is refused.  Shape ``re`` has no
    union and no cardinalities.
    """
    k1, k2 = [f"{k}_1" for k in keys], [f"{k}_2" for k in keys]
    union = shape != "re"
    numbers = "matching long, active long" + (", card_1 double, card_2 double, card_union double" if union else "")
    n1, n2 = queries.count(), references.count()
    grid = _grid(n1, n2, n1 << p, queries.sparkSession.sparkContext.defaultParallelism)

    def opened(cells: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(zlib.decompress, cells)), np.uint8).reshape(len(cells), 1 << p)

    def compared(a: np.ndarray, b: np.ndarray) -> tuple[None, list[np.ndarray]]:
        matching, active, histogram = compare_block(a, b, p, bits, union)
        out = [matching.ravel(), active.ravel()]
        if union:
            out += [np.repeat(_own(a, p, bits), len(b)), np.tile(_own(b, p, bits), len(a))]
            out.append(estimators.cardinalities(histogram.reshape(-1, histogram.shape[2]), p, bits))
        return None, out

    found = _blocked(_packed(queries, keys, p), _packed(references, keys, p), keys, grid, numbers, lambda _: 1 << p, opened, compared)
    if not union:
        return found.select(*k1, *k2, "matching", "active", register_equality().alias("reg_eq_similarity"))
    return with_metrics(found).select(*k1, *k2, "matching", "active", "card_1", "card_2", "card_union", "shared", *SHAPES["full"])


def _own(cells: np.ndarray, p: int, bits: int) -> np.ndarray:
    top = bits - p + 2
    histograms = np.stack([np.bincount(c, minlength=top)[:top] for c in cells]) if len(cells) else np.zeros((0, top), np.int64)
    return estimators.cardinalities(histograms, p, bits)


def shaped(pairs: DataFrame, shape: str, names: Sequence[str]) -> DataFrame:
    """The name columns and the metrics of a result shape; unused work is pruned by the optimiser."""
    return pairs.select(*names, *SHAPES[shape])
