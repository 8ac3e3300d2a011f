"""Hash functions: XXH64 with any seed as a built-in expression, XXH32 for gates, and a portable one."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The primes of the published xxHash specification.
P64_1, P64_2, P64_3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
P64_4, P64_5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
P32_1, P32_2, P32_3, P32_4, P32_5 = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1

SEED, GATE_SEED = 42, 31337
GATE_SPAN = (1 << 32) - 1
_ALL = (1 << 64) - 1


def _unshift(h: int, by: int) -> int:
    """Inverse of h ^= h >> by."""
    out = h
    for _ in range(64 // by):
        out = h ^ (out >> by)
    return out


def long_with_hash(wanted: int) -> int:
    """The signed long whose ``xxhash64`` (Spark's seed, 42) is ``wanted``: on eight bytes XXH64 is a
    bijection, so it can be run backwards."""
    h = _unshift(wanted & _ALL, 32)
    h = h * pow(P64_3, -1, 1 << 64) & _ALL
    h = _unshift(h, 29)
    h = h * pow(P64_2, -1, 1 << 64) & _ALL
    h = _unshift(h, 33)
    h = (h - P64_4) * pow(P64_1, -1, 1 << 64) & _ALL
    h = (h >> 27) | (h << 37) & _ALL
    k = h ^ ((SEED + P64_5 + 8) & _ALL)
    k = k * pow(P64_1, -1, 1 << 64) & _ALL
    k = (k >> 31) | (k << 33) & _ALL
    x = k * pow(P64_2, -1, 1 << 64) & _ALL
    return x - (1 << 64) if x >> 63 else x


def xxh64(text: Column, seed: int = SEED) -> Column:
    """XXH64 of the UTF-8 bytes as a signed long.  For a seed other than Spark's own, a literal is
    hashed first whose hash is that seed: each column's hash seeds the next."""
    return F.xxhash64(text) if seed == SEED else F.xxhash64(F.lit(long_with_hash(seed)), text)


def md5_60(text: Column) -> Column:
    """The first 60 bits of MD5, which every SQL engine can compute."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hashed(text: Column, kind: str = "xxh64", seed: int = SEED) -> Column:
    """An element's hash; ``kind`` is ``xxh64`` (64 bits) or ``md5_60`` (60 bits)."""
    return {"xxh64": lambda: xxh64(text, seed), "md5_60": lambda: md5_60(text)}[kind]()


BITS = {"xxh64": 64, "md5_60": 60}


def xxh32(data: Sequence[bytes], seed: int = GATE_SEED) -> np.ndarray:
    """XXH32 of byte strings, vectorised over those of equal length."""
    out = np.zeros(len(data), np.uint32)
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        rows = np.frombuffer(b"".join(data[i] for i in at), np.uint8).reshape(len(at), n) if n else np.zeros((len(at), 0), np.uint8)
        out[at] = _xxh32_equal(rows, seed)
    return out


def _rot32(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _xxh32_equal(rows: np.ndarray, seed: int) -> np.ndarray:
    count, n = rows.shape
    u = np.uint32
    word = lambda i: np.ascontiguousarray(rows[:, i : i + 4]).view("<u4")[:, 0]
    wrap = lambda v: u(v & 0xFFFFFFFF)
    with np.errstate(over="ignore"):
        i = 0
        if n >= 16:
            lanes = [np.full(count, wrap(seed + d)) for d in (P32_1 + P32_2, P32_2, 0, -P32_1)]
            while i + 16 <= n:
                for k in range(4):
                    lanes[k] = _rot32(lanes[k] + word(i + 4 * k) * u(P32_2), 13) * u(P32_1)
                i += 16
            h = _rot32(lanes[0], 1) + _rot32(lanes[1], 7) + _rot32(lanes[2], 12) + _rot32(lanes[3], 18)
        else:
            h = np.full(count, wrap(seed + P32_5))
        h = h + u(n)
        while i + 4 <= n:
            h = _rot32(h + word(i) * u(P32_3), 17) * u(P32_4)
            i += 4
        while i < n:
            h = _rot32(h + rows[:, i].astype(u) * u(P32_5), 11) * u(P32_1)
            i += 1
        for shift, prime in ((15, P32_2), (13, P32_3), (16, None)):
            h = h ^ (h >> u(shift))
            h = h if prime is None else h * u(prime)
    return h


def gate(text: Column, seed: int = GATE_SEED, kind: str = "xxh32") -> Column:
    """The 32-bit gate hash of a text as a long: XXH32, or the top of ``md5_60`` where the other
    engine lacks it."""
    if kind == "md5_60":
        return F.shiftrightunsigned(md5_60(F.concat(F.lit(f"{seed}:"), text)), 28)

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        known = s.notna().to_numpy()
        out = pd.Series([None] * len(s), dtype="Int64")
        out[known] = xxh32([v.encode() for v in s[known]], seed).astype(np.int64)
        return out

    return run(text)


def xxh64_bytes(rows: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of byte strings of one length below 32, as rows of a matrix."""
    count, n = rows.shape
    if n >= 32:
        raise ValueError("only for strings of fewer than 32 bytes")
    u = np.uint64
    rot = lambda x, r: (x << u(r)) | (x >> u(64 - r))
    h = np.full(count, u((seed + P64_5 + n) & _ALL))
    i = 0
    with np.errstate(over="ignore"):
        while i + 8 <= n:
            k = np.ascontiguousarray(rows[:, i : i + 8]).view("<u8")[:, 0] * u(P64_2)
            h = rot(h ^ (rot(k, 31) * u(P64_1)), 27) * u(P64_1) + u(P64_4)
            i += 8
        if i + 4 <= n:
            k = np.ascontiguousarray(rows[:, i : i + 4]).view("<u4")[:, 0].astype(u) * u(P64_1)
            h = rot(h ^ k, 23) * u(P64_2) + u(P64_3)
            i += 4
        while i < n:
            h = rot(h ^ (rows[:, i].astype(u) * u(P64_5)), 11) * u(P64_1)
            i += 1
        h = (h ^ (h >> u(33))) * u(P64_2)
        h = (h ^ (h >> u(29))) * u(P64_3)
    return h ^ (h >> u(32))
