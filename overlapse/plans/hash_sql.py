"""XXH64 and XXH32 as SQL over wide integers, so that another engine can recompute what is hashed here.

Each is a fold over a list of steps (kind, word): whole words, the rest of the text, and the final mixing.
Names of lambda parameters start with ``h_``, so that no table's columns hide them.
"""

from __future__ import annotations

from overlapse.functions.hashing import GATE_SEED, P32_1, P32_2, P32_3, P32_4, P32_5, P64_1, P64_2, P64_3, P64_4, P64_5, SEED

_W, _ALL = "::UHUGEINT", f"{(1 << 64) - 1}::UHUGEINT"
_MASK = {64: _ALL, 32: f"{(1 << 32) - 1}::UHUGEINT"}


def _mul(x: str, by: int, bits: int) -> str:
    return f"(({x}) * {by}{_W} & {_MASK[bits]})"


def _rot(x: str, by: int, bits: int) -> str:
    return f"list_transform([{x}], lambda h_r: ((h_r << {by}) & {_MASK[bits]}) | (h_r >> {bits - by}))[1]"


def _word(x: str, at: str, size: int) -> str:
    """The little-endian number in ``size`` bytes of the hex text ``x`` from byte ``at`` (from 0) on."""
    pairs = " || ".join(f"substr({x}, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(size)))
    return f"CAST('0x' || {pairs} AS UBIGINT){_W}"


def _fold(start: str, steps: str, cases: dict[int, str]) -> str:
    body = " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items())
    return f"list_reduce([{{'k': 0, 'w': {start}}}] || {steps}, lambda h_a, h_b: {{'k': 0, 'w': CASE h_b.k {body} END}}).w"


def _mix(shift: int, prime: int | None, bits: int) -> str:
    x = f"xor(h_a.w, h_a.w >> {shift})"
    return x if prime is None else _mul(x, prime, bits)


def _striped(x: str, n: str, seed: int) -> str:
    """What four lanes make of the whole stripes of 32 bytes."""
    turn = lambda v: _mul(_rot(v, 31, 64), P64_1, 64)
    lanes = [(seed + d) % (1 << 64) for d in (P64_1 + P64_2, P64_2, 0, -P64_1)]
    blank = ", ".join(f"'v{i}': {v}{_W}" for i, v in enumerate(lanes))
    words = ", ".join(f"'v{i}': {_word(x, f'32 * h_i + {8 * i}', 8)}" for i in range(4))
    after = ", ".join(f"'v{i}': " + turn(f"((h_a.v{i} + {_mul(f'h_b.v{i}', P64_2, 64)}) & {_ALL})") for i in range(4))
    done = f"list_reduce([{{{blank}}}] || list_transform(range({n} // 32), lambda h_i: {{{words}}}), lambda h_a, h_b: {{{after}}})"
    h = " + ".join(_rot(f"h_s.v{i}", r, 64) for i, r in enumerate((1, 7, 12, 18)))
    h = f"(({h}) & {_ALL})"
    for i in range(4):
        h = f"(({_mul(f'xor({h}, {turn(_mul(f"h_s.v{i}", P64_2, 64))})', P64_1, 64)} + {P64_4}{_W}) & {_ALL})"
    return f"list_transform([{done}], lambda h_s: {h})[1]"


def signed(h: str) -> str:
    """An unsigned hash as a signed number of 64 bits."""
    return f"list_transform([{h}], lambda h_v: CAST(CASE WHEN h_v >= {1 << 63}{_W} THEN CAST(h_v AS HUGEINT) - {1 << 64} ELSE CAST(h_v AS HUGEINT) END AS BIGINT))[1]"


def xxh64(text: str, *longs: str, seed: int = SEED, long_texts: bool = False) -> str:
    """The unsigned hash of a text, which has fewer than 32 bytes unless ``long_texts``; each of ``longs`` is
    then hashed with the hash so far as its seed."""
    x, n = f"hex({text})", f"(length(hex({text})) // 2)"
    ends = "[{'k': 33, 'w': 0::UHUGEINT}, {'k': 29, 'w': 0::UHUGEINT}, {'k': 32, 'w': 0::UHUGEINT}]"
    steps = f"""list_transform(range({n} // 32 * 4, {n} // 8), lambda h_i: {{'k': 8, 'w': {_word(x, '8 * h_i', 8)}}})
 || CASE WHEN {n} % 8 >= 4 THEN [{{'k': 4, 'w': {_word(x, f'8 * ({n} // 8)', 4)}}}] ELSE [] END
 || list_transform(range({n} - {n} % 4, {n}), lambda h_i: {{'k': 1, 'w': {_word(x, 'h_i', 1)}}}) || {ends}"""
    for c in longs:
        steps += f" || [{{'k': 64, 'w': ({c}){_W}}}] || {ends}"
    mixed = _mul(_rot(_mul("h_b.w", P64_2, 64), 31, 64), P64_1, 64)
    after = lambda h: f"(({_mul(_rot(h, 27, 64), P64_1, 64)} + {P64_4}{_W}) & {_ALL})"
    four = _rot(f"xor(h_a.w, {_mul('h_b.w', P64_1, 64)})", 23, 64)
    start = f"{(seed + P64_5) % (1 << 64)}{_W}"
    if long_texts:
        start = f"CASE WHEN {n} >= 32 THEN {_striped(x, n, seed)} ELSE {start} END"
    return _fold(f"(({start} + {n}{_W}) & {_ALL})", steps, {
        8: after(f"xor(h_a.w, {mixed})"),
        4: f"(({_mul(four, P64_2, 64)} + {P64_3}{_W}) & {_ALL})",
        1: _mul(_rot(f"xor(h_a.w, {_mul('h_b.w', P64_5, 64)})", 11, 64), P64_1, 64),
        64: after(f"xor((h_a.w + {P64_5 + 8}{_W}) & {_ALL}, {mixed})"),
        33: _mix(33, P64_2, 64), 29: _mix(29, P64_3, 64), 32: _mix(32, None, 64),
    })


def xxh32(text: str, seed: int = GATE_SEED) -> str:
    """The hash of a text of fewer than 32 bytes."""
    x, n, all32 = f"hex({text})", f"(length(hex({text})) // 2)", _MASK[32]
    lanes = [(seed + d) % (1 << 32) for d in (P32_1 + P32_2, P32_2, 0, -P32_1)]
    turned = [_mul(_rot(f"(({lane}{_W} + {_mul(_word(x, str(4 * i), 4), P32_2, 32)}) & {all32})", 13, 32), P32_1, 32) for i, lane in enumerate(lanes)]
    striped = " + ".join(_rot(v, r, 32) for v, r in zip(turned, (1, 7, 12, 18)))
    start = f"((CASE WHEN {n} >= 16 THEN {striped} ELSE {(seed + P32_5) % (1 << 32)}{_W} END + {n}{_W}) & {all32})"
    steps = f"""list_transform(range(CASE WHEN {n} >= 16 THEN 4 ELSE 0 END, {n} // 4), lambda h_i: {{'k': 4, 'w': {_word(x, '4 * h_i', 4)}}})
 || list_transform(range({n} - {n} % 4, {n}), lambda h_i: {{'k': 1, 'w': {_word(x, 'h_i', 1)}}})
 || [{{'k': 15, 'w': 0::UHUGEINT}}, {{'k': 13, 'w': 0::UHUGEINT}}, {{'k': 16, 'w': 0::UHUGEINT}}]"""
    return _fold(start, steps, {
        4: _mul(_rot(f"((h_a.w + {_mul('h_b.w', P32_3, 32)}) & {all32})", 17, 32), P32_4, 32),
        1: _mul(_rot(f"((h_a.w + {_mul('h_b.w', P32_5, 32)}) & {all32})", 11, 32), P32_1, 32),
        15: _mix(15, P32_2, 32), 13: _mix(13, P32_3, 32), 16: _mix(16, None, 32),
    })
