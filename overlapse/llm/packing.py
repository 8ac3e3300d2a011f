"""Documents into containers of fixed token capacity, by hierarchical multi-length packing.

Documents are routed to tiers by length: (C/2, C], (C/4, C/2], ... of the capacity C.  From the longest tier to
the shortest, a tier's documents are packed among themselves, and the gaps of its containers are then filled with
the longest documents that fit from the shorter tiers; what those have left is packed in its turn.  A
container is of the tier that opened it.

Documents of equal length are interchangeable, so this is planned on each tier's histogram of lengths; together
they have at most C entries however large the corpus is.  A plan is a list of patterns (lengths that share a
container) with multiplicities.  The documents are then numbered within their length, in slices, and each finds
its container by arithmetic.  Containers of a pattern cost the same, so step groups are balanced on the plan
as well: containers are dealt to steps back and forth in order of cost, whatever their tier.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from overlapse.plans.session import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
STEP = 8
#: Documents of one length that are numbered in one slice.
SLICE_ROWS = 20_000
#: A plan of at most this many rows (about 100 bytes each) is broadcast; a larger one is joined by shuffle.
PLAN_ROWS = 100_000
#: Characters tokenised at once.
BATCH_CHARS = 1_000_000


def token_counts(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc, n_tokens): whole texts in tokens of a public tokenizer, whose file ``tokenizer`` is.
    A null or empty text has 0 tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.encode_special_tokens = True
        for pdf in batches:
            texts = pdf["text"].fillna("")
            place = texts.str.len().cumsum() // BATCH_CHARS
            for _, part in texts.groupby(place.to_numpy(), sort=False):
                sizes = [len(e.ids) for e in model.encode_batch_fast(part.tolist(), add_special_tokens=False)]
                yield pd.DataFrame({"doc": pdf["doc"].loc[part.index], "n_tokens": sizes})

    kind = docs.select(doc_col).schema[0].dataType.simpleString()
    return docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).mapInPandas(count, f"doc {kind}, n_tokens int")


def pieces(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_id, capacity, tier, doc, piece, start, length): each document for each capacity, routed to a tier; only
    a document that exceeds the capacity is split, into full pieces and a rest.  Documents of 0 tokens
    take no place; null or non-positive capacities are ignored."""
    # A handful of container sizes; each document row is repeated once for each.
    caps = capacities.where("pack_id is not null and capacity_tokens > 0").select("pack_id", "capacity_tokens").distinct()
    kind = dict(capacities.dtypes)["pack_id"]
    each_of = F.array(
        *(F.struct(F.lit(r[0]).cast(kind).alias("pack_id"), F.lit(int(r[1])).alias("capacity")) for r in caps.collect())
    ).cast(f"array<struct<pack_id:{kind},capacity:int>>")
    each = sizes.where("n_tokens > 0").select("doc", "n_tokens", F.inline(each_of))
    last = F.expr("(n_tokens - 1) div capacity").cast("int")
    cut = each.select("pack_id", "capacity", "doc", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece") * F.col("capacity")
    length = F.least("capacity", F.col("n_tokens") - start).cast("int")
    routed = F.length(F.bin(F.expr("capacity div length"))) - 1
    return cut.select("pack_id", "capacity", "doc", "piece", start.alias("start"), length.alias("length")).select(
        "pack_id", "capacity", routed.alias("tier"), "doc", "piece", "start", "length"
    )


def tier(length: int, capacity: int) -> int:
    """0 for (C/2, C], 1 for (C/4, C/2], ..."""
    return (capacity // length).bit_length() - 1


Pattern = tuple[int, dict[int, int]]


def _added(left: dict[int, int], lengths: list[int], pattern: dict[int, int], gap: int) -> int:
    """Adds the longest of ``lengths`` (ascending) that fit to a pattern; returns the gap that stays."""
    top = len(lengths)
    while top:
        top = bisect_right(lengths, gap, hi=top)
        if not top:
            break
        size = lengths[top - 1]
        room = left[size] - pattern.get(size, 0)
        if not room:
            top -= 1
            continue
        # At least half of a length's documents stay for other patterns, so that patterns can repeat; a
        # single one is always taken.
        take = min(gap // size, max(1, room // 2))
        pattern[size] = pattern.get(size, 0) + take
        gap -= take * size
    return gap


def _used(left: dict[int, int], lengths: list[int], pattern: dict[int, int], times: int) -> None:
    for s, n in pattern.items():
        left[s] -= times * n
        if not left[s]:
            del left[s]
            lengths.remove(s)


def pack_tier(own: dict[int, int], capacity: int) -> list[Pattern]:
    """(multiplicity, {length: times}) of each pattern of a tier packed for itself.

    A pattern is built from the longest length left; the gap takes the longest one that fits until none does.  It
    is repeated as often as all of its lengths last.
    """
    left, lengths, out = dict(own), sorted(own), []
    while lengths:
        pattern: dict[int, int] = {}
        _added(left, lengths, pattern, capacity)
        times = min(left[s] // n for s, n in pattern.items())
        _used(left, lengths, pattern, times)
        out.append((times, pattern))
    return out


def fill_gaps(patterns: list[Pattern], shorter: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """The patterns with their gaps filled from the lengths of shorter tiers, and what of these is left.  A
    pattern whose fillers don't last for all of its containers is split."""
    left, lengths, out = dict(shorter), sorted(shorter), []
    for times, pattern in patterns:
        gap = capacity - sum(s * n for s, n in pattern.items())
        while times:
            more: dict[int, int] = {}
            _added(left, lengths, more, gap)
            n = min([times, *(left[s] // k for s, k in more.items())])
            _used(left, lengths, more, n)
            out.append((n, {**pattern, **more}))
            times -= n
    return out, left


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """(tier, multiplicity, {length: times}): the tiers packed and filled one after another."""
    left, out = dict(histogram), []
    for level in range(capacity.bit_length()):
        own = {s: n for s, n in left.items() if tier(s, capacity) == level}
        shorter = {s: n for s, n in left.items() if tier(s, capacity) > level}
        filled, left = fill_gaps(pack_tier(own, capacity), shorter, capacity)
        out += [(level, times, pattern) for times, pattern in filled]
    return out


def slots(patterns: list[tuple[int, int, dict[int, int]]]) -> list[tuple]:
    """Rows (length, from_no, to_no, box_tier, base, times, rank, cost): documents of a length numbered
    from_no..to_no-1 go to containers from ``base``, ``times`` to each.  ``rank`` orders the
    pattern's first container by falling cost, the sum of squared lengths."""
    cost = [sum(n * s * s for s, n in p.items()) for _, _, p in patterns]
    rank, seen = {}, 0
    for i in sorted(range(len(patterns)), key=lambda i: (-cost[i], i)):
        rank[i] = seen
        seen += patterns[i][1]
    used: dict[int, int] = {}
    rows, base = [], 0
    for i, (level, times, pattern) in enumerate(patterns):
        for s, n in pattern.items():
            lo = used.get(s, 0)
            used[s] = lo + times * n
            rows.append((s, lo, used[s], level, base, n, rank[i], cost[i]))
        base += times
    return rows


def pack(items: DataFrame, step: int = STEP) -> DataFrame:
    """(pack_id, container, box_tier, step_group, doc, piece, tier, start, length, offset) of ``pieces``.

    Every piece stands in exactly one container of its capacity.  ``box_tier`` is the container's tier, ``tier``
    the document's own, ``offset`` its place in the container; ``step_group`` gathers ``step`` containers of
    balanced cost.
    """
    spark = items.sparkSession
    kept = written(items.withColumn("row", F.monotonically_increasing_id()), "pieces")
    # One row per capacity and length: bounded by the sum of the capacities.
    seen: dict[tuple, dict[int, int]] = {}
    for r in kept.groupBy("pack_id", "capacity", "length").agg(F.count(F.lit(1)).alias("n")).collect():
        seen.setdefault((r["pack_id"], r["capacity"]), {})[r["length"]] = r["n"]
    rows, slices = [], []
    for (name, capacity), histogram in seen.items():
        patterns = plan(histogram, capacity)
        total = sum(times for _, times, _ in patterns)
        rows += [(name, capacity, *row, total) for row in slots(patterns)]
        slices += [(name, capacity, length, n // SLICE_ROWS + 1) for length, n in histogram.items()]
    kind = dict(items.dtypes)["pack_id"]
    key = f"pack_id {kind}, capacity int, length int"
    sized = lambda data, schema: F.broadcast(spark.createDataFrame(data, schema)) if len(data) <= PLAN_ROWS else spark.createDataFrame(data, schema)
    table = sized(rows, f"{key}, from_no long, to_no long, box_tier int, base long, times long, rank long, cost long, total long")
    sliced = kept.join(sized(slices, f"{key}, slices long"), ["pack_id", "capacity", "length"]).withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")))
    counts = sliced.groupBy("pack_id", "capacity", "length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("pack_id", "capacity", "length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("pack_id", "capacity", "length", "slice").orderBy("row")
    numbered = (
        sliced.withColumn("own", F.row_number().over(own) - 1)
        .join(first, ["pack_id", "capacity", "length", "slice"])
        .withColumn("no", F.col("first") + F.col("own"))
    )
    placed = numbered.alias("d").join(
        table.alias("s"),
        (F.col("d.pack_id") == F.col("s.pack_id"))
        & (F.col("d.capacity") == F.col("s.capacity"))
        & (F.col("d.length") == F.col("s.length"))
        & (F.col("no") >= F.col("from_no"))
        & (F.col("no") < F.col("to_no")),
    )
    nth = F.expr("(no - from_no) div times")
    steps = F.ceil(F.col("total") / step)
    rank = F.col("rank") + F.col("nth")
    turn, at = F.floor(rank / F.col("steps")), F.pmod(rank, F.col("steps"))
    inside = Window.partitionBy("pack_id", "container").orderBy(F.desc("length"), "row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.select("d.pack_id", "d.doc", "d.piece", "d.tier", "d.start", "d.length", "d.row", "box_tier", "base", "rank", nth.alias("nth"), steps.alias("steps"))
        .withColumn("container", F.col("base") + F.col("nth"))
        .withColumn("step_group", F.when(F.pmod(turn, F.lit(2)) == 0, at).otherwise(F.col("steps") - 1 - at))
        .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
        .select("pack_id", "container", "box_tier", "step_group", "doc", "piece", "tier", "start", "length", "offset")
    )
