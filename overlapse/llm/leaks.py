"""Evaluation passages in a corpus, by q-gram lemma filtering and banded alignment.

Texts are compared as normalised words joined by single spaces.  A passage is a window of ``words``
consecutive words of an item; it counts as found in a document when it aligns with at most ``edits``
edits.  The steps, each of which loses no such window:

1. Seeds.  A window of L characters within ``edits`` edits keeps one of any edits + 1 disjoint
   q-grams intact, so each window contributes its rarest ones; documents with none of an item's
   seeds can't hold a window of it.
2. Counting.  Of the window's L + 1 - q q-grams at most q * edits are lost, and the others lie on
   diagonals (position in document less position in item) within ``edits`` of each other.  Shared
   q-grams are counted in overlapping diagonal bands, for all pairs of a batch of documents at once; regions that
   reach the bound are retained.
3. Verification.  A banded local alignment of each retained region must reach the score of a window
   with ``edits`` edits.  The longest run of equal words is reported beside it.

The items are the stated query set: they are taken in blocks of bounded size, each of which is
broadcast; the corpus is read as partitions and isn't shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.llm.words import words

Q = 12
EDITS = 1
WORDS = 10
GAP = 2
#: Characters of items in one broadcast block, and characters of documents handled at once.
BLOCK_CHARS = 4_000_000
BATCH_CHARS = 1_000_000
_BITS = 22


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def qgram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Item:
    """One item: its words, q-grams and the bounds of its windows."""

    __slots__ = ("codes", "grams", "ident", "least", "starts", "words")

    def __init__(self, ident: object, tokens: list[str], q: int, size: int) -> None:
        self.ident, self.words = ident, np.array(tokens, dtype=object)
        lengths = np.array([len(t) for t in tokens])
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        ends = self.starts + lengths
        self.codes = _codes(" ".join(tokens))
        self.grams = qgram_hashes(self.codes, q)
        spans = ends[size - 1 :] - self.starts[: len(tokens) - size + 1]
        self.least = int(spans.min())

    def windows(self, size: int) -> Iterator[tuple[int, int]]:
        for i in range(len(self.words) - size + 1):
            j = i + size - 1
            yield int(self.starts[i]), int(self.starts[j] + len(self.words[j]))


class Index:
    """The items of one block with their seeds."""

    def __init__(self, texts: list[tuple[object, str]], q: int, edits: int, size: int) -> None:
        self.q, self.edits, self.size = q, edits, size
        tokens = [(i, words(t or "")) for i, t in texts]
        self.items = [Item(i, w, q, size) for i, w in tokens if len(w) >= size]
        sizes = [len(i.codes) for i in self.items]
        self.codes = np.concatenate([i.codes for i in self.items]) if sizes else np.empty(0, np.uint64)
        self.offsets = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64).tolist() if sizes else []
        common = Counter()
        for item in self.items:
            common.update(np.unique(item.grams).tolist())
        seeds: set[tuple[int, int]] = set()
        for number, item in enumerate(self.items):
            weight = np.array([common[g] for g in item.grams.tolist()])
            for lo, hi in item.windows(size):
                free = weight[lo : max(lo + 1, hi - q + 1)].astype(float).copy()
                for _ in range(edits + 1):
                    at = int(free.argmin()) if len(free) else 0
                    if not len(free) or np.isinf(free[at]):
                        break
                    seeds.add((int(item.grams[lo + at]), number) if lo + at < len(item.grams) else (0, number))
                    free[max(0, at - q + 1) : at + q] = np.inf
        rows = sorted(seeds)
        self.seeds = np.array([s for s, _ in rows], np.uint64)
        self.owner = np.array([n for _, n in rows], np.int64)
        # Every q-gram of every item with its place, in order of the hash.
        grams = np.concatenate([i.grams for i in self.items]) if sizes else np.empty(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams = grams[order]
        self.gram_item = np.repeat(np.arange(len(self.items)), [len(i.grams) for i in self.items])[order]
        self.gram_at = np.concatenate([np.arange(len(i.grams)) for i in self.items])[order] if sizes else np.empty(0, np.int64)
        least = np.array([i.least for i in self.items], np.int64)
        self.need, self.reach = np.maximum(1, least + 1 - q * (1 + edits)), least - q
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[np.concatenate((self.seeds, self.grams)) >> np.uint64(64 - _BITS)] = True

    def candidates(self, grams: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
        """The (document, item) pairs that share a seed, as ascending numbers document * items + item."""
        lo, hi = np.searchsorted(self.seeds, grams, "left"), np.searchsorted(self.seeds, grams, "right")
        of, which = _expanded(lo, hi)
        return np.unique(doc_of[of] * np.int64(len(self.items)) + self.owner[which])


def _expanded(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For slices lo..hi, the number of the slice and the place of each of their elements."""
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return of, np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(of))


def regions(index: Index, grams: np.ndarray, doc_of: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows (document, item, hits, first item position, end of the last, lowest diagonal): the diagonal bands whose
    q-grams reach the bound within some window, of the pairs that share a seed.  ``doc_of`` and ``place`` tell where
    each q-gram stands."""
    known = np.flatnonzero(index.bitmap[grams >> np.uint64(64 - _BITS)])
    grams, doc_of, place = grams[known], doc_of[known], place[known]
    pairs = index.candidates(grams, doc_of)
    lo, hi = np.searchsorted(index.grams, grams, "left"), np.searchsorted(index.grams, grams, "right")
    of, which = _expanded(lo, hi)
    item, ipos = index.gram_item[which], index.gram_at[which]
    pair = doc_of[of] * np.int64(len(index.items)) + item
    at = np.searchsorted(pairs, pair)
    at[at == len(pairs)] = 0
    own = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
    # A pair with fewer hits than a window needs can't hold one, wherever they lie.
    total = np.bincount(at[own], minlength=len(pairs))
    kept = np.flatnonzero(own & (total[at] >= index.need[item]) if len(pairs) else own)
    at, ipos, diagonal = at[kept], ipos[kept], place[of[kept]] - ipos[kept]
    if not len(at):
        return np.empty((0, 6), np.int64)
    step = max(1, index.edits)
    band = np.floor_divide(diagonal, step)
    # Bands are step + edits diagonals wide and overlap by edits, so a hit lies in one or two.
    twice = np.flatnonzero(diagonal - band * step < index.edits)
    band = np.concatenate((band, band[twice] - 1))
    at, ipos = (np.concatenate((x, x[twice])) for x in (at, ipos))
    # Rows of (pair, band, position) in order, as one number where that has room.
    lowest, width = int(band.min()), int(ipos.max()) + 1
    bands = int(band.max()) - lowest + 1
    if len(pairs) * bands * width < 1 << 62:
        key = np.sort((at * bands + (band - lowest)) * width + ipos)
        key, ipos = np.divmod(key, width)
        at, band = np.divmod(key, bands)
        band += lowest
    else:
        key = np.lexsort((ipos, band, at))
        at, band, ipos = at[key], band[key], ipos[key]
    pair = pairs[at]
    item = pair % len(index.items)
    # The need-th following row must lie within the window.
    last = np.arange(len(key)) + index.need[item] - 1
    inside = np.minimum(last, len(key) - 1)
    dense = np.flatnonzero(
        (last < len(key)) & (pair[inside] == pair) & (band[inside] == band) & (ipos[inside] - ipos <= index.reach[item])
    )
    if not len(dense):
        return np.empty((0, 6), np.int64)
    # Dense stretches of one band that touch form one region.
    parted = (np.diff(pair[dense]) != 0) | (np.diff(band[dense]) != 0) | (np.diff(ipos[dense]) > index.reach[item[dense[1:]]])
    first = dense[np.append(True, parted)]
    end = last[dense[np.append(parted, True)]]
    docs = pair[first] // len(index.items)
    return np.stack([docs, item[first], end - first + 1, ipos[first], ipos[end] + index.q, band[first] * step], axis=1)


def banded_scores(docs: np.ndarray, items: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Best local alignment of each region: 1 a match, -GAP an edit.

    A row is (start and length of the document in ``docs``, start of the item in ``items``, first and
    last item position, lowest diagonal); all regions are ``width`` diagonals wide and advance together.
    """
    best = np.zeros(len(rows), np.int64)
    if not len(rows):
        return best
    dstart, dlen, istart, lo, hi, low = (rows[:, i] for i in range(6))
    offsets = np.arange(width)
    slope = GAP * offsets
    before = np.zeros((len(rows), width), np.int64)
    live = np.arange(len(rows))
    for t in range(int((hi - lo).max())):
        ended = lo[live] + t >= hi[live]
        if ended.any():
            live, before = live[~ended], before[~ended]
        at = (lo[live] + t + low[live])[:, None] + offsets
        inside = (at >= 0) & (at < dlen[live][:, None])
        seen = docs[np.where(inside, at + dstart[live][:, None], 0)]
        same = inside & (seen == items[istart[live] + lo[live] + t][:, None])
        now = np.maximum(before + np.where(same, 1, -GAP), 0)
        now[:, :-1] = np.maximum(now[:, :-1], before[:, 1:] - GAP)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        now[~inside] = 0
        best[live] = np.maximum(best[live], now.max(axis=1))
        before = now
    return best


def longest_run(doc: np.ndarray, item: np.ndarray) -> int:
    """The longest run of equal consecutive words."""
    best, before = 0, np.zeros(len(doc) + 1, np.int64)
    for w in item:
        now = np.zeros(len(doc) + 1, np.int64)
        now[1:] = np.where(doc == w, before[:-1] + 1, 0)
        best = max(best, int(now.max()))
        before = now
    return best


def _search(index: Index, ids: list, texts: list) -> Iterator[tuple]:
    tokens = [words(t or "") for t in texts]
    keep = [k for k, w in enumerate(tokens) if w]
    if not keep or not index.items:
        return
    joined = [" ".join(tokens[k]) for k in keep]
    lengths = np.array([len(j) + 1 for j in joined])
    starts = np.concatenate(([0], np.cumsum(lengths)))
    codes = _codes("\0".join(joined) + "\0")
    grams = qgram_hashes(codes, index.q)
    doc_of = np.repeat(np.arange(len(keep)), lengths)[: len(grams)]
    found = regions(index, grams, doc_of, np.arange(len(grams)) - starts[doc_of])
    reach = index.edits + 1
    marks = found[:, :3].tolist()
    d, i, first, last, low = found[:, 0], found[:, 1], found[:, 3], found[:, 4], found[:, 5]
    offsets, sizes = np.array(index.offsets, np.int64), np.array([len(x.codes) for x in index.items], np.int64)
    table = np.stack(
        [starts[d], starts[d + 1] - 1 - starts[d], offsets[i], np.maximum(0, first - index.q), np.minimum(sizes[i], last + index.q), low - reach], axis=1
    )
    width = max(1, index.edits) + index.edits + 2 * reach + 1
    scores = np.zeros(len(table), np.int64)
    by_length = np.argsort(table[:, 4] - table[:, 3], kind="stable")
    for part in np.split(by_length, np.arange(2048, len(by_length), 2048)):
        scores[part] = banded_scores(codes, index.codes, table[part], width)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for (d, i, hits), score in zip(marks, scores.tolist()):
        if score >= max(1, index.items[i].least - index.edits * (1 + GAP)):
            best[d, i] = max(best.get((d, i), (0, 0)), (score, hits))
    for (d, i), (score, hits) in best.items():
        run = longest_run(np.array(tokens[keep[d]], dtype=object), index.items[i].words)
        yield (ids[keep[d]], index.items[i].ident, hits, score, run)


def _batches(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Slices of bounded text size; a longer document makes a slice of its own and stays whole."""
    size = pdf["text"].str.len().fillna(0).cumsum()
    for _, part in pdf.groupby((size // BATCH_CHARS).to_numpy(), sort=False):
        yield part


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    block, chars = [], 0
    for row in items.select(item_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        chars += len(row[1])
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    q: int = Q,
    edits: int = EDITS,
    size: int = WORDS,
) -> DataFrame:
    """(doc, item, shared_qgrams, score, run_words): items found in documents, wholly or partly.

    Items of fewer than ``size`` words and null or empty texts match nothing.  Repeated documents
    and items give a row each.  Other columns of either table are ignored.  q * (edits + 1) should
    not exceed the shortest window's characters, else seeds cover less than the edits allow.
    """
    spark: SparkSession = docs.sparkSession
    kinds = docs.select(doc_col).schema[0].dataType.simpleString(), items.select(item_col).schema[0].dataType.simpleString()
    schema = f"doc {kinds[0]}, item {kinds[1]}, shared_qgrams int, score int, run_words int"
    found = None
    for block in _blocks(items, item_col, text_col):
        shared = spark.sparkContext.broadcast(Index(block, q, edits, size))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part in _batches(pdf):
                    rows = list(_search(shared.value, part["doc"].tolist(), part["text"].tolist()))
                    if rows:
                        yield pd.DataFrame(rows, columns=["doc", "item", "shared_qgrams", "score", "run_words"])

        part = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).mapInPandas(search, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)
