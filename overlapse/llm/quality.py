"""Per-document text statistics, and their robust Mahalanobis distance from prose of the language.

The language of a text is the one whose common words it holds most of; texts that hold few of any
are compared with the prose of all languages.  Mean and covariance of prose are estimated robustly, over all
documents: starting from medians and absolute deviations, the documents nearest the centre give the next mean
and covariance, a fixed number of times.  A language's moments are shrunk towards those of all languages by
n / (n + 60) for n documents, so rare languages need no case of their own.  Each round is one pass, which
sums counts and moments by bins of the distance; only these sums, some hundred rows per language, come to the driver.

Every statistic has a least standard deviation, below which differences don't count, so that a property which
nearly all prose shares (a full stop at the end) doesn't condemn cut-off text.  Shares of few words scatter
more: the covariance of a text of n words is wider by 1 + 6 / n.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlapse.llm.words import folded
from overlapse.plans.session import written

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_SENTENCE = regex.compile(r"[.!?…。]+(?=\W|$)")
_CLOSING = "\"'”»’)]“«"
_FINAL = ".!?…。;:"

STATISTICS = (
    "log_words",
    "mean_word_length",
    "symbol_ratio",
    "ended_lines",
    "common_share",
    "number_share",
    "content_pairs",
    "common_pairs",
    "ascending_pairs",
    "near_repeats",
    "sentence_length",
    "row_lines",
    "bare_lines",
)
#: Least standard deviation of each statistic.
LEAST_SD = (3.0, 0.35, 0.1, 0.5, 0.05, 0.15, 0.08, 0.06, 0.1, 0.06, 0.5, 0.15, 0.25)
#: Share of the documents taken as prose when the moments are estimated, and the rounds of it.
PROSE_SHARE, ROUNDS = 0.85, 5
#: Bins of the squared distance in a round: this many for each doubling from BIN_LEAST on.
BINS, BIN_LEAST, MOST_BINS = 32, 0.25, 1024
#: Texts with a lower share of common words have no language; a language of so many documents has half of its own moments.
LEAST_COMMON, HALF_DOCS = 0.1, 60
#: The covariance of a text of this many words is twice that of a long one.
HALF_WORDS = 6
#: Chi-square quantile at 0.9995 for 13 statistics: squared distances beyond it are outliers.
LIMIT = 36.5


#: What parts a row's cells (within a line), by kind, and what stands before an entry of a list.
_CELLS = tuple(regex.compile(r"\S\s*(?:" + p + r")\s*\S") for p in (r"\t", r"\|", r";", r"[:=]", r"[/»>·→~]", r" {3,}|\.{4,}", r","))
_BULLET = regex.compile(r"^(?:[^\w\s\"'“”«»‘’(¿¡>]+|\w{1,3}[.):])\s+\S")


def row_share(lines: list[str]) -> float:
    """Share of lines that are rows or entries of one kind; 0 for fewer than three lines.

    A row has the kind's separator between cells and, as an entry has, no sentence of eight or more
    words before or after it.
    """
    if len(lines) < 3:
        return 0.0
    short = [line for line in lines if len(line.split()) < 16]
    most = sum(_BULLET.search(line) is not None and line[-1] not in ".!?…" for line in short)
    for cells in _CELLS[:-1]:
        most = max(most, sum(cells.search(line) is not None for line in short))
    # Commas stand in sentences too.
    most = max(most, sum(_CELLS[-1].search(line) is not None and line.rstrip(_CLOSING)[-1:] not in ".!?…" for line in short))
    return most / len(lines)


def bare_share(lines: list[str]) -> float:
    """Share of lines of at most eight words without any sentence end; 0 for fewer than three lines."""
    if len(lines) < 3:
        return 0.0
    return sum(len(line.split()) <= 8 and not any(c in line for c in ".!?…") for line in lines) / len(lines)


def text_statistics(text: str, common: dict[str, frozenset[str]]) -> tuple[str, int, list[float]]:
    """(language, number of words, values of ``STATISTICS``) of one whole text."""
    plain = folded(text)
    words = _WORD.findall(plain)
    n = len(words)
    best, share = "", -1.0
    for lang in sorted(common):
        hits = sum(map(common[lang].__contains__, words))
        if hits > share:
            best, share = lang, hits
    if not n:
        return "", 0, [0.0] * len(STATISTICS)
    listed = common[best] if best else frozenset()
    flags = [w in listed for w in words]
    numeric = [any(c.isdigit() for c in w) for w in words]
    chars = sum(map(len, words))
    visible = sum(map(len, plain.split()))
    lines = [s for s in (line.strip() for line in plain.splitlines()) if s]
    ended = sum(line.rstrip(_CLOSING)[-1:] in _FINAL and bool(line.rstrip(_CLOSING)) for line in lines)
    pairs = max(1, n - 1)
    both = sum(a and b for a, b in zip(flags, flags[1:]))
    neither = sum(not (a or b) for a, b in zip(flags, flags[1:]))
    rising = sum(a <= b for a, b in zip(words, words[1:]))
    last: dict[str, int] = {}
    near = content = 0
    for i, (w, f) in enumerate(zip(words, flags)):
        if not f:
            content += 1
            near += i - last.get(w, -99) <= 8
            last[w] = i
    sentences = max(1, sum(1 for _ in _SENTENCE.finditer(plain)))
    values = [
        math.log(n),
        chars / n,
        math.sqrt((visible - chars) / max(1, visible)),
        ended / max(1, len(lines)),
        share / n,
        math.sqrt(sum(numeric) / n),
        neither / pairs,
        both / pairs,
        rising / pairs,
        near / max(1, content),
        math.log(n / sentences),
        row_share(lines),
        bare_share(lines),
    ]
    return best, n, values


class Prose(NamedTuple):
    """Mean and inverse covariance of a language's prose."""

    mean: np.ndarray
    inverse: np.ndarray


def statistics(docs: DataFrame, doc_col: str, text_col: str, common: dict[str, frozenset[str]]) -> DataFrame:
    """(doc, lang, n_words, visible, x): the statistics of each document; ``lang`` is '' where few
    common words of any language occur.  A null text counts as empty; repeated ids give a row each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = STATISTICS.index("common_share")
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            rows = [text_statistics(t, common) for t in texts]
            yield pd.DataFrame(
                {
                    "doc": pdf["doc"],
                    "lang": [lang if x[at] >= LEAST_COMMON else "" for lang, _, x in rows],
                    "n_words": [n for _, n, _ in rows],
                    "visible": [not t.isspace() and t != "" for t in texts],
                    "x": [x for _, _, x in rows],
                }
            )

    kind = docs.select(doc_col).schema[0].dataType.simpleString()
    flat = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text"))
    return flat.mapInPandas(run, f"doc {kind}, lang string, n_words int, visible boolean, x array<double>")


def _with_distance(stats: DataFrame, model: dict[str, Prose]) -> DataFrame:
    """Adds ``parts``: what each statistic adds to the squared distance from the prose of ``lang``."""

    @F.pandas_udf("array<double>")
    def parts(lang: pd.Series, x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), index=x.index, dtype=object)
        for name, places in lang.groupby(lang).groups.items():
            prose = model.get(name) or model[""]
            away = np.vstack(x.loc[places].to_numpy()) - prose.mean
            for p, row in zip(places, away * (away @ prose.inverse)):
                out.at[p] = row
        return out

    return stats.withColumn("parts", parts("lang", "x"))


def _total(parts: str) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)


def _floored(mean: np.ndarray, cov: np.ndarray) -> Prose:
    floor = np.array(LEAST_SD) ** 2
    cov = cov + np.diag(np.maximum(floor - np.diag(cov), 0))
    return Prose(mean, np.linalg.inv(cov))


def _shrunk(moments: dict[str, tuple[int, np.ndarray, np.ndarray]]) -> dict[str, Prose]:
    """The prose of each language, its mean and covariance drawn towards those of all languages ('')."""
    _, m0, c0 = moments[""]
    share = {lang: 1.0 if lang == "" else n / (n + HALF_DOCS) for lang, (n, _, _) in moments.items()}
    return {lang: _floored(w * moments[lang][1] + (1 - w) * m0, w * moments[lang][2] + (1 - w) * c0) for lang, w in share.items()}


def _binned_sums(stats: DataFrame, model: dict[str, Prose]) -> dict[str, list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Per language, and for all under '': (bin of the squared distance, documents, their sums, sums of their
    products), in order of the bins."""
    k = len(STATISTICS)
    upper = np.triu_indices(k)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            x = batch.column("x").flatten().to_numpy().reshape(len(langs), k)
            for lang in {"", *langs}:
                own = x if lang == "" else x[langs == lang]
                away = own - model[lang].mean
                d = np.einsum("ij,ij->i", away @ model[lang].inverse, away)
                place = np.clip(BINS * np.log2(np.maximum(d, BIN_LEAST) / BIN_LEAST), 0, MOST_BINS).astype(int)
                for at in np.unique(place).tolist():
                    part = own[place == at]
                    row = np.concatenate(([len(part)], part.sum(axis=0), (part.T @ part)[upper]))
                    held[lang, at] = held[lang, at] + row if (lang, at) in held else row
        if held:
            yield pa.RecordBatch.from_pydict({"lang": [key[0] for key in held], "bin": pa.array([key[1] for key in held], pa.int32()), "sums": list(held.values())})

    each = stats.select("lang", "x").mapInArrow(sums, "lang string, bin int, sums array<double>")
    total = each.groupBy("lang", "bin").agg(F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(1 + k + len(upper[0])))).alias("sums"))
    out: dict[str, list] = {}
    for r in total.orderBy("lang", "bin").collect():
        row = np.array(r["sums"])
        products = np.zeros((k, k))
        products[upper] = row[1 + k :]
        out.setdefault(r["lang"], []).append((r["bin"], int(row[0]), row[1 : 1 + k], products + np.triu(products, 1).T))
    return out


def prose_moments(stats: DataFrame) -> dict[str, Prose]:
    """Robust moments of each language's prose, and of all together under ''."""
    k = range(len(STATISTICS))
    known = stats.where("lang <> ''").select("lang", "x")
    both = known.unionByName(known.withColumn("lang", F.lit("")))
    middle = both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(F.get("x", F.lit(i)), 0.5, 1000).alias(f"m{i}") for i in k))
    medians = {r["lang"]: (r["n"], [r[f"m{i}"] for i in k]) for r in middle.collect()}
    if not medians:
        return {"": Prose(np.zeros(len(STATISTICS)), np.diag(1 / np.array(LEAST_SD) ** 2))}
    # The first spread is the median absolute deviation.
    centre = F.create_map(*(c for lang, (_, m) in medians.items() for c in (F.lit(lang), F.array(*map(F.lit, m)))))
    own = both.withColumn("m", F.element_at(centre, F.col("lang")))
    spread = own.groupBy("lang").agg(*(F.percentile_approx(F.abs(F.get("x", F.lit(i)) - F.get("m", F.lit(i))), 0.5, 1000).alias(f"d{i}") for i in k))
    first = {r["lang"]: np.array([r[f"d{i}"] for i in k]) for r in spread.collect()}
    model = _shrunk({lang: (n, np.array(m), np.diag((1.4826 * first[lang]) ** 2)) for lang, (n, m) in medians.items()})
    for _ in range(ROUNDS):
        moments = {}
        for lang, bins in _binned_sums(known, model).items():
            wanted, n, sums, products = PROSE_SHARE * sum(b[1] for b in bins), 0, 0, 0
            for _, count, s, p in bins:
                if n >= wanted:
                    break
                n, sums, products = n + count, sums + s, products + p
            mean = sums / n
            moments[lang] = (n, mean, products / n - np.outer(mean, mean))
        model = _shrunk(moments)
    return model


def outlierness(docs: DataFrame, words: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, lang, n_words, statistics, contributions, distance, is_prose) of every document.

    ``words`` (lang, word) are the common words; they are folded like the texts and held whole, as a
    list of function words is.  ``statistics`` and ``contributions`` are maps by name; contributions
    add up to ``distance``, the squared robust Mahalanobis distance, lowered for texts of few words.
    A text without any word is no prose, an empty or blank one isn't judged (distance 0).
    """
    listed: dict[str, set[str]] = {}
    for lang, word in words.where("lang is not null and word is not null").select("lang", "word").collect():
        listed.setdefault(lang, set()).add(folded(word))
    common = {lang: frozenset(ws) for lang, ws in listed.items()}
    stats = written(statistics(docs, doc_col, text_col, common), "statistics")
    judged = _with_distance(stats, prose_moments(stats))
    scale = F.col("n_words") / (F.col("n_words") + HALF_WORDS)
    scaled = F.transform("parts", lambda p: p * scale)
    names = F.array(*map(F.lit, STATISTICS))
    wordless = (F.col("n_words") == 0) & F.col("visible")
    return judged.withColumn("parts", scaled).select(
        "doc",
        "lang",
        "n_words",
        F.map_from_arrays(names, F.col("x")).alias("statistics"),
        F.map_from_arrays(names, F.col("parts")).alias("contributions"),
        F.when(wordless, float("inf")).otherwise(_total("parts")).alias("distance"),
    ).withColumn("is_prose", F.col("distance") <= LIMIT)
