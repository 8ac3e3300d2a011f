"""Leaks, packing and text quality on small texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from overlapse.llm import leaks as L
from overlapse.llm import packing as P
from overlapse.llm import quality as Q
from overlapse.llm.words import folded, words

VOCAB = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "si", "to") for b in ("bel", "dan", "fir", "gos", "hum", "jer", "kel")]


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def leaked(docs, items, n=10):
    grams = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_words_ignore_case_accents_and_invisible_characters():
    assert words("ÉCOLE, naïve​! ﬁn­al ｆｕｌｌ Straße") == ["ecole", "naive", "final", "full", "strasse"]
    assert folded("É") == "e"


def test_leaks_equal_brute_force(spark):
    rng = random.Random(11)
    items = [(i, sentence(rng, rng.randint(9, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "one two three")]
    items.append((93, items[3][1]))  # a repeated item
    docs = []
    for d in range(300):
        text = sentence(rng, rng.randint(0, 120))
        if d % 3 == 0:
            w = words(rng.choice(items[:40])[1])
            n = rng.choice([8, 9, 10, 11, 30])
            k = rng.randint(0, max(0, len(w) - n))
            part = w[k : k + n]
            shown = "".join(rng.choice([x.upper(), x, x[:2] + "​" + x[2:]]) + rng.choice([" ", ", ", "\n", " - "]) for x in part)
            text = f"{text} {shown} {sentence(rng, 20)}"
        docs.append((d, text))
    docs += [(900, None), (901, ""), (902, sentence(rng, 40_000) + " " + items[5][1]), (0, docs[0][1])]
    frame = lambda rows, name: spark.createDataFrame([(*r, "clash") for r in rows], f"{name} long, text string, score string")
    out = L.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    got = {(r.doc, r.item) for r in out if r.run_words >= 10}
    want = leaked(docs, items)
    assert got == want and len(want) > 30 and (902, 5) in want
    assert all(r.shared_qgrams > 0 and r.score > 0 for r in out)
    assert L.leaks(frame(docs, "doc_id").limit(0), frame(items, "item_id")).count() == 0
    assert L.leaks(frame(docs, "doc_id"), frame(items, "item_id").limit(0)).count() == 0


def test_leaks_with_an_edit_are_regions_too(spark):
    rng = random.Random(2)
    text = sentence(rng, 12)
    changed = text[:30] + "z" + text[31:]
    out = L.leaks(spark.createDataFrame([(1, changed)], "doc_id int, text string"), spark.createDataFrame([(1, text)], "item_id int, text string")).collect()
    assert len(out) == 1 and out[0].run_words < 10


def within(doc, window, edits):
    """Whether some part of the document is within so many edits of a window."""
    row = [0] * (len(doc) + 1)
    for i, c in enumerate(window, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(doc, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row) <= edits


def test_no_window_within_an_edit_is_missed(spark):
    rng = random.Random(21)
    items = [(i, sentence(rng, rng.randint(10, 18))) for i in range(25)]
    docs = []
    for d in range(60):
        w = words(rng.choice(items)[1])
        k = rng.randint(0, len(w) - 10)
        part = " ".join(w[k : k + 10])
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            at = rng.randrange(len(part))
            part = rng.choice([part[:at] + rng.choice("qwxz") + part[at + 1 :], part[:at] + "x" + part[at:], part[:at] + part[at + 1 :]])
        docs.append((d, f"{sentence(rng, 4)} {part} {sentence(rng, 4)}"))
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = {(r.doc, r.item) for r in L.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    want = set()
    for d, t in docs:
        joined = " ".join(words(t))
        for i, text in items:
            w = words(text)
            if any(within(joined, " ".join(w[k : k + 10]), 1) for k in range(len(w) - 9)):
                want.add((d, i))
    assert want <= got and len(want) >= 40


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    items = spark.createDataFrame([(i, sentence(rng, 20)) for i in range(9)], "item_id int, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("x "), "text").alias("text"))
    whole = sorted(map(tuple, L.leaks(docs, items).collect()))
    monkeypatch.setattr(L, "BLOCK_CHARS", 300)
    assert sorted(map(tuple, L.leaks(docs, items).collect())) == whole and len(whole) == 9


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_plans_use_every_document_once_and_fit(capacity):
    rng = random.Random(capacity)
    histogram = Counter(rng.randint(1, capacity) for _ in range(500))
    patterns = P.plan(dict(histogram), capacity)
    used = Counter()
    for level, times, pattern in patterns:
        assert P.tier(max(pattern), capacity) == level
        assert times > 0 and sum(s * n for s, n in pattern.items()) <= capacity
        for s, n in pattern.items():
            used[s] += times * n
    assert used == histogram
    boxes = sum(t for _, t, _ in patterns)
    assert boxes <= 1.1 * sum(s * n for s, n in histogram.items()) / capacity + 2
    assert P.tier(capacity, capacity) == 0 and P.plan({}, capacity) == []


def test_tiers_are_packed_and_filled_from_shorter_ones():
    own = P.pack_tier({60: 3, 51: 1}, 100)
    assert own == [(3, {60: 1}), (1, {51: 1})]
    filled, left = P.fill_gaps(own, {40: 2, 9: 5, 49: 1}, 100)
    assert filled == [(2, {60: 1, 40: 1}), (1, {60: 1, 9: 4}), (1, {51: 1, 49: 1})] and left == {9: 1}
    assert P.plan({60: 3, 51: 1, 40: 2, 9: 5, 49: 1}, 100) == [(0, *f) for f in filled] + [(3, 1, {9: 1})]
    assert P.pack_tier({30: 7, 26: 2}, 100) == [(2, {30: 3}), (1, {30: 1, 26: 2})]


def test_packing_is_an_exact_round_trip(spark, monkeypatch):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 1, 3, 3, 3, 40, 100, 101, 250])) for i in range(2000)] + [(5, 3), (5, 3)]
    docs = spark.createDataFrame(sizes, "doc long, n_tokens int")
    caps = spark.createDataFrame([(1, 100), (2, 64), (2, 64), (3, 0), (None, 9)], "pack_id int, capacity_tokens int")
    monkeypatch.setattr(P, "SLICE_ROWS", 90)
    out = P.pack(P.pieces(docs, caps), step=4).toPandas()
    assert set(out.pack_id) == {1, 2}
    for pack, capacity in ((1, 100), (2, 64)):
        own = out[out.pack_id == pack]
        want = Counter((d, k, min(capacity, n - k * capacity)) for d, n in sizes for k in range(-(-n // capacity)))
        assert Counter(zip(own.doc, own.piece, own.length)) == want
        assert all(n <= capacity for (_, _, n) in want)
        for _, box in own.groupby("container"):
            box = box.sort_values("offset")
            ends = (box.offset + box.length).tolist()
            assert ends[-1] <= capacity and box.offset.tolist() == [0, *ends[:-1]] and box.step_group.nunique() == 1
        assert own.groupby("step_group").container.nunique().max() <= 4
        assert (own.start == own.piece * capacity).all() and (own.tier == [P.tier(n, capacity) for n in own.length]).all()
        assert (own.groupby("container").tier.min() == own.groupby("container").box_tier.first()).all() and (own.tier > own.box_tier).any()
    assert P.pack(P.pieces(docs.limit(0), caps)).count() == 0 == P.pack(P.pieces(docs, caps.limit(0))).count()


def test_token_counts(spark):
    rows = [(1, "hello world"), (2, ""), (3, None), (4, "word " * 50_000), (5, "<|endoftext|>"), (5, "é")]
    got = sorted(map(tuple, P.token_counts(spark.createDataFrame(rows, "doc_id int, text string")).collect()))
    assert got[0] == (1, 2) and got[1:3] == [(2, 0), (3, 0)] and got[3][1] >= 50_000 and len(got) == 6 and got[5][1] > 1


COMMON = [("en", w) for w in "the a of and to in was that it on with".split()] + [("fr", w) for w in "le la de et un dans que qui était".split()] + [(None, "x"), ("en", None)]


def prose(rng, n=1):
    noun = lambda: rng.choice(VOCAB)
    return " ".join(f"The {noun()} of {noun()} was in the {noun()} that {noun()} {noun()} and it {noun()} on a {noun()} with {noun()}." for _ in range(n))


def test_lists_tables_and_noise_are_told_from_prose(spark):
    rng = random.Random(9)
    docs = [(i, prose(rng, rng.randint(1, 6)), True) for i in range(300)]
    docs += [(1000 + i, prose(rng, 3).upper(), True) for i in range(5)] + [(1100 + i, prose(rng, 3)[:-25], True) for i in range(5)]
    junk = [
        "\n".join(f"{rng.choice(VOCAB)}\t{rng.randint(1, 9999)}\t{rng.randint(1, 99)}" for _ in range(12)),
        "\n".join(f"- {rng.choice(VOCAB)}, {rng.choice(VOCAB)}" for _ in range(12)),
        " ".join(str(rng.randint(1, 9999)) for _ in range(40)),
        " / ".join(sorted(VOCAB)[:30]),
        (VOCAB[0] + " ") * 80,
        "if (x_1 == 2) { y[3] += 4; }\n" * 9,
        "@#$% ^&*( )_+ <>?",
    ]
    docs += [(2000 + i, t, False) for i, t in enumerate(junk)] + [(3000, "", True), (3001, None, True), (3002, " \n", True), (3003, prose(rng, 3000), True)]
    table = spark.createDataFrame([(d, t, "clash") for d, t, _ in docs], "doc_id long, text string, distance string")
    common = spark.createDataFrame(COMMON, "lang string, word string")
    got = {r.doc: r for r in Q.outlierness(table, common).collect()}
    assert len(got) == len(docs)
    wrong = [d for d, _, good in docs if got[d].is_prose != good]
    assert not wrong
    r = got[0]
    assert r.lang == "en" and abs(sum(r.contributions.values()) - r.distance) < 1e-9 and set(r.statistics) == set(Q.STATISTICS)
    assert got[3000].distance == 0 and got[2006].distance == float("inf")


def test_quality_of_empty_and_tiny_tables(spark):
    common = spark.createDataFrame(COMMON, "lang string, word string")
    one = spark.createDataFrame([(1, "the cat was in the house and it sat on a mat.")], "doc_id int, text string")
    assert Q.outlierness(one, common).first().is_prose
    assert Q.outlierness(one.limit(0), common).count() == 0
    assert Q.outlierness(one, common.limit(0)).count() == 1
