"""The text operators against brute force and on awkward input."""

import itertools
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

from arborlake.llm import lookalikes, mixing, packing
from arborlake.llm.tokens import count_tokens, with_tokens
from arborlake.runtime import read_table

DOCS = "doc_id long, text string, source string, lang string, n_tokens int, key double, capacity_tokens int, form string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, None, 1, 0.5, 7, "f") for i, t, s in rows], DOCS)


# 8 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(12))
def test_solver_uses_every_item_once_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([1, 2, 7, 64, 512]))
    lengths = rng.integers(1, capacity + 1, rng.integers(0, 400))
    if seed % 3 == 0:
        lengths = np.minimum(capacity, 1 + rng.geometric(0.02, 300))
    counts = np.bincount(lengths, minlength=capacity + 1)
    used = Counter()
    n = 0
    for pattern, times in packing.solve(counts, capacity):
        assert times > 0 and 0 < sum(pattern) <= capacity
        n += times
        for x in pattern:
            used[x] += times
    assert used == Counter(lengths.tolist())
    least = -(-int(lengths.sum()) // capacity)
    singles = int((lengths * 2 > capacity).sum())
    assert n <= max(least, singles) * 1.25 + 1


def test_complements_are_exact():
    rng = random.Random(0)
    for _ in range(200):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 6))]
        index = packing.Complements(np.bincount(lengths, minlength=41))
        gap = rng.randint(1, 40)
        sums = {sum(lengths[i] for i in range(len(lengths)) if m >> i & 1): 1 for m in range(1, 1 << len(lengths)) if bin(m).count("1") <= 3}
        found = index.exact(gap)
        assert bool(found) == (gap in sums)
        assert not found or sum(found) == gap and not Counter(found) - Counter(lengths)


def test_triples_are_found_behind_many_that_need_an_item_twice():
    # No number of `few` is the mean of two others, so gap - 2x is no start: it would need x twice.
    few = [n for n in range(1, 400) if "2" not in np.base_repr(n, 3)][:40]
    starts = [2000 - 2 * x for x in few[:-1]] + [2000 - few[-1] - few[-2]]
    counts = np.zeros(2001, np.int64)
    counts[few + starts] = 1
    assert packing.Complements(counts).exact(2000) == (starts[-1], few[-1], few[-2])


@pytest.mark.parametrize("seed", range(8))
def test_triples_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    counts = rng.choice(4, 70, p=(0.8, 0.13, 0.04, 0.03))
    counts[0] = 0
    items = np.repeat(np.arange(70), counts).tolist()
    sums = {a + b + c for a, b, c in itertools.combinations(items, 3)}
    for gap in range(2, 70):
        found, before = packing.Complements(c := counts.copy()).triple(gap), counts.copy()
        assert (found is not None) == (gap in sums) and np.array_equal(c, before)
        assert found is None or sum(found) == gap and not Counter(found) - Counter(items)


def test_packing_of_documents(spark):
    rows = [(1, "word " * 50, "a"), (2, "", "a"), (3, None, "a"), (4, "one two three", "b"), (5, "one two three", "b"), (5, "one two three", "b"), (6, "x" * 20_000, None), (None, "no id", "b")]
    packs = spark.createDataFrame([("p", 8), ("q", 100), ("none", 0), (None, 5), ("null", None)], "pack_name string, capacity_tokens int")
    got = packing.pack_documents(docs(spark, rows), packs).collect()
    for name, capacity in (("p", 8), ("q", 100)):
        mine = [r for r in got if r["pack_name"] == name]
        size, pieces = defaultdict(int), defaultdict(list)
        for r in mine:
            size[r["container_id"]] += r["n_tokens"]
            pieces[r["doc_id"]].append((r["first_token"], r["n_tokens"]))
        assert max(size.values()) <= capacity and set(size) == set(range(len(size)))
        for i, text, _ in rows:
            n = count_tokens(text)
            if i != 5:
                assert sorted(pieces[i]) == ([(k, min(capacity, n - k)) for k in range(0, n, capacity)] or [(0, 0)])
        assert len(pieces[5]) == 2
    assert {r["pack_name"] for r in got} == {"p", "q"}
    assert packing.pack_documents(docs(spark, []), packs).count() == 0
    assert packing.pack_report(docs(spark, rows), packs).count() == 2


# 9 -----------------------------------------------------------------------------------------------


def test_quality_weights_are_highest_for_usual_texts(spark):
    rows = [(k, f"The axon of cell {k} leaves layer {k % 7}.", "s") for k in range(200)] + [(900, "qZx##\x07!~vv§§ŧŧ", "s"), (901, None, "s"), (902, "", "t")]
    w = {r["doc_id"]: (r["n_tokens"], r["weight"]) for r in mixing.measured(docs(spark, rows)).collect()}
    assert w[900][1] <= 0.06 < 0.5 < w[5][1] <= 1 and w[901] == w[902] == (0, 0.05)
    assert all(w[i][0] == count_tokens(t) for i, t, _ in rows)


@pytest.mark.parametrize("edge", [1, 5_000])
def test_mixing_equals_brute_force(spark, monkeypatch, edge):
    monkeypatch.setattr(mixing, "EDGE_ROWS", edge)
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["axon", "soma", "12.5", "Ω"]) for _ in range(rng.randint(0, 60))), rng.choice(["big"] * 8 + ["mid", "mid", "small"])) for k in range(900)]
    rows += [(2000, None, "big"), (2001, "", "small"), (None, "axon", "big"), (2002, "axon", None), (2003, "axon", "unwanted")]
    targets = [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "small", 0.2, 3), ("m", "absent", 0.0, 3), ("n", "small", 0.9, 4), ("n", "absent", 0.1, 2), ("n", "big", 0.0, 1), ("o", "absent", 1.0, 1), (None, "big", 1.0, 1)]
    t = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")
    df = docs(spark, rows)
    tokens, totals, by = {}, Counter(), defaultdict(list)
    for i, text, s in rows:
        if i is not None and s is not None:
            tokens[i] = count_tokens(text)
            totals[s] += tokens[i]
            by[s].append(i)
    keyed = mixing.measured(df)
    used = {(r["mix_name"], r["doc_id"]): r["n_uses"] for r in mixing.mix_documents(df, t, seed=5).collect()}
    for mix, s, _, repeats, have, budget, epochs, rest in mixing.plan(dict(totals), [x for x in targets if x[0]]):
        assert budget <= have * repeats
        from pyspark.sql import functions as F

        keys = {r["doc_id"]: r["k"] for r in keyed.withColumn("mix_name", F.lit(mix)).select("doc_id", mixing.sampling_key(5, "mix_name", "doc_id").alias("k")).collect()}
        order, left, taken = sorted(by[s], key=lambda i: (keys[i], i)), rest, set()
        for i in order if epochs < repeats and rest > 0 else []:
            if tokens[i] <= left:
                taken.add(i)
                left -= tokens[i]
            else:
                if 2 * left > tokens[i]:
                    taken.add(i)
                break
        for i in by[s]:
            n = used.get((mix, i), 0)
            # Texts without tokens change no sum; the part where the budget ends may take them or not.
            assert n == epochs + (i in taken) or tokens[i] == 0, (mix, s, i)
            assert n <= max(repeats, 0)
    report = {(r["mix_name"], r["source"]): r for r in mixing.mix_report(df, t, seed=5).collect()}
    assert abs(report["m", "big"]["actual_share"] - 0.5) < 0.05 and report["n", "absent"]["actual_share"] == 0
    assert report["o", "absent"]["tokens"] == 0 and report["o", "absent"]["reason"] == report["n", "absent"]["reason"] == "no documents"
    assert abs(report["n", "small"]["attainable_share"] - 1.0) < 1e-9 and report["n", "small"]["reason"].startswith("others lack documents") and report["n", "small"]["limits"]
    assert mixing.mix_documents(docs(spark, []), t).count() == 0


# 10 ----------------------------------------------------------------------------------------------


def test_canonical_equals_settling_the_whole_text():
    rng = random.Random(1)
    pool = "ab eé́̈ее ​ＡｅΩΩñnü﻿x̧̣.\n　а̀µμ½ﬁ"
    for _ in range(20_000):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))
        c = lookalikes.canonical(s)
        assert c == lookalikes._settle(s) == lookalikes.canonical(c)


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("ＡＢＣ１，", "ABC1,", True), ("é", "é", True), ("a b", "a b", True), ("a​b", "ab", True), ("е́", "é", True), ("ё", "ë", True), ("e​́", "é", True),
        ("Анна", "Aннa", True), ("µm", "μm", True), ("ΑΒΕ", "ABE", True), ("in­put", "input", True), ("ɑ", "a", True),
        ("a", "A", False), ("é", "e", False), ("a  b", "a b", False), ("a\nb", "a b", False), ("1", "2", False), ("и", "й", False), ("a.", "a", False), ("½", "1/2", False), ("x²", "x2", False),
    ],
)
def test_what_looks_alike(a, b, same):
    assert (lookalikes.canonical(a) == lookalikes.canonical(b)) is same


@pytest.mark.parametrize("a,b", ["ГΓ", "ПΠ", "ФΦ", "ѰΨ", "ѱψ", "CϹ", "СϹ", "JͿ", "ЈͿ", "VѴ", "ÆӔ", "æӕ", "ƏӘ", "əә", "κк", "ΘѲ", "ΘƟ", "тᴛ", "мᴍ", "нʜ", "вʙ", "ΣƩ", "ΛɅ", "εɛ", "γɣ", "φɸ", "ӏl", "кĸ"])
def test_letters_drawn_alike_without_a_latin_twin_and_rare_ones(a, b):
    assert lookalikes.canonical(f"x {a}1") == lookalikes.canonical(f"x {b}1") == lookalikes.canonical(lookalikes.canonical(f"x {b}1"))


def test_lookalike_pairs(spark):
    rows = [(1, "axon", "s"), (2, "ахon", "s"), (3, "axon", "s"), (4, "Axon", "s"), (5, None, "s"), (6, "", "s"), (7, "​", "s"), (None, "axon​", "s"), (8, "é" * 50_000, "s"), (9, "é" * 50_000, "s"), (9, "é" * 50_000, "s")]
    got = {tuple(r) for r in lookalikes.lookalike_pairs(docs(spark, rows)).collect()}
    assert got == {(1, 2), (2, 3), (6, 7), (8, 9)}
    classes = {r["doc_id"]: tuple(r)[1:] for r in lookalikes.lookalike_classes(docs(spark, rows)).collect()}
    assert classes[3] == (1, 3, 2) and classes[4] == (4, 1, 1) and 5 not in classes
    assert lookalikes.lookalike_pairs(docs(spark, [])).count() == 0


def test_lookalike_pairs_equal_brute_force(spark, sf):
    df = read_table(spark, sf, "documents")
    by = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        by[lookalikes._settle(r["text"])].append((r["doc_id"], r["text"]))
    want = {(min(a, b), max(a, b)) for g in by.values() for a, s in g for b, t in g if s != t}
    assert {tuple(r) for r in lookalikes.lookalike_pairs(df).collect()} == want and want


def test_token_counts_keep_whole_texts(spark):
    text = "Soma 12.5 µm, части " * 4000
    got = with_tokens(docs(spark, [(1, text, "s"), (2, None, "s")]), ["doc_id"]).collect()
    assert [r["n_tokens"] for r in got] == [count_tokens(text), 0]
    assert unicodedata.is_normalized("NFC", lookalikes.canonical(text))
