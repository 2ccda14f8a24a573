"""Terms of the vocabulary, and the passes that the regression takes."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siltstone.functions.text import TERM, tokens
from siltstone.operators import newton
from siltstone.operators import ranker as K


def brute(texts, limit):
    df, total = Counter(), Counter()
    for t in texts:
        w = K._TERM.findall(t or "")
        g = w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        total.update(g)
        df.update(set(g))
    return [(t, df[t], n) for t, n in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:limit]]


def test_vocabulary_counts_pairs_of_frequent_words_alone(spark, monkeypatch):
    rng = random.Random(4)
    words = ["aa", "bb", "cc", "b", "7", "é", "x_1", "+", *[f"w{i}" for i in range(60)]]
    texts = [" ".join(rng.choices(words[: rng.randint(1, 68)], k=rng.randint(0, 40))) for _ in range(150)] + [None, "", "aa aa aa"]
    d = spark.createDataFrame(list(enumerate(texts)), "sample_id long, code string").repartition(3)
    seen = []
    monkeypatch.setattr(K, "_counts", lambda texts, terms, own=K._counts: seen.append(terms) or own(texts, terms))
    for most, limit in ((200_000, 1), (200_000, 5), (200_000, 40), (2, 40), (200_000, 100_000)):
        monkeypatch.setattr(K, "WORDS", most)
        got = [(r["term"], r["df"], r["total"]) for r in K.vocabulary(d, len(texts), limit).collect()]
        assert got == brute(texts, limit)
        if most > 2 and limit == 5:
            assert seen[-1](["aa", "w59", "aa", "aa"]) == [("aa", "aa")]  # a rare word's pairs are not counted
    monkeypatch.setattr(K, "HELD", 3)
    assert [tuple(r)[:3] for r in K.vocabulary(d, len(texts), 40).collect()] == brute(texts, 40)
    vocab = K.vocabulary(d, len(texts), 40)
    known = {r["term"] for r in vocab.collect()}
    every = {(r["sample_id"], r["term"]): r["tf"] for r in K.ngrams(d).collect()}
    assert {(r["sample_id"], r["term"]): r["tf"] for r in K.ngrams(d, vocab=vocab).collect()} == {k: n for k, n in every.items() if k[1] in known}


def test_terms_are_those_of_the_pattern(spark):
    texts = [f"ab{chr(c)}cd {chr(c)}{chr(c)} 1{chr(c)}2" for c in range(0x800)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", tokens(F.col("t"), TERM).alias("x")).collect()
    assert all(list(r["x"]) == K._TERM.findall(r["t"]) for r in got)


def test_regression_of_few_columns_takes_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 9)) * rng.uniform(0.1, 30, 9)
    x[rng.random(x.shape) < 0.5] = 0
    y = (x @ rng.normal(size=9) + rng.normal(size=600) * 20 > 3).astype(float)
    rows = [(np.flatnonzero(a).tolist(), a[np.flatnonzero(a)].tolist(), b, 1.0 + (b == 1)) for a, b in zip(x, y.tolist(), strict=True)]
    d = spark.createDataFrame(rows, "index array<int>, value array<double>, y double, w double").repartition(3)
    passes = []
    for name in ("_sum", "_squares"):
        monkeypatch.setattr(newton, name, lambda *a, own=getattr(newton, name), n=name: passes.append(n) or own(*a))
    monkeypatch.setattr(newton, "STRIP", 4)
    monkeypatch.setattr(newton, "ROWS", 100)
    few = newton.logistic(d, 9)
    assert len(passes) <= 15 and set(passes) == {"_squares"}
    monkeypatch.setattr(newton, "DENSE", 8)
    many = newton.logistic(d, 9)
    assert passes.count("_sum") > 15 and np.allclose(few, many, atol=1e-6)


def test_texts_are_cut_once_for_vocabulary_and_weights(spark, monkeypatch):
    rng = random.Random(6)
    words = ["aa", "bb", "cc", "b", "7", "é", "x_1", "+", *[f"w{i}" for i in range(60)]]
    texts = [" ".join(rng.choices(words[: rng.randint(1, 68)], k=rng.randint(0, 40))) for _ in range(150)] + [None, "", "aa aa aa", "?"]
    rows = [*enumerate(texts), (3, "aa bb aa bb"), (None, "aa cc")]  # an id twice, a null id
    d = spark.createDataFrame(rows, "sample_id long, code string").repartition(3)
    train = d.where("sample_id % 3 <> 1")
    monkeypatch.setattr(K, "CUT", 200)
    cuts = K.cut_texts(d, train)
    for most, limit in ((200_000, 5), (200_000, 60), (2, 60), (200_000, 100_000)):
        monkeypatch.setattr(K, "WORDS", most)
        vocab = K.vocabulary_of(cuts, 100, limit)
        assert [(r["term"], r["df"], r["total"]) for r in vocab.collect()] == brute([t for i, t in rows if i is not None and i % 3 != 1], limit)
        if limit < 100:
            place = {t: i for i, t in enumerate(sorted(r["term"] for r in vocab.collect()))}
            want = {(r["sample_id"], place[r["term"]]): r["weight"] for r in K.tfidf(K.ngrams(d.where("sample_id is not null"), vocab=vocab), vocab).collect()}
            got = {(r["sample_id"], i): w for r in K.term_vectors(cuts, vocab).where("sample_id is not null").collect() for i, w in zip(r["i"], r["weight"], strict=True)}
            assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_regression_of_some_columns_sums_the_hessian_twice_at_most(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 9)) * rng.uniform(0.1, 30, 9)
    x[rng.random(x.shape) < 0.5] = 0
    y = (x @ rng.normal(size=9) + rng.normal(size=600) * 20 > 3).astype(float)
    rows = [(np.flatnonzero(a).tolist(), a[np.flatnonzero(a)].tolist(), b, 1.0 + (b == 1)) for a, b in zip(x, y.tolist(), strict=True)]
    d = spark.createDataFrame(rows, "index array<int>, value array<double>, y double, w double").repartition(3)
    want = newton.logistic(d, 9)
    passes = []
    for name in ("_sum", "_squares"):
        monkeypatch.setattr(newton, name, lambda *a, own=getattr(newton, name), n=name: passes.append(n) or own(*a))
    monkeypatch.setattr(newton, "NEWTON", 8)
    assert np.allclose(newton.logistic(d, 9), want, atol=1e-7)
    assert 1 <= passes.count("_squares") <= 2 and passes.count("_sum") <= 30


def test_blocks_hold_few_entries_and_come_one_at_a_time(spark, monkeypatch):
    rows = [(list(range(n)), [1.0] * n, float(n % 2), 1.0) for n in (3, 0, 70, 10, 10, 90, 5)]
    d = spark.createDataFrame(rows, "index array<int>, value array<double>, y double, w double").coalesce(1)
    monkeypatch.setattr(newton, "ENTRIES", 64)
    monkeypatch.setattr(newton, "BLOCK", 3)
    got = [np.frombuffer(r["length"], np.int32).tolist() for r in newton._packed(d).collect()]
    assert sorted(n for x in got for n in x) == [0, 3, 5, 10, 10, 70, 90]
    assert all(len(x) <= 3 and (len(x) == 1 or sum(x) <= 64) for x in got)
