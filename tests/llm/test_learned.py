"""Operators that learn or approximate: held-out accuracy and recall."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import embeddings, language, toxicity
from tests.llm.data import documents

STEMS = {"en": ["the", "and", "ing", "er", "th", "wh"], "fr": ["le", "é", "eau", "qu", "oi", "tion"], "de": ["sch", "ung", "ei", "ver", "ä", "ch"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randint(3, 80)), lang, "s") for i, lang in enumerate(rng.choices(list(STEMS), k=240))]
    rows += [(900, None, "en", "s"), (901, "", "fr", "s"), (902, "123 -- 4", "de", "s"), (903, "zzz", None, None), (None, "the and", None, None), (904, text(rng, "de", 90_000), "de", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    trees = language.Trees(language.sample(d.where("doc_id % 4 <> 2"), per_lang=30))
    got = {r["doc_id"]: r for r in language.identify(d, trees).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [r for r in rows if r[0] is not None and r[0] < 240 and r[0] % 4 == 2]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[904]["lang_pred"] == "de"
    assert language.identify(d.limit(0), trees).count() == 0
    none = language.Trees(language.sample(d.limit(0)))
    assert {r["lang_pred"] for r in language.identify(d, none).collect()} == {"und"}


def test_learning_takes_whole_texts(spark):
    """What tells the languages and the classes apart stands beyond the first 65 536 characters, between digits that say nothing."""
    rng = random.Random(5)
    far = lambda t: "0 1 " * 20_000 + t + " 0 1" * 20_000
    rows = [(i, far(text(rng, lang, 400)), lang, "s") for i, lang in enumerate(["en", "fr", "de"])] + [(9 + i, text(rng, lang, 60), None, "s") for i, lang in enumerate(["en", "fr", "de"] * 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(d, language.Trees(language.sample(d))).collect()}
    assert [got[9 + i] for i in range(12)] == ["en", "fr", "de"] * 4
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, far("vile vermin " * 3 if i % 2 else "mild meadow " * 3)) for i in range(40)] + [(100, "vile vermin"), (101, "mild meadow")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.Classes(*toxicity.sample(docs, labels))).collect()}
    assert s[100] > 0.5 > s[101]


def test_code_lengths_are_exact():
    sample = {"x": [b"abracadabra", b"abab"], "y": [b"zzzz abra"]}
    trees = language.Trees(sample)

    def slow(lang, t):
        counts = {}
        for s in sample[lang]:
            p = b" " * 3 + s
            for i in range(3, len(p)):
                for k in range(4):
                    counts.setdefault(p[i - k : i], {}).setdefault(p[i], 0)
                    counts[p[i - k : i]][p[i]] += 1
        total, p = 0.0, b" " * 3 + t
        for i in range(3, len(p)):
            bits = 0.0
            for k in (3, 2, 1, 0):
                c = counts.get(p[i - k : i])
                if c is None:
                    continue
                n, q = sum(c.values()), len(c)
                if p[i] in c:
                    bits -= np.log2(c[p[i]] / (n + q))
                    break
                bits -= np.log2(q / (n + q))
            else:
                bits += 8
            total += bits
        return total

    for t in (b"abra", b"zzq", b"", b"cadabz"):
        got = trees.lengths([t])[0]
        assert np.allclose(got, [slow("x", t), slow("y", t)], atol=1e-9)


def test_long_texts_do_not_depend_on_pieces(monkeypatch):
    trees = language.Trees({"x": [b"abracadabra" * 5], "y": [b"hocus pocus" * 5]})
    t = [b"abra hocus " * 50, b"", b"q" * 333, b"pocus"]
    whole = trees.lengths(t)
    monkeypatch.setattr(language, "PIECE", 64)
    assert np.allclose(trees.lengths(t), whole, rtol=1e-6)


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["idiot", "moron", "scum"]

    def doc(toxic):
        w = text(rng, rng.choice(list(STEMS)), rng.randint(5, 120)).split()
        for _ in range(2 if toxic else 0):
            w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        return " ".join(w)

    rows = [(i, doc(i % 6 == 0)) for i in range(600)]
    extra = [(900, None), (901, ""), (None, "idiot moron")]
    d = documents(spark, rows + extra)
    labels = spark.createDataFrame([(i, int(i % 6 == 0), 1) for i in range(600)] + [(700, None, 1)], "doc_id long, toxic int, y int")
    c = toxicity.Classes(*toxicity.sample(d.where("doc_id % 4 <> 1"), labels.where("doc_id % 4 <> 1")))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, c).collect()}
    held = [i for i in range(600) if i % 4 == 1]
    assert len(got) == len(rows) + len(extra) and all(0 <= s <= 1 for s in got.values())
    hot = [i for i in range(600) if i % 6 == 0]
    assert np.mean([got[i] >= 0.3 for i in hot]) >= 0.9 and np.mean([got[i] >= 0.3 for i in held]) <= 0.05 and got[None] >= 0.3 and got[900] < 0.3
    kept = toxicity.keep_ordinary(d, c)
    assert kept.columns == d.columns and kept.count() == sum(s < 0.3 for s in got.values())
    none = toxicity.Classes(*toxicity.sample(d, labels.limit(0)))
    assert {r["score"] for r in toxicity.score(d, none).collect()} == {0.0}


def brute_likelihood(texts, d, least):
    """p(w | v, c) by dictionaries, from the texts of (toxic, ordinary)."""
    n, pairs, begins = [], [], []
    for x in texts:
        docs = [toxicity.words_of(t) for t in x]
        two = {(v, w) for t in docs for v, w in zip([b"", *t], t)}
        three = {(u, v, w) for t in docs for u, v, w in zip([b"", *t], t, t[1:])}
        n.append(Counter(w for _, w in two))
        pairs.append(Counter((v, w) for _, v, w in three))
        begins.append(Counter(w[:5] for w in {w for _, w in two}))
    words = {b""} | set(n[0]) | set(n[1])
    starts = {w[:5] for w in words}
    has = {w: max(1, (w in n[0]) + (w in n[1])) for w in words}
    of_start = {b: 1 + sum(has[w] for w in words if w[:5] == b) for b in starts}
    begin_has = {b: max(1, (b in begins[0]) + (b in begins[1])) for b in starts}

    def begin(b, c):
        low = begin_has.get(b, 1) / (sum(begin_has.values()) + 1)
        return (max(begins[c][b] - d, 0) + d * len(begins[c]) * low) / sum(begins[c].values())

    def single(w, c):
        b = w[0] if isinstance(w, tuple) else w[:5]  # (b,): the unknown words that begin so
        low = begin(b, c) * (has.get(w, 1) / of_start[b] if b in starts else 1)
        return (max(n[c][w] - d, 0) + d * len(n[c]) * low) / sum(n[c].values())

    both = pairs[0] + pairs[1]
    lean = {(w, c): single(w, c) / (single(w, 0) / 2 + single(w, 1) / 2) for w in words for c in (0, 1)}

    def share(count, v, w):
        total = sum(k for (x, _), k in count.items() if x == v)
        return max(count[v, w] - d, 0) / total if total and both[v, w] >= least else 0.0

    def left(count, v):
        return 1 - sum(share(count, v, w) for w in {w for x, w in count if x == v})

    def likelihood(v, w, c):
        norm = sum(share(both, v, x) * lean[x, c] for x in {x for y, x in both if y == v}) + left(both, v)
        back = (share(both, v, w) * lean.get((w, c), 1) + left(both, v) * single(w, c)) / norm
        return share(pairs[c], v, w) + left(pairs[c], v) * back

    return likelihood, words, starts


def test_class_models_are_proper_and_exact():
    rng = random.Random(5)
    nouns = ["apple", "applet", "appletree", "moron", "moronic", "the", "a", "of"]
    make = lambda k, bad: [" ".join(rng.choice(nouns[: 3 + 2 * bad] + nouns[5:]) for _ in range(rng.randint(0, 12))) for _ in range(k)]
    toxic, ordinary = make(4, 1), make(3, 0)  # fewer than five: all of them are learnt from
    for least in (1, 2, 3):
        likelihood, words, starts = brute_likelihood((toxic, ordinary), 0.6, least)
        for c in (0, 1):
            for v in (b"", b"the", b"moron", b"apple"):
                unknown = [(b,) for b in starts] + [(b"never",)]
                assert abs(sum(likelihood(v, w, c) for w in [*words, *unknown]) - 1) < 1e-9
        model = toxicity.Classes(toxic, ordinary, discount=0.6, least=least)
        docs = [toxicity.words_of(t) for t in [*toxic, *ordinary, "moron apple the", "moronish the appleseed a zebra moron the", ""]]
        got, heard = model.likelihoods(docs)
        i = 0
        for t in docs:
            for before, w in zip([b"", *t], t):
                for c in (0, 1):
                    if w[:5] not in starts:
                        assert not heard[i] and got[c, i] == 0
                    elif before not in words:
                        assert abs(math.exp(got[c, i]) - (likelihood(b"nothing before", w, c))) < 1e-6
                    else:
                        assert abs(math.exp(got[c, i]) / likelihood(before, w, c) - 1) < 1e-4, (before, w, c)
                i += 1


def test_toxicity_of_awkward_samples(spark):
    assert (toxicity.Classes([], ["a"]).scores(["x", None]) == 0).all()
    for toxic, ordinary in ((["", "."], ["..", "!"]), (["a"], ["a"]), (["moron " * 3] * 7, ["the end"] * 9)):
        s = toxicity.Classes(toxic, ordinary).scores(["moron", "", None, "the end of it " * 9])
        assert np.isfinite(s).all() and s[1] == s[2]
    rows = [(1, "vile moron", "p", "q")] * 500 + [(i, f"calm words {i}", "p", "q") for i in range(2, 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, c string, y string")
    labels = spark.createDataFrame([(1, 1)] * 3 + [(i, 0) for i in range(2, 40)], "doc_id long, toxic int")
    toxic, ordinary, share = toxicity.sample(d, labels, per_class=5)
    assert toxic == ["vile moron"] and len(ordinary) == 5 and 0 < share < 0.1
    model = toxicity.Classes(*toxicity.sample(d, labels))
    kept = toxicity.keep_ordinary(d, model)
    assert kept.columns == d.columns and kept.count() <= len(rows)
    assert toxicity.score(d.limit(0), model).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    near = [base[i % 40] + 0.1 * rng.normal(size=16) for i in range(160)] + [base[3] * 2, base[3]]
    hub = [base[0] + 0.05 * rng.normal(size=16) for _ in range(80)]
    rows = [(i, [float(x) for x in v], 0, "k") for i, v in enumerate([*base, *near, *hub])]
    n = len(rows)
    rows += [(n, None, 0, "k"), (n + 1, [0.0] * 16, 0, "k"), (n + 2, [None] + [1.0] * 15, 0, "k"), (n + 3, [float("nan")] * 16, 0, "k"), (n + 4, [], 0, "k"), (n + 5, [1.0, 2.0], 0, "k"), (n + 6, [2.0, 4.0], 0, "k"), (n + 7, rows[3][1], 1, "k"), (None, rows[3][1], 1, "k")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string")
    got = embeddings.group(d, per_shard=60)
    x = {i: np.array(v) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    keys = list(x)
    links = {i: [j for j in keys if j != i and len(x[i]) == len(x[j]) and x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= 0.9] for i in keys}
    rows_out = {r["vec_id"]: r for r in got.collect()}
    assert len(rows_out) == len(rows)
    true, found = sum(map(len, links.values())), sum(r["n_links"] for r in rows_out.values())
    assert true > 5000 and 0.9 * true <= found and all(rows_out[i]["n_links"] <= len(links[i]) for i in keys)
    assert all(rows_out[i]["n_links"] == 0 and rows_out[i]["kept"] for i in (n, n + 1, n + 2, n + 3, n + 4)) and rows_out[n + 5]["n_links"] == 1
    parent = {i: i for i in keys}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, js in links.items():
        for j in js:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    assert np.mean([rows_out[i]["component_id"] == find(i) for i in keys]) >= 0.95
    assert embeddings.audit(d, got, every=10) >= 0.9
    assert embeddings.group(d.limit(0)).count() == 0


def test_embeddings_across_shards(spark):
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(1000, 64)))
    y = unit(x + 0.45 * unit(rng.normal(size=x.shape)))
    v = np.concatenate([x, y])
    got = embeddings.group(spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(v)], "vec_id long, embedding array<double>"), sample=200, per_shard=20, least=1.0, probes=2000)
    want = (v @ v.T >= 0.9).sum(axis=1) - 1
    assert want.sum() > 1000
    rows = got.orderBy("vec_id").collect()
    assert [r["n_links"] for r in rows] == want.tolist() and rows[0]["recall"] == 1.0


def test_vectors_of_extreme_size(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1.1e200]), (2, [1e-200, 1e-200]), (3, [1e-320, 1e-320]), (4, [1e308, -1e308]), (5, [float("inf"), 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.group(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4), 5: (0, 5)}


def test_graph_is_pruned():
    x = np.random.default_rng(0).normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = embeddings.Graph(x)
    degree = np.bincount(g.a, minlength=200)
    entered = np.bincount(g.b, minlength=200)
    assert degree.min() >= 1 and entered.min() >= min(embeddings.SURE, degree.min()) and degree.mean() <= 3 * embeddings.DEGREE
    edges = np.full((200, degree.max()), -1)
    edges[g.a, np.arange(len(g.a)) - np.searchsorted(g.a, g.a)] = g.b
    sim = embeddings.search(x, edges, x[:50], [np.array([7])] * 50, 0.7)
    seen = sim > -2
    assert np.allclose(sim[seen], (x[:50] @ x.T)[seen]) and (sim >= 0.7).sum() >= 0.95 * (x[:50] @ x.T >= 0.7).sum()


def test_repeated_and_long_rows_are_learnt_from(spark):
    rows = [(i, f"uno dos {i}", "es") for i in range(4)] * 5000 + [(10, "ab cd " * 30000, "xx"), (11, "½ ² 3", "yy"), (12, None, "es")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"c_label": F.lit(1), "label": F.lit(2), "i": F.lit(3)})
    got = language.sample(d)
    assert sorted(got["es"]) == sorted(f"uno dos {i}".encode() for i in range(4)) and len(got["xx"]) == 1 and len(got["xx"][0]) == 180_000
    assert sum(len(x) for x in language.sample(d, per_lang=2).values()) == 3 and "yy" not in got
    assert language.Trees(got).best(["½ ²", "², ①", "", None, "dos"])[0] == ["und"] * 4 + ["es"]


def test_sample_is_bounded(spark):
    d = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("abc def").alias("text"), F.lit("en").alias("lang"))
    assert len(language.sample(d, per_lang=7)["en"]) == 7
