"""Operators with exact results, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import chunks, decontaminate, graph, mixing, ngram, pii, repeats, simhash, urls
from siltstone.llm.common import n_spaced_words
from tests.llm.data import SCHEMA, corpus, documents, words

KEY = lambda r: tuple((v is None, v) for v in r)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def test_decontaminate(spark):
    docs = corpus()
    items = [(1, " ".join(alnum(docs[5][1])[3:30])), (2, "one two"), (30, " ".join(alnum(docs[8][1])[:14])), (4, None), (5, "..."), (1, "never seen words at all")]
    items.append((9, items[0][1]))
    windows = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[s : s + 13])].add(i)
    want = []
    for i, t in docs:
        w = alnum(t)
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                found = windows.get(tuple(w[s : s + n]))
                if found:
                    hit |= set(range(s, s + n))
                    ids |= found
        want.append((i, len(w), len(hit), len(ids), ",".join(sorted(map(str, ids))), bool(hit) and 20 * len(hit) >= len(w)))
    d = documents(spark, docs)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("phrase", F.lit("p"))
    r = decontaminate.report(d, b)
    got = [(x["doc_id"], x["n_words"], x["n_hit"], x["n_items"], ",".join(x["items"]), x["contaminated"]) for x in r.collect()]
    assert sorted(got, key=KEY) == sorted(want, key=KEY)
    assert sum(x[2] for x in want) > 40
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not x[5] for x in want)
    odd = d.withColumns({"bad_id": F.lit(1), "BAD_H": F.lit(2), "pos": F.lit(3)})
    assert decontaminate.clean(odd, b).columns == odd.columns and decontaminate.clean(odd, b).count() == kept.count()
    # proximity: seen from the rarest word, every word stands within the slop of its place
    tf = Counter(w for _, t in docs for w in alnum(t))
    for slop in (1, 2):
        near = set()
        for i, t in docs:
            w = alnum(t)
            for phrase, ids in windows.items():
                if any(x not in tf for x in phrase):
                    continue
                _, off, rare = min((tf[x], o, x) for o, x in enumerate(phrase))
                for p in (p for p, x in enumerate(w) if x == rare):
                    s = p - off
                    if s >= -slop and all(x in w[max(0, s + o - slop) : max(0, s + o + slop + 1)] for o, x in enumerate(phrase)):
                        near |= {(x, " ".join(phrase), i, s) for x in ids}
        got = {(x["item_id"], x["phrase"], x["doc_id"], x["start"]) for x in decontaminate.find(d, b, slop=slop).collect()}
        assert got == near and len(near) > 0
    assert {x["doc_id"]: x["n_hit"] <= x["n_words"] for x in decontaminate.report(d, b, slop=2).collect()}.values() != {False}
    one = spark.createDataFrame([(1, "zeta wrong kappa other stuff common omega")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "zeta common kappa common omega common")], "item_id long, text string")
    assert decontaminate.find(one, item, slop=1).count() == 0
    assert decontaminate.report(d, b.limit(0)).agg(F.sum("n_hit")).first()[0] == 0 and decontaminate.report(d.limit(0), b).count() == 0


def test_fingerprints_and_groups(spark):
    docs = corpus()
    rng = np.random.default_rng(1)
    long = [f"w{i}" for i in rng.integers(0, 9999, 3000)]
    docs += [(300 + j, " ".join([*long[: 37 * j], "z", *long[37 * j + 1 :]])) for j in range(12)]
    rows = simhash.group(documents(spark, docs)).collect()

    def brute(t):
        w = (t or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hs) > len(hs))

    want = Counter((i, brute(t)) for i, t in docs)
    assert Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in rows) == want
    kinds = sorted({f for _, f in want})
    parent = {f: f for f in kinds}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    n = 0
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(b)] = find(a)
                n += 1
    assert n > 5
    least = {}
    for (i, f), _ in want.items():
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    assert all(r["component_id"] == least.get(find(r["fp"] % (1 << 64))) for r in rows)
    kept = simhash.dedup(documents(spark, docs))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None) == sorted(least.values())
    assert simhash.group(documents(spark, docs).limit(0)).count() == 0


def test_dedup_keeps_a_row_of_each_component(spark):
    rng = random.Random(4)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    rows = [(None, a), (None, b), (None, a), (None, None), (1, c), (1, d), (1, d), (2, d), (2, e), (None, c)]
    kept = simhash.dedup(documents(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=KEY) == sorted([(None, a), (None, b), (None, None), (1, c), (1, d), (2, e)], key=KEY)



@pytest.mark.parametrize("flips", [(0,), (5, 9), (1, 40), (3, 33, 63), (60, 61, 62), (31, 32, 0)])
def test_ball_finds_every_pair_within_three_bits(spark, flips):
    base = [0x0123456789ABCDEF, 0, (1 << 64) - 1, 0xAAAAAAAAAAAAAAAA]
    far = [b ^ sum(1 << f for f in flips) for b in base]
    fps = {v - (1 << 64) if v >> 63 else v for v in base + far}
    e = simhash.links(spark.createDataFrame([(v,) for v in fps], "fp long")).collect()
    roots = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame([tuple(x) for x in e], "a long, b long")).collect()}
    assert len(set(roots.values())) == 4 and len(roots) == len(fps)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)] + [(600, 601 + i) for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(find(n) == r for n, r in got.items()) and set(got) == {x for e in edges if e[0] != e[1] for x in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark):
    docs = corpus(n=200) + [(900, "w " * 50)] * 5
    d = documents(spark, docs, ("b", "a", None, "c", "d"))
    rows = mixing.mix(d, fan_in=4).collect()
    assert len(rows) == len(docs)
    size = defaultdict(int)
    for r in rows:
        size[r["source"]] += r["size"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(size.values()), {}, set(names)
    left = float(total)
    while True:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if 3 * size[s] <= share * weight[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= over
    target |= {s: share * weight[s] for s in free}
    big = max(r["size"] for r in rows)
    for s in names:
        own = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == size[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= big
    again = mixing.mix(d.repartition(9), fan_in=4).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    assert mixing.mix(d.limit(0)).count() == 0
    assert d.select(n_spaced_words(F.col("text")).alias("n")).agg(F.sum("n")).first()[0] == total


def test_targets_stop_at_the_cap(spark):
    s = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 1, 1), (None, 0, 1)], "source string, source_size long, n long")
    t = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    assert t["c"] == 3.0 and t[None] == 0.0 and t["a"] == 30.0 and abs(t["b"] - (1011 - 33)) < 1e-9


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans(t):
    out = []
    for o, (k, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or ""):
            v = m.group()
            d = re.sub("[^0-9]", "", v)
            ok = {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 14 <= len(d) <= 19 and luhn(d or "0"), "phone": 10 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), o, m.end(), k))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


TRICKY = [
    "a@b.cc_d@e.ff 😀 x@y", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 01.002.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (456) 555-2186 +1 2 +12345678901234567890", "4111111111111111 12 3-4 5  6", "é@é.de à.b@c-d.é q@w.e.r.t.", "+4 4111 1111 1111 1111.", "a" * 20000 + "@", "1 " * 9000, "1.1.1.1" * 300,
    "0000 0000 0000 00 1", "x@y.z" * 50, "+1" + "2" * 9 + " 3.4.5.6",
]


def test_base_spans(spark):
    texts = [(i, t) for i, t in enumerate(TRICKY)] + corpus()
    rows = pii.find(documents(spark, texts)).select("doc_id", pii.render(F.col("spans")).alias("s")).collect()
    assert sorted([(r["doc_id"], r["s"]) for r in rows], key=KEY) == sorted([(i, spans(t)) for i, t in texts], key=KEY)


def test_disclosing_terms(spark):
    texts = [(i, f"Please write to Zebulon Quagmire at zeb.q@mail.example.com about number {i} now, says Zebulon") for i in range(5)] + [(i, f"please write about number {i} now and at once") for i in range(5, 300)] + [(None, None)]
    d = documents(spark, texts)
    r = {x["doc_id"]: x for x in pii.find(d).collect()}
    assert {x["v"] for x in r[0]["extra"]} == {"Zebulon", "Quagmire"} | {x["v"] for x in r[0]["extra"]} and len([x for x in r[0]["extra"] if x["v"] == "Zebulon"]) == 2 and r[9]["extra"] == []
    safe = pii.sanitise(d)
    t = {x["doc_id"]: x["text"] for x in safe.collect()}
    assert safe.columns == d.columns and "Zebulon" not in t[0] and "[EMAIL]" in t[0] and t[9] == texts[9][1] and t[None] is None
    assert pii.find(d.limit(0)).count() == 0


def test_disclosing_terms_of_whole_documents(spark):
    far = " ".join(["then some more of the common words"] * 30)
    texts = [(i, f"Li has account ab12 {far} write to zeb.q@mail.example.com" + (" Brunhild" if i % 2 else f" {far} Brunhild")) for i in range(6)]
    texts += [(i, f"write to number {i} of mail {far}") for i in range(6, 400)] + [(400, "ask LI or Lila"), (2, texts[2][1])]
    want = {"li", "has", "account", "ab12", "brunhild"}
    r = pii.find(documents(spark, texts)).collect()
    assert len(r) == len(texts)
    for x in r:
        assert {s["v"].lower() for s in x["extra"]} == (want if x["doc_id"] < 6 else {"li"} if x["doc_id"] == 400 else set()), x
    t = {x["doc_id"]: x["text"] for x in pii.sanitise(documents(spark, texts)).collect()}
    assert "ab12" not in t[0] and "Brunhild" not in t[0] and "Li " not in t[0] and t[7] == texts[7][1] and t[400] in ("ask  or Lila", "ask [NAME] or Lila")


def test_general_terms(spark):
    d = spark.createDataFrame([("Li ab12 42 word Émile",)], "text string")
    rows = [("Li", 0), ("ab12", 3), ("42", 8), ("word", 11), ("Émile", 16)]
    found = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(4).alias("o"), F.lit(s + len(v)).alias("e"), F.lit("term").alias("kind"), F.lit(v).alias("v")) for v, s in rows])
    assert d.select(pii.redact(F.col("text"), found)).first()[0] == "[NAME] [CODE] [NUMBER] [TERM] [NAME]"


def test_disclosure_against_brute_force(spark):
    """Disclosure of every word for every value by plain counts over whole documents."""
    import math
    import random

    rng = random.Random(8)
    pool = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(150):
        who = i % 15
        own = [f"n{who}x", f"q{who // 2}y"] if i < 60 else []
        mail = f" u{who}@mail.example.com" if i < 60 else ""
        texts.append((i, " ".join([*rng.sample(pool, 6), *(w for w in own if rng.random() < 0.97)]) + mail))
    texts += [(200, "n3x only here"), texts[5], texts[5]]
    counts, told = Counter(i for i, _ in texts), dict(texts)
    total = sum(counts.values())
    words = {i: set(alnum(re.sub(r"\S+@\S+", " ", t))) for i, t in told.items()}
    value = {i: re.findall(r"\S+@\S+", t) for i, t in told.items()}
    want = {}
    for e in {v for x in value.values() for v in x}:
        docs = [i for i in told if e in value[i]]
        n_e = sum(counts[i] for i in docs)
        for w in {w for i in docs for w in words[i]}:
            both = [i for i in docs if w in words[i]]
            n_t = sum(counts[i] for i in told if w in words[i])
            if len(both) >= 3:
                d = math.log(total * sum(counts[i] for i in both) / (n_e * n_t)) / math.log(total / n_e)
                if d >= 0.85:
                    want[w] = max(d, want.get(w, 0))
    df = documents(spark, texts)
    f = pii.find(df).where("size(spans) > 0")
    keyed = df.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("k"), "text")
    got = {r["term"]: (r["disclosure"], r["action"]) for r in pii.disclosing_terms(f.select("k", "text", "spans"), keyed).collect()}
    assert set(got) == set(want) and len(want) >= 10
    assert all(abs(got[w][0] - d) < 1e-9 and got[w][1] == ("gone" if d >= 0.95 else "term") for w, d in want.items())



def brute_repeats(docs):
    first = {}
    for i, t in sorted(docs, key=lambda x: (x[0] is None, x[0])):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        g = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            j = first[b[p : p + 50]]
            if j is not None and (i is None or j < i):
                g[p : p + 50] = True
        runs = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
        out.append((i, len(b), int(g.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 1 << 16])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(chunks, "CHUNK", 9000)
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = corpus() + [(i, ("ab" * 30) + str(i)) for i in range(400, 405)]
    got = [tuple(r) for r in repeats.remove(documents(spark, docs)).collect()]
    assert sorted(got, key=KEY) == sorted(brute_repeats(docs), key=KEY)
    assert repeats.remove(documents(spark, docs).limit(0)).count() == 0


def test_urls(spark):
    us = [None, "", "no scheme", "http://Example.COM/en/1?x", "https://www.example.com/en/2", "https://a.www.example.com/en/", "http://example.com", "http://example.com/en", "http://x.net/es/#f", "http://x.net/fr/q://z", "http://evil.org/x.example.com/en/", "http://spam-farm.org/x", "http://a.org/login/x", "http://com/", "http://notcom/", "http://a.org/*?", "ftp://u@h.com:80/p", "http://a.org/b.exe#x", "http://a\nb.com/"]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame([(i, u, u) for i, u in enumerate(us)], "page_id long, url string, host string")).collect()}
    rules = {i: got[i]["rule"] for i in got}
    assert [rules[i] for i in range(len(us))] == [None, None, None, "example.com/en/", "www.example.com/en/", "www.example.com/en/", None, "com/", "net/es/", "net/fr/", None, None, None, "com/", None, None, None, None, "com/"]
    assert got[11]["verdict"] == got[12]["verdict"] == got[17]["verdict"] == "block" and got[0]["verdict"] == got[10]["verdict"] == "allow" and got[3]["verdict"] == "block" and got[3]["host"] == "example.com" and got[3]["path"] == "/en/1"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_globs():
    cases = ["*.com/**", "a?c/*", "**/x", "abc", "*", "**", "a*b*c", "", "long" * 40 + "*", "*" + "y" * 130 + "/**"]
    texts = ["b.com/x/y", "abc/d", "a/c/", "q/w/x", "abc", "", "aXbYc", "a/b", "long" * 40 + "z", "z" * 3 + "y" * 130 + "/p/q", "x"]

    def regex(g):
        out = ""
        for p in re.split(r"(\*\*|\*|\?)", g):
            out += {"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p))
        return out

    m = urls.Automaton(cases).match([t.encode() for t in texts])
    assert m.tolist() == [[bool(re.fullmatch(regex(g), t)) for g in cases] for t in texts]


def test_elias_fano():
    rng = np.random.default_rng(2)
    for top in (1 << 10, 1 << 40, 1 << 64):
        v = np.unique(rng.integers(0, min(top, 1 << 63), 500).astype(np.uint64) | (np.uint64(top - 1) if top == 1 << 10 else np.uint64(0)) & rng.integers(0, 1 << 10, 500).astype(np.uint64))
        p = ngram.Packed(v, top)
        p.open(p.planes())
        assert (p.get(np.arange(len(v))) == v).all() and (p.find(v) == np.arange(len(v))).all()
        other = np.setdiff1d(rng.integers(0, min(top, 1 << 63), 100).astype(np.uint64), v)
        assert (p.find(other) == -1).all()


def chunk_of(texts):
    size = np.array([len(t) for t in texts], np.int64)
    ids = np.arange(len(texts), dtype=np.int64)
    return chunks.Chunk({"chunk": 0, "ids": ids.tobytes(), "null_ids": (ids < 0).tobytes(), "sizes": size.tobytes(), "texts": chunks.squeeze(b"".join(texts))})


def test_words_of_a_chunk():
    texts = [b"The cat", b"", b"cat\x0b\x1c the" + b"x" * 64, b" \t", b"y" * 65 + b" cat " + b"Y" * 65 + b"\r\n", b"cat", "é É".encode()]
    hashes, doc = ngram._words(chunk_of(texts))
    words = [(w, i) for i, t in enumerate(texts) for w in t.lower().split()]
    assert doc.tolist() == [i for _, i in words]
    named = dict(zip([w for w, _ in words], hashes.tolist(), strict=True))
    assert [named[w] for w, _ in words] == hashes.tolist() and len(set(named.values())) == len(named)


@pytest.mark.parametrize(("order", "split"), [(2, False), (3, False), (4, False), (2, True), (3, True)])
def test_lm_scores(spark, monkeypatch, order, split):
    monkeypatch.setattr(chunks, "CHUNK", 9000)
    docs = corpus()
    if split:  # as if these were so frequent that their n-grams are dealt to several buckets
        often = Counter(w for _, t in docs for w in (t or "").encode().lower().split()).most_common(30)
        parts = {h: 2 + i % 4 for i, h in enumerate(ngram._words(chunk_of([w for w, _ in often]))[0].tolist())} | {int(ngram.BEGIN): 5, 12345: 3}
        monkeypatch.setattr(ngram, "frequent", lambda table, n: ngram.Splits(parts))
    learn = lambda ids: np.array([i is not None and i % 3 != 0 for i in ids], dtype=bool)
    tokens = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in docs]
    train = [w for i, w in tokens if i is not None and i % 3 != 0]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    gram, after, kinds = Counter(), Counter(), Counter()
    for w in train:
        padded = (b"\t", *w)
        for k in range(2, order + 1):
            gram.update(padded[a : a + k] for a in range(len(padded) - k + 1))
    for g, k in gram.items():
        after[g[:-1]] += k
        kinds[g[:-1]] += 1

    def p(h, b):
        low = p(h[1:], b) if len(h) > 1 else (c[b] + 1) / (n + v + 1)
        return (max(gram[(*h, b)] - 0.75, 0) + 0.75 * kinds[h] * low) / after[h] if after[h] else low

    want = []
    for i, w in tokens:
        padded = (b"\t", *w)
        base = sum(np.log10((c[b] + 1) / (n + v + 1)) for b in w)
        score = sum(np.log10(p(padded[max(0, a - order + 1) : a], padded[a])) for a in range(1, len(padded)))
        want.append((i, len(w), sum(c[x] > 0 for x in w), n, base, score))
    got = [tuple(r) for r in ngram.score(documents(spark, docs), learn, order=order).collect()]
    for a, b in zip(sorted(got, key=KEY), sorted(want, key=KEY), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 and abs(a[5] - b[5]) < 0.01 * abs(b[5]) + 0.1
    assert ngram.score(documents(spark, docs).limit(0), learn, order=order).count() == 0
    empty = ngram.score(spark.createDataFrame([(1, None)], "doc_id long, text string"), lambda ids: np.zeros(len(ids), bool), order=order).first()
    assert (empty["n_tokens"], empty["n_known"], empty["train_tokens"], empty["base_score"]) == (1, 0, 0, 0.0)


def test_frequent_words_are_split(spark):
    d = spark.createDataFrame([(i, "the " * 50 + f"w{i} v{i % 7}") for i in range(200)] + [(None, None)], "doc_id long, text string")
    found = ngram.frequent(chunks.pack(d, size=2000), 64)
    the = ngram._words(chunk_of([b"the"]))[0][0]
    parts = dict(zip(found.words.tolist(), found.parts.tolist(), strict=True))
    assert 50 <= parts[int(the)] <= 64 and len(parts) <= 4 and len(np.unique(found.roots()[0])) == sum(parts.values())
    assert len(ngram.frequent(chunks.pack(d.limit(0)), 4).words) == 0


def test_schema_names_clash_on_purpose():
    assert {"term", "h", "k"} <= {f.split()[0] for f in SCHEMA.split(", ")}


def test_answers_of_the_trie_are_as_small_as_what_was_asked():
    learn = lambda ids: np.ones(len(ids), bool)
    asked = [m for _, _, m in ngram.Tokens(chunk_of([b"a b c", b"a b d"]), 1, learn).ask()]
    answers, _ = ngram._bucket_of(3)(asked * 3)
    assert len(answers) == 3 and max(map(len, answers)) < 300  # answers number chunks times buckets, so none may hold whole code books
    assert not ngram._book(ngram._codebook(np.zeros(0))[0]).any()
    x = np.array([0.001, 0.25, 0.5])
    scale, codes = ngram._codebook(x)
    assert ngram._book(scale)[codes - 1] == pytest.approx(x, rel=0.02)
