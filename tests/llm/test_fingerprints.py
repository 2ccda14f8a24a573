"""Fingerprints, periodic runs and alignment against brute force."""

import hashlib
import random
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.llm import align, oneperm, runs
from siltstone.llm import queries as Q
from tests.llm.data import SCHEMA, corpus, documents, words

A, B = f"{Q.TOKENIZERS}/byte_bpe_50k.json", f"{Q.TOKENIZERS}/piece_bpe_32k.model"


def saved(spark, tmp_path, rows):
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- runs ------------------------------------------------------------------------------------------------------------------


def brute_runs(x, exponent=4, least=6):
    out = []
    for q in range(1, len(x)):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, exponent * q) and not any(all(x[k] == x[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_small_alphabets():
    rng, found = random.Random(1), 0
    for _ in range(1500):
        x = [rng.randrange(rng.choice([1, 2, 2, 3, 4])) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3) if x else 0):
            p, a = rng.randint(1, 6), rng.randrange(len(x))
            block, n = [rng.randrange(3) for _ in range(p)], rng.randint(2, 30)
            x[a : a + n] = [block[i % p] for i in range(n)]
        x += x[: rng.randint(0, len(x))] * rng.randint(0, 2)
        for exponent, least in ((2, 2), (4, 6), (2.5, 1)):
            want = brute_runs(x, exponent, least)
            found += len(want)
            assert runs.runs_of(x, exponent, least) == want
            assert runs.find_in(x, exponent, least) == want
    assert found > 10000


def test_factors_are_the_longest_earlier_stretches():
    rng = random.Random(2)
    for _ in range(300):
        x = [rng.randrange(3) for _ in range(rng.randint(0, 40))]
        at = 0
        for start, source, n in runs.factors(x):
            assert start == at
            longest = max((next((m for m in range(len(x) - at) if x[j + m] != x[at + m]), len(x) - at) for j in range(at)), default=0)
            assert n == max(1, longest) and (source == -1) == (longest == 0)
            assert source < start and (source < 0 or x[source : source + n] == x[start : start + n])
            at += n
        assert at == len(x)


def planted(i, text):
    w = (text or "").encode().split()
    n = len(w)
    if i is not None and n and (h := zlib.crc32(str(i).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
    return [x.decode() for x in w]


def test_runs_query(spark, tmp_path):
    rng = random.Random(4)
    rows = corpus() + [(300 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 80)))) for i in range(60)]
    rows += [(400, "x " * 5000), (401, "a b c " * 4), (402, "a b c " * 3), (403, "a a a a a"), (404, "a a a a a a"), (405, ("one two\t" * 9) + "\v" + "z y x " * 5), (401, "a b c " * 4)]
    want = []
    for i, t in rows:
        w = planted(i, t)
        r = brute_runs(w) if len(set(w)) > 1 else [(0, len(w), 1)] if len(w) >= 6 else []
        top = min(r, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        drop = {j for s, n, q in r for j in range(s + q, s + n)}
        want.append((i, len(r), *top, top[1] and 1000 * top[1] // top[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in r)), sha(" ".join(x for j, x in enumerate(w) if j not in drop))))
    got = [tuple(r) for r in Q.op12_runs(spark, saved(spark, tmp_path, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(x[1] for x in want) > 40
    assert runs.find(documents(spark, rows).limit(0)).count() == 0


# -- fingerprints ----------------------------------------------------------------------------------------------------------


def edited(rows):
    """(id, text, edited text, next text) with ids in descending order, nulls last; ids are distinct."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        yield i, t, t[: len(t) - half] + after[:half], after


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_fingerprint_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [r for i, r in enumerate(corpus(n=150)) if r[0] not in [x[0] for x in corpus(n=150)[:i]]] + [(500 + i, words(rng, 400)) for i in range(40)] + [(-3, "é漢 🙂 x"), (-9, None)]
    got = {r["doc_id"]: r for r in Q.op11_fingerprints(spark, saved(spark, tmp_path, rows)).collect()}
    assert len(got) == len(rows)
    apart, prints = [], {}
    for i, t, e, after in edited(rows):
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(e))
        assert len(r["fingerprint"]) == 512 and prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        apart += [r["near_edited"] - jaccard(t, e), r["near_next"] - jaccard(t, after)]
        assert 0 <= r["near_edited"] <= 1
        if t == e:
            assert r["near_edited"] == 1 and r["edited_fingerprint"] == r["fingerprint"]
    assert abs(sum(apart)) / len(apart) < 0.01 and (sum(x * x for x in apart) / len(apart)) ** 0.5 < 0.05


def brute_fingerprint(hashes, bins, bits):
    """The packed fingerprint of the signed shingle hashes, from the definition."""
    least = {}
    for h in hashes:
        b = (h >> (64 - bins.bit_length() + 1)) + bins // 2
        least[b] = min(h, least.get(b, h))
    full = [least[b] for b in sorted(least)]
    out = []
    for b in range(bins):
        own = oneperm.SHIFT + oneperm.STEP * oneperm.ATTEMPTS * b
        tries = [(own + oneperm.STEP * t) % oneperm.PRIME % bins for t in range(oneperm.ATTEMPTS)]
        h = least[b] if b in least else next((least[j] for j in tries if j in least), None)
        out.append((full[own % oneperm.PRIME % len(full)] if h is None else h) % (1 << bits))
    return "".join(f"{x:0{bits // 4}x}" for x in out)


@pytest.mark.parametrize("bins,bits", [(256, 8), (64, 4), (128, 16)])
def test_fingerprint_by_definition(spark, bins, bits):
    d = documents(spark, corpus(n=40))
    hashes = {}
    for i, t, h in oneperm._shingles(d.select("doc_id", "text"), "text", "h", 5).collect():
        hashes.setdefault(t or "", h)
    fp = oneperm.fingerprint(d, "text", "fp", bins=bins, bits=bits)
    for r in fp.select("text", oneperm.hex_of(F.col("fp")).alias("x")).collect():
        assert r["x"] == brute_fingerprint(hashes[r["text"] or ""], bins, bits)
    pairs = fp.select("text", "fp").limit(12)
    both = pairs.crossJoin(pairs.select(F.col("fp").alias("g"), F.col("text").alias("u")))
    for r in both.select(oneperm.hex_of(F.col("fp")).alias("a"), oneperm.hex_of(F.col("g")).alias("b"), oneperm.likeness(F.col("fp"), F.col("g"), bins=bins, bits=bits).alias("near")).collect():
        w = bits // 4
        same = sum(r["a"][k : k + w] == r["b"][k : k + w] for k in range(0, len(r["a"]), w)) / bins
        assert r["near"] == pytest.approx(max(0, (same - 2.0**-bits) / (1 - 2.0**-bits)))


def test_fingerprints_of_odd_tables(spark):
    rows = corpus(n=20)
    d = documents(spark, rows).withColumnsRenamed({"term": "FP", "h": "o", "k": "stands"})
    got = oneperm.followed(d)
    assert got.count() == len(rows) and oneperm.followed(d.limit(0)).count() == 0
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    ids = [i for i, _ in order]
    after = {(i, t): order[(k + 1) % len(order)][1] for k, (i, t) in enumerate(order)}
    for r in got.collect():
        if ids.count(r["doc_id"]) == 1:
            k = ids.index(r["doc_id"])
            near = ids[(k + 1) % len(ids)]
            assert r["next_text"] == after[r["doc_id"], r["text"]] or ids.count(near) > 1 and r["next_text"] in {t for i, t in order if i == near}
    one = oneperm.followed(documents(spark, [(5, "only one")] * 3)).collect()
    assert len(one) == 3 and all(r["next_text"] == "only one" for r in one)
    # a block for nearly every row gives the same
    small = oneperm.followed(d, block=64)
    assert sorted(map(repr, small.collect())) == sorted(map(repr, got.collect()))


# -- alignment -------------------------------------------------------------------------------------------------------------


def tokens(text):
    """(ids of A, ids of B, their ends), from the tokenizers over the whole text; None without tokens."""
    if not text:
        return None
    t = TOK[0]
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    raw, out = b" " + text.encode(), []
    for ids, token in ((a, t.a_bytes), (b, t.b_bytes)):
        if b"".join(token[i] for i in ids) != raw:
            return None
        ends = []
        for i in ids:
            ends.append((ends[-1] if ends else 0) + len(token[i]))
        out.append(ends)
    return a, b, *out


TOK = []


def brute_alignment(rows):
    if not TOK:
        with open(A, "rb") as a, open(B, "rb") as b:
            TOK.append(align.Tokenizers(a.read(), b.read()))
    found = [(i, tokens(t)) for i, t in rows]
    count, links, grouped = Counter(), [], []
    for _, f in found:
        own, names = [], []
        if f:
            a, b, end_a, end_b = f
            for j, x in enumerate(a):
                begin = end_a[j - 1] if j else 0
                k = bisect_right(end_b, begin)
                while k < len(b) and (end_b[k - 1] if k else 0) < end_a[j]:
                    own.append((x, b[k]))
                    k += 1
            last = (0, 0)
            for e in sorted(set(end_a) & set(end_b)):
                to = (bisect_left(end_a, e) + 1, bisect_left(end_b, e) + 1)
                names.append(",".join(map(str, a[last[0] : to[0]])) + "|" + ",".join(map(str, b[last[1] : to[1]])))
                last = to
        links.append(own)
        grouped.append(names)
        count.update(own)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [
        (i, len(f[0]), len(f[1]), len(g), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), sha(";".join(g))) if f else (i, 0, 0, 0, 0, 0, 0, "")
        for (i, f), own, g in zip(found, links, grouped, strict=True)
    ]


ALPHABET = [*"ab the of  \n\t. é漢字🙂▁\0   \x85\x1c᠎​﻿123'sll", "<|endoftext|>", "</s>", "<0x41>", "  ", "   ", "The", "ing"]


def test_alignment_query(spark, tmp_path):
    rng = random.Random(8)
    rows = corpus() + [(600 + i, "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 40)))) for i in range(300)]
    rows += [(1000, " "), (1001, "x "), (1002, "the <|endoftext|> of"), (1003, "a▁b"), (1004, "\n"), (1005, "word" * 9000)]
    got = [tuple(r) for r in Q.op13_alignment(spark, saved(spark, tmp_path, rows)).collect()]
    want = brute_alignment(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[1] == 0 for w in want) > 20 and sum(w[1] > 0 for w in want) > 100
    d = documents(spark, rows)
    small = [tuple(r) for r in align.align(d.repartition(7), A, B, size=500).collect()]  # many blocks
    assert sorted(small, key=repr) == sorted(want, key=repr)
    named = {r["doc_id"]: ";".join(",".join(map(str, g["a"])) + "|" + ",".join(map(str, g["b"])) for g in r["groups"]) for r in align.groups(d, A, B).collect()}
    assert all((sha(named[w[0]]) if named[w[0]] else "") == w[7] for w in want if [x[0] for x in want].count(w[0]) == 1)
    assert align.align(d.limit(0), A, B).count() == 0


def test_alignment_whole_where_cutting_is_uncertain():
    brute_alignment([])
    rng, whole = random.Random(9), align.Labels(TOK[0])
    cut = align.Labels(TOK[0])
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    by_chunk = [cut.render(n) for n in cut.number_of(texts)]
    TOK[0].cuts = False
    try:
        assert by_chunk == [whole.render(n) for n in whole.number_of(texts)]
    finally:
        TOK[0].cuts = True


def test_extra_columns_do_not_clash(spark):
    d = spark.createDataFrame([(1, "a b", "en", "s", 3, "block", 1, "pairs")], SCHEMA).withColumnsRenamed({"lang": "pairs", "source": "runs", "k": "groups"})
    assert align.align(d, A, B).first()["n_groups"] == 2 and runs.find(d).first()["n_words"] == 2
