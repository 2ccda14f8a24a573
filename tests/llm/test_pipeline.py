"""The pipeline's stages on small awkward documents, each against a brute-force version on its own input."""

import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline as cp
from siltstone.llm import mixing, simhash
from siltstone.llm.common import n_staged, stage
from tests.llm.data import corpus, words
from tests.llm.test_exact import alnum, spans

TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = dict(corpus(n=120))
    texts.pop(None)
    rows = [(i, t) for i, t in texts.items()] + [(7, texts[7]), (None, None), (None, "null id")]
    rows += [(1000 + i, words(rng, 30) + (" idiot moron " if i % 3 == 0 else " ") + words(rng, 20)) for i in range(150)]
    bench = [(1, words(rng, 20)), (2, words(rng, 5)), (3, None)]
    rows += [(2000, words(rng, 10) + " " + bench[0][1]), (2001, bench[1][1]), (2002, words(rng, 900) + " " + bench[1][1])]
    rows += [(3000 + i, words(rng, 12) + f" mail me{i}@mail.example.com or +1 (456) 555-218{i} " + words(rng, 6)) for i in range(5)]
    base = words(rng, 3000).split()
    rows += [(4000 + j, " ".join([*base[: 37 * j], "z", *base[37 * j + 1 :]])) for j in range(4)]
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, int(i % 3 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, bench, str(folder)


def test_stages(spark, tables):
    docs, bench, folder = tables
    f = dict(cp.STAGES)
    key = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())

    calm = stage(f["toxicity"](spark, docs, folder))
    assert calm.columns == docs.columns
    assert key(calm) == sorted(k for k in key(docs) if not (1000 <= k[1] < 1150 and "idiot moron" in k[2]))

    one = stage(f["near_dedup"](spark, calm, folder))
    rows = [(r["doc_id"], r["text"]) for r in calm.collect()]
    prints = [simhash.fingerprint((t or "").encode()) % (1 << 64) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    best = defaultdict(list)
    for (i, _), r in zip(rows, root, strict=True):
        best[r].append(i)
    want = [min((i for i in v if i is not None), default=None) for v in best.values()]
    assert one.columns == docs.columns and sorted(r[1] for r in key(one)) == sorted(i or 0 for i in want)

    clean = stage(f["decontaminate"](spark, one, folder))
    windows = {tuple(w[s : s + 13]) for _, t in bench for w in [alnum(t)] if w for s in range(max(1, len(w) - 12))}
    kept = []
    for i, t in ((r["doc_id"], r["text"]) for r in one.collect()):
        w, hit = alnum(t), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                hit |= set(range(s, s + n)) if tuple(w[s : s + n]) in windows else set()
        if not (hit and 20 * len(hit) >= len(w)):
            kept.append((i is None, i or 0, t or ""))
    assert key(clean) == sorted(kept) and not {2000, 2001} & {k[1] for k in kept} and 2002 in {k[1] for k in kept}

    safe = stage(f["pii"](spark, clean, folder))
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert safe.columns == docs.columns and safe.count() == clean.count()
    for r in safe.collect():
        t = before[r["doc_id"]]
        if not spans(t):
            assert r["text"] == t
            continue
        at, out = 0, ""
        for k, a, b in (x.split(":") for x in spans(t).split(",")):
            if int(a) >= at:
                out += t[at : int(a)] + TAGS[k]
                at = int(b)
        # outside of the base spans only whole words may be replaced or go
        seen, given = (re.sub(r"\[(TERM|NAME|CODE|NUMBER)\]", "", x) for x in (r["text"], out + t[at:]))
        assert all(k in r["text"] for k in TAGS.values() if k in out) and not spans(r["text"])
        left = iter(re.findall(r"\w+", given))
        assert all(any(w == x for x in left) for w in re.findall(r"\w+", seen)), r["text"]

    out = f["mix"](spark, safe, folder)
    assert out.columns == [*docs.columns, "copies", "taken"]
    mixed = out.collect()
    given = {(r["doc_id"], r["text"], r["source"]) for r in safe.collect()}
    by = defaultdict(int)
    for r in mixed:
        assert (r["doc_id"], r["text"], r["source"]) in given and 1 <= r["copies"] <= 3
        assert r["taken"] == r["copies"] * len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        by[r["source"]] += r["taken"]
    want = {r["source"]: r["target"] for r in mixing.mix(safe).collect()}
    biggest = max(len((r["text"] or "").split()) for r in safe.collect())
    assert len(mixed) == len({(r["doc_id"], r["text"], r["source"]) for r in mixed}) and all(abs(by[s] - want[s]) <= biggest for s in want)


def test_run_and_empty(spark, tables):
    docs, _, folder = tables
    before = n_staged()
    found = cp.run(spark, folder)
    assert found.count() > 50 and {"copies", "taken", "text"} <= set(found.columns)
    assert n_staged() - before < 20  # the tables of the stages before are gone
    empty = docs.limit(0)
    for name, f in cp.STAGES:
        out = f(spark, empty, folder)
        assert out.columns == docs.columns + ["copies", "taken"] * (name == "mix") and out.count() == 0


def test_rows_that_share_ids_or_names_stay_whole(spark, tables):
    """Null and repeated ids with other texts, and clashing names: no document of its own is lost at any stage."""
    _, _, folder = tables
    rng = random.Random(4)
    texts = [(None, words(rng, 60)) for _ in range(4)] + [(5, words(rng, 60)) for _ in range(3)] + [(6, "½ ² ③"), (6, "½ ² ③"), (6, None)]
    odd = ["bad_id", "kept_id", "safe_key", "safe_text", "unit_id", "own_h", "k", "c", "y", "root", "fp"]
    docs = spark.createDataFrame([(i, t, "en", "s0", 1, *[1] * len(odd)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in odd))
    key = lambda df: sorted((r["doc_id"] or -1, r["text"] or "") for r in df.collect())
    once = sorted({(i or -1, t or "") for i, t in texts})
    f = dict(cp.STAGES)
    d = docs
    for name in ("toxicity", "near_dedup", "decontaminate", "pii"):
        d = stage(f[name](spark, d, folder))
        assert d.columns == docs.columns, name
        assert key(d) == (sorted((i or -1, t or "") for i, t in texts) if name == "toxicity" else once), name
    out = f["mix"](spark, d, folder)
    assert out.columns == [*docs.columns, "copies", "taken"] and out.agg({"taken": "sum"}).first()[0] == sum(len(t.split()) for _, t in once)
    again = mixing.take(docs)
    assert len(key(again)) == len(set(key(again))) and again.agg({"taken": "sum"}).first()[0] == sum(len((t or "").split()) for _, t in texts)
