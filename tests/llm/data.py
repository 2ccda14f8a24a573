"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, h long, k string"


def documents(spark, texts, sources=("a", "b", None)):
    rows = [(i, t, "en" if t and "the" in t else None, sources[(i or 0) % len(sources)], 1, "x", 7, "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice(["the", "er", "on", "é", "TH", "qu", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    passages = [words(rng, 40) for _ in range(4)]
    out = []
    for i in range(n):
        t = words(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            t += p[a : a + rng.randint(20, 200)] + words(rng, 10)
        out.append((i, t))
    out += [(100, None), (101, ""), (102, " \t\n "), (103, out[3][1]), (104, out[3][1] + " more"), (105, "a" * 300), (106, "one two"), (7, out[7][1]), (7, out[7][1]), (None, out[5][1]), (None, None)]
    out += [(200, words(rng, 9000))]
    return out
