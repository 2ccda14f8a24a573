"""Maximal periodic runs of words, by the algorithm of Kolpakov and Kucherov.

A run is a stretch of words with smallest period q (words q apart are equal) and length >= max(least, exponent * q) that no
neighbouring word extends keeping the period. For each text:

1. A suffix automaton, whose states know where their strings first end, gives the Lempel-Ziv factors: each the longest
   stretch that also starts further left, or one new word.
2. Main's algorithm finds every run that touches a factor's boundary: on the left it needs two lengths of the factor before
   and one of the factor after; Z functions of both sides, forwards and backwards, give the extent of each period.
3. A run that touches no boundary lies within a factor and is copied from the factor's earlier occurrence, from left to right.

All three steps take time in proportion to the stretch. Before them, words that cannot be in a run are set aside: in a run
every word occurs `exponent` times at least (rounded down), so the words around a rarer one fall apart into stretches, which are counted
again a few times over. This leaves out no run, and most of an ordinary text needs no automaton.

Defined cases: a null or empty text, or one of white space only, has no words and no runs; repeated rows and ids keep a row
each; ties do not arise, as two runs differ in start, length or period; texts are taken whole, each as one value of one
task, which needs some 700 bytes for each word of a stretch; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"
ROUNDS, SLICE = 4, 256


def factors(x: Sequence) -> list[tuple[int, int, int]]:
    """(start, earlier start or -1, length) of the Lempel-Ziv factors of x, from its suffix automaton."""
    step: list[dict] = [{}]
    link, size, first = [-1], [0], [-1]  # first: where the state's strings end for the first time
    last = 0
    for i, c in enumerate(x):
        new, p = len(step), last
        step.append({})
        size.append(i + 1)
        first.append(i)
        link.append(0)
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] != size[p] + 1:
                copy = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                link[q] = copy
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                q = copy
            link[new] = q
        last = new
    out, i, n = [], 0, len(x)
    while i < n:
        state, end = 0, i
        while end < n and first[to := step[state][x[end]]] < end:
            state, end = to, end + 1
        out.append((i, first[state] - (end - i) + 1, end - i) if end > i else (i, -1, 1))
        i = max(end, i + 1)
    return out


def _z(s: list) -> list[int]:
    """How far s[i:] agrees with s."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if k:
            left, right = i, i + k
    return z


def _touching(x: list, before: int, at: int, end: int, wide: float, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs that touch `at` and end in [at, end]; `before` is the length of the factor before."""
    low = max(0, at - 2 * before - (end - at))
    t, v = x[low:at], x[at:end]
    nt, nv = len(t), len(v)
    # a mark that equals no word stands between the two; ahead[i]: how far x[low + i:] agrees with v
    ahead = _z([*v, None, *t, *v])[nv + 1 :] + [0]
    rt, rv = t[::-1], v[::-1]
    back = _z([*rt, None, *rv, *rt])[nt + 1 :] + [0]  # back[i]: how far the words before x[end - i] agree with those before x[at]
    for q in range(1, max(nt, nv) + 1):
        found = []
        if q <= nv:  # a period to the right of the boundary
            found.append((at - back[nv - q], at + q + ahead[nt + q]))
        if q <= nt:  # a period to the left of it
            found.append((at - q - back[nv + q], at + ahead[nt - q]))
        for s, e in found:
            if e - s < least or e - s < wide * q:
                continue
            if (s == 0 or x[s - 1] != x[s - 1 + q]) and (e == len(x) or x[e] != x[e - q]):  # else cut by the window: found elsewhere
                yield s, e, q


def runs_of(x: Sequence, exponent: float = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of x, by start, then period. exponent is 2 or more."""
    x = list(x)
    parts = factors(x)
    period: dict[tuple[int, int], int] = {}
    for k in range(1, len(parts) + 1):
        at = parts[k][0] if k < len(parts) else len(x)
        end = at + parts[k][2] if k < len(parts) else at
        for s, e, q in _touching(x, parts[k - 1][2], at, end, exponent, least):
            period[s, e] = min(q, period.get((s, e), q))  # multiples of a period have the same extent
    starts: dict[int, list[int]] = {}
    for s, e in sorted(period):
        starts.setdefault(s, []).append(e)
    for at, source, n in parts:
        if n < least + 2:
            continue
        by = at - source
        for s in range(at + 1, at + n - least):
            for e in starts.get(s - by, ()):
                if e + by < at + n and (s, e + by) not in period:
                    period[s, e + by] = period[s - by, e]
                    starts.setdefault(s, []).append(e + by)
    return sorted(((s, e - s, q) for (s, e), q in period.items()), key=lambda r: (r[0], r[2], r[1]))


def stretches(x: Sequence, exponent: float, least: int) -> Iterator[tuple[int, int]]:
    """[start, end) of the stretches in which every word occurs `exponent` times; outside of them there are no runs."""
    often = re.compile(rb"\x01{%d,}" % least)
    todo, times = [(0, len(x), 0)], int(exponent)  # a run of 2.5 periods may hold a word twice
    while todo:
        a, b, done = todo.pop()
        n = Counter(x[a:b])
        if min(n.values(), default=0) >= times or done == ROUNDS:
            if b - a >= least:
                yield a, b
            continue
        todo += [(a + m.start(), a + m.end(), done + 1) for m in often.finditer(bytes([n[w] >= times for w in x[a:b]]))]


def find_in(words: Sequence, exponent: float = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """runs_of(words), of the stretches that can hold any."""
    out = [(a + s, n, q) for a, b in stretches(words, exponent, least) for s, n, q in runs_of(words[a:b], exponent, least)]
    return sorted(out, key=lambda r: (r[0], r[2], r[1]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run has after its first period, joined by one space."""
    if runs:
        drop = bytearray(len(words))
        for s, n, q in runs:
            drop[s + q : s + n] = b"\1" * (n - q)
        words = [w for w, d in zip(words, drop, strict=True) if not d]
    return b" ".join(words)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", exponent: float = 4, least: int = 6) -> DataFrame:
    """(doc_id, n_words, runs, text) for every row: runs by start, then period; text without what repeats in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                few = b.slice(at, SLICE)
                n_words, found, kept = [], [], []
                for t in few.column(1).to_pylist():
                    words = (t or b"").split()  # ASCII white space
                    r = find_in(words, exponent, least)
                    n_words.append(len(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in r])
                    kept.append(collapse(words, r).decode())
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(n_words, pa.int64()), pa.array(found, pa.list_(one)), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "text"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return d.mapInArrow(run, SCHEMA)


def strongest(runs: Column) -> Column:
    """Of runs by start, then period: the first with the greatest length / period; null if there is none."""
    better = lambda a, r: r["length"] * a["period"] > a["length"] * r["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, r: F.when(better(a, r), r).otherwise(a))


def listed(runs: Column) -> Column:
    """`start,length,period` of each run and a line feed."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))))
