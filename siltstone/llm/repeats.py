"""Removal of repeated 50-byte strings by prefix-free parsing and suffix order.

A rolling hash over 24 bytes sets triggers: in each 50-byte string the position with the smallest hash, the first of
equals, is its trigger, so equal strings have equal triggers at equal offsets. The triggers cut a text into phrases; a
phrase is the stretch of starts with one trigger, with the 49 bytes that follow, so that phrases overlap as in
prefix-free parsing and every 50-byte string lies whole in the phrase of its trigger.

1. Chunks tell buckets their distinct triggers; a trigger of one document only cannot be in a repeat and is dropped.
2. Chunks tell buckets the distinct phrases of the others, with the smallest document. A bucket's dictionary is the
   set of distinct phrases. A 50-byte string is its trigger with some bytes before and the rest after it, so two sorts
   order all of them: of what precedes the triggers, read backwards, and of what follows them. The common prefixes of
   neighbours in these orders give each phrase's rank at every depth, and strings of equal ranks on both sides are one
   string, whose smallest document goes back to every phrase.
3. The parse maps the answers back: a start whose string has a smaller document covers 50 bytes, which are removed.

The orders compare bytes, so the result is exact. Highly repetitive text costs what its distinct phrases cost. A trigger
with very many different phrases (a common line with ever different neighbours) is hot: its phrases are cut into their
50-byte strings, and these go to buckets by their own hash.

Defined cases: null texts are empty; null ids come after all others; equal ids are no smaller than each other, so repeated
rows of one id keep theirs; texts under 50 bytes stay; a text is never cut, it and its chunk are in one task's memory; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.chunks import Chunk, answer, buckets_for, expand, expand_longs, meet, pack, send, squeeze, squeeze_longs

LENGTH, GRAM = 50, 24
REACH = LENGTH - GRAM + 1
SIDE = LENGTH - GRAM
#: Starts that are hashed together: the arrays stay in the processor's cache, and a place fits beside 17 bits of hash.
SLICE = 1 << 14
WIDE = 80  # a phrase has at most LENGTH + REACH - 1 bytes
#: A trigger is hot once this many different phrases, counted chunk by chunk, have it.
HOT = 1 << 16
NONE = np.iinfo(np.int64).max
_M = np.uint64(0xD1342543DE82EF95)
_R = 0x2C1B3C6D
_POW = [np.uint32(pow(_R, 1 << i, 1 << 32)) for i in range(5)]
_TABLE = np.frombuffer(hashlib.shake_256(b"phrases").digest(1024), dtype=np.uint32)


def _rows(text: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """size bytes of the text from each place on, zeros beyond its end."""
    padded = np.concatenate([text, np.zeros(size, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, size)[at]


def _mix(rows: np.ndarray, start: int = 0) -> np.ndarray:
    """A 64-bit hash of rows whose width is a multiple of 8."""
    words = np.ascontiguousarray(rows).view("<u8")
    mixed = np.full(len(rows), start, np.uint64)
    for i in range(words.shape[1]):
        mixed = (mixed ^ words[:, i]) * _M
        mixed ^= mixed >> np.uint64(31)
    return mixed


def triggers(text: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first, last) of every phrase: positions of the trigger and of its first and last start."""
    n = len(text) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    whole = np.ones(len(text) + LENGTH, bool)  # starts whose string lies in one document
    tail = np.minimum(sizes, LENGTH - 1)
    for back in range(1, LENGTH):
        whole[ends[tail >= back] - back] = False
    trigger = np.empty(n, np.int64)
    place = np.arange(SLICE + LENGTH, dtype=np.uint32)
    for at in range(0, n, SLICE):
        h1 = _TABLE[text[at : at + SLICE + LENGTH - 1]]
        h2 = h1[:-1] * _POW[0] + h1[1:]
        h4 = h2[:-2] * _POW[1] + h2[2:]
        h8 = h4[:-4] * _POW[2] + h4[4:]
        h16 = h8[:-8] * _POW[3] + h8[8:]
        m = len(h1) - GRAM + 1
        h = h16[:m] * _POW[3] + h8[16 : 16 + m]
        h ^= h >> np.uint32(15)
        h *= np.uint32(_R | 1)
        key = (h & np.uint32(0xFFFF8000)) | place[:m]  # ties: the first
        for step in (1, 2, 4, 8):
            key = np.minimum(key[:-step], key[step:])
        last = m - REACH + 1
        key = np.minimum(key[:last], key[REACH - 16 : REACH - 16 + last])
        trigger[at : at + last] = (key & np.uint32(0x7FFF)).astype(np.int64) + at
    whole = whole[:n]
    new = whole.copy()
    new[1:] &= (trigger[1:] != trigger[:-1]) | ~whole[:-1]
    end = whole.copy()
    end[:-1] &= new[1:] | ~whole[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(end)
    return trigger[first], first, last


def _bucket(code: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets in the order of the codes."""
    return ((code >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


class Parse:
    """The phrases of a chunk, and its distinct triggers by bucket."""

    def __init__(self, c: Chunk, n_buckets: int):
        self.text, self.n_buckets = np.frombuffer(c.raw, np.uint8), n_buckets
        self.trigger, self.first, self.last = triggers(self.text, c.ends, c.sizes)
        self.doc = np.searchsorted(c.ends, self.first, side="right")
        code = _mix(_rows(self.text, self.trigger, GRAM))
        order = np.argsort(code)
        k, own = code[order], c.ids[self.doc[order]]
        new = np.concatenate([np.ones(min(1, len(k)), bool), k[1:] != k[:-1]])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        self.kind = np.empty(len(k), np.int64)  # of each phrase: number of its trigger among the distinct ones
        self.kind[order] = group
        self.key = k[start]
        self.bucket = _bucket(self.key, n_buckets)
        other = np.concatenate([np.zeros(min(1, len(k)), bool), (own[1:] != own[:-1]) & ~new[1:]])
        self.several = np.logical_or.reduceat(other, start) if len(k) else other
        # different phrases of a trigger, as their first and last bytes tell them apart
        self.forms = np.diff(np.append(start, len(k)))
        among = np.flatnonzero(self.forms[group] > 1)
        w = order[among]
        edge = _mix(np.concatenate([_rows(self.text, self.first[w], 8), _rows(self.text, self.last[w] + LENGTH - 8, 8)], axis=1)) ^ (self.last[w] - self.first[w]).astype(np.uint64)
        by = np.lexsort((edge, group[among]))
        g, e = group[among][by], edge[by]
        fresh = np.concatenate([np.ones(min(1, len(g)), bool), (g[1:] != g[:-1]) | (e[1:] != e[:-1])])
        self.forms[self.forms > 1] = 0
        np.add.at(self.forms, g[fresh], 1)
        self.cuts = np.searchsorted(self.bucket, np.arange(n_buckets + 1))

    def ask(self) -> Iterator[tuple[int, str, bytes]]:
        for b in np.unique(self.bucket).tolist():
            at, to = self.cuts[b : b + 2]
            k, power = self.key[at:to], np.log2(self.forms[at:to]).astype(np.uint8)
            low, high = k.astype(np.uint32), (k >> np.uint64(32)).astype(np.uint16)
            yield b, "trigger", len(k).to_bytes(4, "little") + low.tobytes() + high.tobytes() + squeeze(self.several[at:to].astype(np.uint8).tobytes() + power.tobytes())

    def shared(self, got: dict[tuple[str, int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which phrases have a trigger that several documents have, and which of these triggers are hot."""
        said = np.zeros(len(self.key), np.uint8)
        for b in np.unique(self.bucket).tolist():
            at, to = self.cuts[b : b + 2]
            said[at:to] = np.frombuffer(expand(got["trigger", b]), np.uint8)
        of = said[self.kind]
        which = np.flatnonzero(of)
        return which, of[which] == 2


class Phrases:
    """The distinct phrases among those of shared triggers, by bucket; phrases of hot triggers as their strings."""

    def __init__(self, p: Parse, c: Chunk, which: np.ndarray, hot: np.ndarray):
        cold, warm = which[~hot], which[hot]
        n = p.last[warm] - p.first[warm] + 1
        start = np.repeat(p.first[warm], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of = np.concatenate([cold, np.repeat(warm, n)])
        self.first = np.concatenate([p.first[cold], start])
        size = np.concatenate([p.last[cold] - p.first[cold] + LENGTH, np.full(len(start), LENGTH)]).astype(np.uint8)
        lead = (p.trigger[of] - self.first).astype(np.uint8)
        self.own = c.ids[p.doc[of]]
        rows = _rows(p.text, self.first, WIDE)
        rows = np.where(np.arange(WIDE) < size[:, None], rows, np.uint8(0))
        rows[:, WIDE - 1], rows[:, WIDE - 2] = size, lead
        mixed = _mix(rows)
        bucket = p.bucket[p.kind[of]]
        bucket[len(cold) :] = _bucket(mixed[len(cold) :], p.n_buckets)
        order = np.argsort(mixed)
        order = order[np.argsort(bucket[order], kind="stable")]
        r, b = rows[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (r[1:] != r[:-1]).any(axis=1)
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        pick = order[begin]
        self.rows, self.size, self.lead, self.bucket = rows[pick], size[pick], lead[pick], bucket[pick]
        self.least = np.minimum.reduceat(self.own[order], begin) if len(begin) else self.own

    def ask(self) -> Iterator[tuple[int, str, bytes]]:
        for b in np.unique(self.bucket).tolist():
            at, to = np.searchsorted(self.bucket, [b, b + 1])
            size = self.size[at:to]
            text = self.rows[at:to][np.arange(WIDE) < size[:, None]]
            least = squeeze_longs(self.least[at:to])
            yield b, "phrase", len(size).to_bytes(4, "little") + len(least).to_bytes(4, "little") + least + squeeze(size.tobytes() + self.lead[at:to].tobytes() + text.tobytes())


def _triggers_of_bucket(payloads: list[bytes]) -> tuple[list[bytes], str]:
    keys, several, forms = [], [], []
    for p in payloads:
        n = int.from_bytes(p[:4], "little")
        keys.append(np.frombuffer(p, np.uint32, n, 4).astype(np.uint64) | np.frombuffer(p, np.uint16, n, 4 + 4 * n).astype(np.uint64) << np.uint64(32))
        rest = np.frombuffer(expand(p[4 + 6 * n :]), np.uint8)
        several.append(rest[:n])
        forms.append(np.int64(1) << rest[n:].astype(np.int64))
    flat = np.concatenate(keys)
    order = np.argsort(flat)
    k = flat[order]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), k[1:] != k[:-1]]))
    n = np.diff(np.append(start, len(k)))
    shared = (n > 1) | (np.maximum.reduceat(np.concatenate(several)[order], start) > 0)
    hot = np.add.reduceat(np.concatenate(forms)[order], start) >= HOT
    out = np.empty(len(k), np.uint8)
    out[order] = np.repeat(np.where(shared, np.where(hot, 2, 1), 0), n)
    ends = np.cumsum([len(x) for x in keys])
    return [squeeze(out[e - len(x) : e].tobytes()) for x, e in zip(keys, ends, strict=True)], "trigger"


def _side_order(rows: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by `within` and then by their bytes, and the common prefix of each with the one before in that
    order (-1 where `within` changes)."""
    words = np.zeros((len(rows), (rows.shape[1] + 7) // 8 * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort((*(words[:, i] for i in range(words.shape[1] - 1, -1, -1)), within))
    r, w = rows[order], within[order]
    differ = np.ones((len(rows), rows.shape[1] + 1), bool)
    differ[1:, :-1] = r[1:] != r[:-1]
    prefix = differ.argmax(axis=1)
    prefix[1:][w[1:] != w[:-1]] = -1
    prefix[:1] = -1
    return order, prefix


def string_ranks(rows: np.ndarray, size: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, rank) of every 50-byte string in the rows; equal strings of equal triggers have equal ranks.

    lead: the trigger's place in its row. Ranks follow the trigger, its depth in the string, and the orders of both sides.
    """
    n = len(rows)
    size, lead = size.astype(np.int64), lead.astype(np.int64)
    wide = np.zeros((n, SIDE + WIDE + SIDE), np.uint8)
    wide[:, SIDE : SIDE + WIDE] = np.where(np.arange(WIDE) < size[:, None], rows, np.uint8(0))
    at = np.arange(n)[:, None]
    gram = wide[at, SIDE + lead[:, None] + np.arange(GRAM)]
    left = wide[at, SIDE + lead[:, None] - 1 - np.arange(SIDE)]
    right = wide[at, SIDE + lead[:, None] + GRAM + np.arange(SIDE)]
    order, prefix = _side_order(gram, np.zeros(n, np.int64))
    trigger = np.empty(n, np.int64)
    trigger[order] = np.cumsum(prefix < GRAM) - 1
    orders = [_side_order(x, trigger) for x in (left, right)]
    after = size - lead - GRAM  # bytes that follow the trigger
    found, used = [], 0
    for depth in range(SIDE + 1):
        who = np.flatnonzero((lead >= depth) & (after >= SIDE - depth))
        code = np.zeros(n, np.uint64)
        for (o, prefix), deep in zip(orders, (depth, SIDE - depth), strict=True):
            rank = np.empty(n, np.uint64)
            rank[o] = np.cumsum(prefix < deep).astype(np.uint64)
            code = code << np.uint64(32) | rank
        kinds, rank = np.unique(code[who], return_inverse=True)
        found.append((who, lead[who] - depth, rank + used))
        used += len(kinds)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _phrases_of_bucket(payloads: list[bytes]) -> tuple[list[bytes], str]:
    sizes, leads, owners, texts = [], [], [], []
    for p in payloads:
        n, cut = int.from_bytes(p[:4], "little"), 8 + int.from_bytes(p[4:8], "little")
        owners.append(expand_longs(p[8:cut]))
        plain = np.frombuffer(expand(p[cut:]), np.uint8)
        sizes.append(plain[:n])
        leads.append(plain[n : 2 * n])
        texts.append(plain[2 * n :])
    size, own = np.concatenate(sizes), np.concatenate(owners)
    rows = np.zeros((len(size), WIDE), np.uint8)
    rows[np.arange(WIDE) < size[:, None]] = np.concatenate(texts)
    rows[:, WIDE - 1], rows[:, WIDE - 2] = size, np.concatenate(leads)
    # the dictionary: distinct phrases, each with its smallest document
    order = np.argsort(_mix(rows))
    r = rows[order]
    new = np.ones(len(order), bool)
    new[1:] = (r[1:] != r[:-1]).any(axis=1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    pick = order[begin]
    least = np.minimum.reduceat(own[order], begin) if len(begin) else own
    row, start, rank = string_ranks(rows[pick], size[pick], rows[pick, WIDE - 2])
    low = np.full(int(rank.max(initial=-1)) + 1, NONE)
    np.minimum.at(low, rank, least[row])
    answers = np.full((len(pick), REACH), NONE)
    answers[row, start] = low[rank]
    ends = np.cumsum([len(s) for s in sizes])
    out = []
    for s, e in zip(sizes, ends, strict=True):
        mine = number[e - len(s) : e]
        out.append(squeeze_longs(answers[mine][np.arange(REACH) <= (s.astype(np.int64) - LENGTH)[:, None]]))
    return out, "phrase"


def _result(p: Parse, c: Chunk, got: dict[tuple[str, int], bytes]) -> pa.Table:
    ph = Phrases(p, c, *p.shared(got))
    low = np.full((len(ph.size), REACH), NONE)
    span = ph.size.astype(np.int64) - LENGTH
    for b in np.unique(ph.bucket).tolist():
        at, to = np.searchsorted(ph.bucket, [b, b + 1])
        block = low[at:to]
        block[np.arange(REACH) <= span[at:to][:, None]] = expand_longs(got["phrase", b])
    cover = np.zeros(len(p.text) + 1, np.int32)
    for at in range(0, len(ph.number), 1 << 16):
        number, own, first = ph.number[at : at + (1 << 16)], ph.own[at : at + (1 << 16)], ph.first[at : at + (1 << 16)]
        i, s = np.nonzero(low[number] < own[:, None])
        start = first[i] + s
        cover[start] += 1  # a start is in one phrase only
        cover[start + LENGTH] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    removed, spans, digest = [], [], []
    at = 0
    for n in c.sizes.tolist():
        g = gone[at : at + n]
        hit = int(np.count_nonzero(g))
        removed.append(hit)
        spans.append(int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if hit else 0)
        digest.append(hashlib.sha256(p.text[at : at + n][~g].tobytes() if hit else c.raw[at : at + n]).hexdigest())
        at += n
    return pa.table({"doc_id": pa.array(c.id_list(), pa.int64()), "n_bytes": c.sizes, "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    chunks = pack(docs, id_col=id_col, text_col=text_col)
    n = buckets_for(chunks)
    told = answer(send(chunks, lambda c: Parse(c, n).ask()), _triggers_of_bucket, n)

    def phrases(c: Chunk, got: dict) -> pa.Table:
        p = Parse(c, n)
        asked = list(Phrases(p, c, *p.shared(got)).ask())
        return pa.table({"chunk": pa.array([c.number] * len(asked), pa.int64()), "bucket": pa.array([a[0] for a in asked], pa.int32()), "kind": pa.array([a[1] for a in asked], pa.string()), "payload": pa.array([a[2] for a in asked], pa.binary())})

    asked = meet(chunks, told, phrases, "chunk long, bucket int, kind string, payload binary", n)
    ranked = answer(asked, _phrases_of_bucket, n)
    return meet(chunks, told.union(ranked), lambda c, got: _result(Parse(c, n), c, got), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", n)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, unnest(generate_series(0, length(h) // 2 - 50)) AS p, h FROM d WHERE length(h) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS new FROM s JOIN f USING (s) WHERE first < doc_id),
i AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM c) GROUP BY doc_id, k),
r AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM i),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM r JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
