"""Language-model scores from an Elias-Fano n-gram trie.

The trie of order n (3 unless given) has a level of words, in order of their hash, and levels of successors below: of each
word, of each pair, and so on. Child ranges are monotone pointers, and the successors of a level, taken as the number of
their context and the hash of their word, are one monotone sequence; both are Elias-Fano coded, and the smoothed
probabilities and backoff weights are quantised to a byte. Levels are written to a file and read back memory-mapped (it has
no name and ends with the task); an n-gram is searched word by word, each within the child range of its context, by its
high bits. The trie is cut into buckets by the hash of the first word, so no machine holds all of it, and each chunk of texts
sends a bucket only its distinct n-grams. The n-grams of a frequent word are cut into parts by their second word, and its
totals are added up from the parts, so that they meet in no single bucket.

Probabilities: interpolated absolute discounting, p(w | h) = max(c(hw) - d, 0) / c(h) + d t(h) / c(h) p(w | h'), h' being h
without its first word, down to the add-one unigrams p(w) = (c(w) + 1) / (N + V + 1); an unseen context leaves p(w | h').
Contexts begin at the text's start at the earliest.

Words are known by 64 bits of their hash; a successor by 32 bits within a word's successors and by 24 within those of a
longer context, so two of n successors of one context are taken for one with a probability of n * n / 2 ** 33 or 2 ** 25:
some 0.1 pairs among 30 000 successors of a word, and some 0.03 among 1000 of a pair. Their counts add up then.

Defined cases: null and empty texts are one end token; null ids count as the empty text when folds are drawn; repeated
rows count as often as they occur; without training rows all counts are 0; a text is never cut, it and its chunk are in
one task's memory; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.chunks import CHUNK, Chunk, answer, buckets_for, expand, expand_longs, meet, pack, send, squeeze, squeeze_longs

DISCOUNT, ORDER = 0.75, 3
BINS = 255
#: Bytes of a word that are hashed eight at a time; longer words are hashed one by one.
WIDE = 64
_M = np.uint64(0x9FB21C651E98DF25)
#: Hashes that stand for a text's end and beginning.
END, BEGIN = np.uint64(0x5EED0000000000E1), np.uint64(0x5EED0000000000B2)
#: Bytes of a successor's hash: below a word, below longer contexts.
NEAR, DEEP = 4, 3


class Packed:
    """An Elias-Fano coded monotone sequence below `top`."""

    def __init__(self, values: np.ndarray, top: int):
        n = len(values)
        self.n, self.low_bits = n, max(0, int(np.floor(np.log2(max(1, top) / max(1, n)))))
        low = values & np.uint64((1 << self.low_bits) - 1)
        self.low = [((low >> np.uint64(8 * i)) & np.uint64(255)).astype(np.uint8) for i in range((self.low_bits + 7) // 8)]
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        bits = np.zeros(n + (int(top) >> self.low_bits) + 2, np.uint8)
        bits[high + np.arange(n)] = 1
        self.size, self.high = len(bits), np.packbits(bits)

    def planes(self) -> list[np.ndarray]:
        return [self.high, *self.low]

    def open(self, planes: list[np.ndarray]) -> Packed:
        """Reads from now on from these (mapped) planes; the directory of high parts comes from their bits."""
        self.high, self.low = planes[0], planes[1:]
        zeros = np.flatnonzero(np.unpackbits(self.high, count=self.size) == 0)
        self.starts = np.concatenate([[0], zeros - np.arange(len(zeros))])
        return self

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for i, plane in enumerate(self.low):
            out |= plane[at].astype(np.uint64) << np.uint64(8 * i)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self.starts, at, side="right") - 1
        return high.astype(np.uint64) << np.uint64(self.low_bits) | self._low(at)

    def decoded(self) -> np.ndarray:
        """All values in order."""
        at = np.arange(self.n)
        ones = np.flatnonzero(np.unpackbits(self.high, count=self.size))
        return (ones - at).astype(np.uint64) << np.uint64(self.low_bits) | self._low(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of the values, -1 for others."""
        out = np.full(len(values), -1, np.int64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        ok = high + 1 < len(self.starts)
        at, end = self.starts[np.where(ok, high, 0)], np.where(ok, self.starts[np.where(ok, high + 1, 0)], 0)
        low = values & np.uint64((1 << self.low_bits) - 1)
        # values of one high part are sorted by their low bits: halve the range, as frequent contexts make long ones
        todo = np.flatnonzero(at < end)
        while len(todo):
            mid = (at[todo] + end[todo]) // 2
            less = self._low(mid) < low[todo]
            at[todo] = np.where(less, mid + 1, at[todo])
            end[todo] = np.where(less, end[todo], mid)
            todo = todo[at[todo] < end[todo]]
        there = np.flatnonzero(at < np.where(ok, self.starts[np.where(ok, high + 1, 0)], 0))
        there = there[self._low(at[there]) == low[there]]
        out[there] = at[there]
        return out


def _codebook(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale (logarithm of the least value, step) and codes (from 1) of positive x, quantised evenly in the logarithm."""
    if not len(x):
        return np.array([-np.inf, 0.0]), np.zeros(0, np.uint8)
    lo, hi = np.log(x.min()), np.log(x.max())
    step = max(hi - lo, 1e-9) / (BINS - 1)
    return np.array([lo, step]), (np.rint((np.log(x) - lo) / step) + 1).astype(np.uint8)


def _book(scale: np.ndarray) -> np.ndarray:
    """The values of the codes from 1 on; without any, zeros."""
    return np.exp(scale[0] + scale[1] * np.arange(BINS))


def _keys(context: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    return context.astype(np.uint64) << np.uint64(8 * size) | word


class Trie:
    """A bucket of the trie: hashes of words, and levels of successors (context, word hash, count), sorted by both.

    Contexts of the first level are numbers of words, those of a deeper level numbers of the successors above.
    """

    def __init__(self, words: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.sizes = [NEAR, *[DEEP] * (len(levels) - 1)]
        self.words = Packed(words, 1 << 64)
        self.pointers, self.successors, self.scales, codes = [], [], [], []
        above = len(words)
        for (context, word, count), size in zip(levels, self.sizes, strict=True):
            n, total = np.bincount(context, minlength=above), np.bincount(context, count, minlength=above)
            self.pointers.append(Packed(np.concatenate([[0], np.cumsum(n)]).astype(np.uint64), len(context) + 1))
            self.successors.append(Packed(_keys(context, word, size), max(1, above) << (8 * size)))
            scale, prob = _codebook((count - DISCOUNT) / total[context])
            back_scale, back = _codebook(np.where(total > 0, DISCOUNT * n / np.maximum(total, 1), 1.0))
            self.scales += [scale, back_scale]
            codes += [prob, back]
            above = len(context)
        parts = [self.words, *self.pointers, *self.successors]
        planes = [x for p in parts for x in p.planes()] + codes
        with tempfile.TemporaryFile() as file:
            for x in planes:
                x.tofile(file)
            file.flush()
            mapped = np.memmap(file, np.uint8, "r") if sum(len(x) for x in planes) else np.zeros(0, np.uint8)
        at, views = 0, []
        for x in planes:
            views.append(mapped[at : at + len(x)])
            at += len(x)
        for p in parts:
            n = len(p.planes())
            p.open(views[:n])
            views = views[n:]
        self.prob, self.back = views[::2], views[1::2]
        self.has_children = [np.diff(p.decoded()) > 0 for p in self.pointers]

    def word(self, hashes: np.ndarray) -> np.ndarray:
        return self.words.find(hashes)

    def search(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of successors on a level, -1 where the context (its place above) or the pair is unseen."""
        out = np.full(len(word), -1, np.int64)
        known = np.flatnonzero(context >= 0)
        full = known[self.has_children[level][context[known]]]
        out[full] = self.successors[level].find(_keys(context[full], word[full], self.sizes[level]))
        return out

    def probabilities(self, level: int, place: np.ndarray) -> np.ndarray:
        """Codes of p(w | h) from the n-gram's own count, 0 where it is unseen."""
        return _codes(self.prob[level], place)

    def weights(self, level: int, context: np.ndarray) -> np.ndarray:
        """Codes of the backoff weights of contexts by their place above the level, 0 (a weight of 1) where they are unseen."""
        return _codes(self.back[level], context)


def _codes(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    out = np.zeros(len(place), np.uint8)
    known = place >= 0
    out[known] = codes[place[known]]
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    return h ^ (h >> np.uint64(29))


def _words(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of a chunk's words, A-Z lower-cased. Words of up to WIDE bytes are hashed side by side."""
    raw = c.raw.lower()
    text = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(text) + 2, bool)
    inside[1:-1] = (text != 32) & ((text < 9) | (text > 13))
    edge = np.zeros(len(text) + 1, bool)  # between texts
    edge[c.ends] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    size = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1 - start
    doc = np.searchsorted(c.ends, start, side="right")
    out = np.empty(len(start), np.uint64)
    padded = np.concatenate([text, np.zeros(WIDE, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, 8)
    short = size <= WIDE
    for at in range(0, len(start), 1 << 16):
        s, n = start[at : at + (1 << 16)], size[at : at + (1 << 16)]
        h = n.astype(np.uint64) * _M
        for k in range(0, min(WIDE, int(n.max(initial=0))), 8):
            left = np.flatnonzero(n > k)
            part = rows[s[left] + k].copy().view("<u8").ravel()
            drop = np.maximum(8 - (n[left] - k), 0).astype(np.uint64) * np.uint64(8)
            h[left] = _mix(h[left] ^ ((part << drop) >> drop))
        out[at : at + (1 << 16)] = h
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + size[i]])
    return _mix(out), doc


class Splits:
    """Frequent words and the number of parts that their successors are dealt to, by the hash of the successor."""

    def __init__(self, parts: dict[int, int] | None = None):
        self.words = np.array(sorted(parts or {}), np.uint64)
        self.parts = np.array([(parts or {})[w] for w in self.words.tolist()], np.uint64)

    def root(self, words: np.ndarray, after: np.ndarray) -> np.ndarray:
        """What an n-gram's bucket goes by: the first word, or for a frequent one its part, whose first is the word itself."""
        if not len(self.words):
            return words
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        some = np.flatnonzero(self.words[at] == words)
        out = words.copy()
        out[some] = self._key(words[some], _mix(after[some]) % self.parts[at[some]])
        return out

    @staticmethod
    def _key(words: np.ndarray, part: np.ndarray) -> np.ndarray:
        return np.where(part == 0, words, _mix(words + part * _M))

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        """(root, place of its word) of all parts."""
        word = np.repeat(np.arange(len(self.words)), self.parts.astype(np.int64))
        part = np.arange(len(word)) - np.searchsorted(word, word)
        return self._key(self.words[word], part.astype(np.uint64)), word


def _hashes(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, tokens of each text, first token of each text)."""
    word, doc = _words(c)
    sizes = np.bincount(doc, minlength=len(c.sizes)) + 1
    tokens = np.full(len(word) + len(c.sizes), END, np.uint64)
    tokens[np.arange(len(word)) + doc] = word  # each text's end token comes after its words
    return tokens, sizes, np.cumsum(sizes) - sizes


class Tokens:
    """The tokens of a chunk's texts, and its distinct words and n-grams by the bucket of their root (see Splits).

    roots are the words' own and those of frequent words' parts, in the order of the buckets; main is a word's own root. On
    level k (of order - 1), gram is the number of the n-gram of k + 2 words that ends at each token, -1 where the text
    begins later; above and right are the distinct n-grams' contexts (numbers above, roots on the first) and last words.
    """

    def __init__(self, c: Chunk, n_buckets: int, trained: Callable[[list[int | None]], np.ndarray], order: int = ORDER, splits: Splits | None = None):
        tokens, self.sizes, self.starts = _hashes(c)
        self.word, self.token = np.unique(tokens, return_inverse=True)
        before = np.concatenate([np.zeros(1, np.uint64), tokens[:-1]])[: len(tokens)]
        before[self.starts] = BEGIN
        root = (splits or Splits()).root(before, tokens)
        self.roots, number = np.unique(np.concatenate([self.word, root]), return_inverse=True)
        self.main, last = number[: len(self.word)], number[len(self.word) :]
        self.bucket = ((self.roots >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
        learn = np.repeat(trained(c.id_list()), self.sizes)
        self.counts = [np.bincount(self.main[self.token], learn, minlength=len(self.roots)).astype(np.uint32)]
        self.gram, self.above, self.right, self.cuts = [], [], [], [np.searchsorted(self.bucket, np.arange(n_buckets + 1))]
        v = np.uint64(len(self.word))
        for _ in range(order - 1):
            some = np.flatnonzero(last >= 0)
            keys, number = np.unique(last[some].astype(np.uint64) * v + self.token[some].astype(np.uint64), return_inverse=True)
            gram = np.full(len(self.token), -1, np.int64)
            gram[some] = number
            above = (keys // v).astype(np.int64)
            self.gram.append(gram)
            self.above.append(above)
            self.right.append((keys % v).astype(np.int64))
            self.counts.append(np.bincount(number, learn[some], minlength=len(keys)).astype(np.uint32))
            self.cuts.append(np.searchsorted(above, self.cuts[-1]))
            last = np.concatenate([[-1], gram[:-1]])
            last[self.starts] = -1

    def ask(self) -> Iterator[tuple[int, str, bytes]]:
        for b in np.unique(self.bucket).tolist():
            ends = [c[b : b + 2] for c in self.cuts]
            roots = squeeze_longs(self.roots[ends[0][0] : ends[0][1]].view(np.int64))  # sorted, so that they share their first bytes
            plain, packed = [len(roots).to_bytes(4, "little"), roots], [self.counts[0][ends[0][0] : ends[0][1]].tobytes()]
            for k, (above, right) in enumerate(zip(self.above, self.right, strict=True)):
                (p, q), (at, to) = ends[k + 1], ends[k]
                word = (self.word[right[p:q]] >> np.uint64(64 - 8 * (NEAR if k == 0 else DEEP))).astype("<u4")
                plain.append(word.view(np.uint8).reshape(-1, 4)[:, : NEAR if k == 0 else DEEP].tobytes())
                packed += [np.bincount(above[p:q] - at, minlength=to - at).astype(np.uint32).tobytes(), self.counts[k + 1][p:q].tobytes()]
            sizes = np.array([q - p for p, q in ends], "<u4").tobytes()
            yield b, "grams", sizes + b"".join(plain) + squeeze(b"".join(packed))


class _Asked:
    """A message of Tokens.ask: the roots' hashes, and for each level the number of successors of each context, hashes and counts."""

    def __init__(self, raw: bytes, order: int):
        n = np.frombuffer(raw, "<u4", order).astype(np.int64).tolist()
        at = 4 * order
        size = int.from_bytes(raw[at : at + 4], "little")
        self.hash = expand_longs(raw[at + 4 : at + 4 + size]).view(np.uint64)
        at += 4 + size
        self.words = []
        for k, size in enumerate(n[1:]):
            wide = NEAR if k == 0 else DEEP
            rows = np.zeros((size, 4), np.uint8)
            rows[:, :wide] = np.frombuffer(raw, np.uint8, wide * size, at).reshape(-1, wide)
            self.words.append(rows.view("<u4").ravel())
            at += wide * size
        packed = np.frombuffer(expand(raw[at:]), np.uint32)
        cuts = np.cumsum([n[0], *[x for k in range(order - 1) for x in (n[k], n[k + 1])]])
        parts = np.split(packed, cuts[:-1])
        self.counts, self.children = [parts[0], *parts[2::2]], parts[1::2]


def _bucket_of(order: int, splits: Splits | None = None) -> Callable[[list[bytes]], tuple[list[bytes], str]]:
    """What a bucket does with its messages. An answer has totals, sizes, the scales of the code books (which would be most of it, as
    answers number buckets times chunks), counts of the words, of the parts of frequent words what the training rows have (root,
    pairs, different pairs), and codes; totals and parts are in its first answer."""
    parts = np.sort(splits.roots()[0]) if splits is not None else np.zeros(0, np.uint64)

    def run(payloads: list[bytes]) -> tuple[list[bytes], str]:
        asked = [_Asked(p, order) for p in payloads]
        words, number = np.unique(np.concatenate([a.hash for a in asked]), return_inverse=True)
        unigram = np.bincount(number, np.concatenate([a.counts[0] for a in asked]), minlength=len(words)).astype(np.int64)
        # distinct n-grams level by level; those of the training rows make the trie, on whose places the deeper ones stand
        levels, own, place, distinct, numbers = [], number, np.arange(len(words)), [], []
        for k in range(order - 1):
            context = np.repeat(own, np.concatenate([a.children[k] for a in asked]))
            keys, own = np.unique(_keys(context, np.concatenate([a.words[k] for a in asked]), NEAR if k == 0 else DEEP), return_inverse=True)
            own = own.astype(np.uint32)
            del context
            count = np.bincount(own, np.concatenate([a.counts[k + 1] for a in asked]), minlength=len(keys))
            seen = count > 0
            bits = np.uint64(8 * (NEAR if k == 0 else DEEP))
            levels.append((place[(keys[seen] >> bits).astype(np.int64)], keys[seen] & ((np.uint64(1) << bits) - np.uint64(1)), count[seen]))
            distinct.append((keys >> bits, keys & ((np.uint64(1) << bits) - np.uint64(1))))
            numbers.append(own)
            place = np.where(seen, np.cumsum(seen) - 1, -1)  # a seen n-gram's context is seen, too
        trie = Trie(words, levels)
        context, _, count = levels[0]
        split = np.flatnonzero(np.isin(words, parts))
        side = np.stack([words[split], np.bincount(context, count, minlength=len(words))[split].astype(np.uint64), np.bincount(context, minlength=len(words))[split].astype(np.uint64)], axis=1).tobytes()
        totals = np.array([unigram.sum(), (unigram > 0).sum()], np.int64).tobytes()
        scales = b"".join(x.tobytes() for x in trie.scales)
        # each distinct n-gram is searched once, below the place of its context
        found, codes = trie.word(words), []
        weights = _codes(trie.back[0], found)[number]
        for k in range(order - 1):
            context, word = distinct[k]
            found = trie.search(k, found[context.astype(np.int64)], word)
            codes.append((weights, trie.probabilities(k, found)[numbers[k]]))
            weights = trie.weights(k + 1, found)[numbers[k]] if k + 1 < order - 1 else weights
        out, at = [], [0] * order
        for i, a in enumerate(asked):
            to = [x + n for x, n in zip(at, [len(a.hash), *map(len, a.words)], strict=True)]
            mine = squeeze_longs(unigram[number[at[0] : to[0]]])
            plain = b"".join(w[at[k] : to[k]].tobytes() + p[at[k + 1] : to[k + 1]].tobytes() for k, (w, p) in enumerate(codes))
            own = side if i == 0 else b""
            out.append((totals if i == 0 else bytes(16)) + len(mine).to_bytes(4, "little") + len(own).to_bytes(4, "little") + scales + own + mine + squeeze(plain))
            at = to
        return out, "grams"

    return run


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, n, kinds) of the parts of frequent words, from answers (payload, deep)."""
    for b in batches:
        rows = [np.zeros((0, 3), np.uint64)]
        for raw, deep in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            size = int.from_bytes(raw[20:24], "little")
            if size:
                rows.append(np.frombuffer(raw, np.uint64, size // 8, 24 + 32 * deep).reshape(-1, 3))
        all_ = np.concatenate(rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(all_[:, i]) for i in range(3)], ["root", "n", "kinds"])


class Parts:
    """What the parts of frequent words have of their word: the share of its training pairs, and the word's backoff weight."""

    def __init__(self, splits: Splits, rows: list[tuple[int, int, int]]):
        roots, word = splits.roots()
        order = np.argsort(roots)
        self.roots, word = roots[order], word[order]
        n, kinds = np.zeros(len(roots)), np.zeros(len(roots))
        if rows:
            told = np.array(rows, np.int64)
            at = np.searchsorted(self.roots, np.ascontiguousarray(told[:, 0]).view(np.uint64))
            n[at], kinds[at] = told[:, 1], told[:, 2]
        total = np.bincount(word, n, minlength=len(splits.words))
        every = np.bincount(word, kinds, minlength=len(splits.words))
        self.share = n / np.maximum(total[word], 1)
        self.back = np.where(total[word] > 0, DISCOUNT * every[word] / np.maximum(total[word], 1), 1.0)

    def find(self, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the roots are parts, their places)."""
        if not len(self.roots):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.roots, roots), len(self.roots) - 1)
        some = np.flatnonzero(self.roots[at] == roots)
        return some, at[some]


def _scores(t: Tokens, c: Chunk, got: dict[tuple[str, int], bytes], n_all: int, n_kinds: int, parts: Parts | None = None) -> pa.Table:
    deep = len(t.gram)
    count = np.zeros(len(t.roots), np.int64)
    back = [np.ones(len(t.roots)), *[np.ones(len(x)) for x in t.above[:-1]]]
    prob = [np.zeros(len(x)) for x in t.above]
    for b in np.unique(t.bucket).tolist():
        raw = got["grams", b]
        size, at = int.from_bytes(raw[16:20], "little"), 24 + 32 * deep + int.from_bytes(raw[20:24], "little")
        scales = np.frombuffer(raw, np.float64, 4 * deep, 24).reshape(deep, 2, 2)
        codes = np.frombuffer(expand(raw[at + size :]), np.uint8)
        ends = [x[b : b + 2] for x in t.cuts]
        count[ends[0][0] : ends[0][1]] = expand_longs(raw[at : at + size])
        used = 0
        for k in range(deep):
            (at, to), (p, q) = ends[k], ends[k + 1]
            back[k][at:to] = np.concatenate([[1.0], _book(scales[k, 1])])[codes[used : used + to - at]]
            prob[k][p:q] = np.concatenate([[0.0], _book(scales[k, 0])])[codes[used + to - at : used + to - at + q - p]]
            used += to - at + q - p
    if parts is not None:  # a part's probabilities are of its own pairs: of the word's they are its share
        some, at = parts.find(t.roots)
        share = np.ones(len(t.roots))
        share[some], back[0][some] = parts.share[at], parts.back[at]
        prob[0] *= share[t.above[0]]
    seen = count[t.main][t.token]
    single = (seen + 1) / (n_all + n_kinds + 1)
    full = single
    for k in range(deep):
        some = np.flatnonzero(t.gram[k] >= 0)
        g = t.gram[k][some]
        full = full.copy()
        full[some] = prob[k][g] + back[k][t.above[k][g]] * full[some]
    add = lambda x: np.add.reduceat(x, t.starts) if len(t.starts) else np.zeros(0)
    return pa.table({
        "doc_id": pa.array(c.id_list(), pa.int64()), "n_tokens": t.sizes, "n_known": add((seen > 0).astype(np.int64)),
        "train_tokens": np.full(len(t.sizes), n_all, np.int64), "base_score": add(np.log10(single)), "score": add(np.log10(full)),
    })


def frequent(chunks: DataFrame, n_buckets: int, most: int = 32) -> Splits:
    """Words that are more than two buckets' share of the tokens, by a sample of `most` chunks spread over the table.

    The sample only chooses how n-grams are dealt; whatever it misses stays in one bucket. It brings no more words to the
    driver than there are buckets.
    """
    last = chunks.agg(F.max("chunk")).first()[0]
    if last is None:
        return Splits()
    step = max(1, ((last >> 32) + 1) // most)
    some = chunks.where(F.col("chunk").isin([p << 32 for p in range(0, (last >> 32) + 1, step)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                tokens, sizes, _ = _hashes(Chunk(row))
                word, n = np.unique(tokens, return_counts=True)
                n[word == END] = 0
                many = np.flatnonzero(n * 4 * n_buckets >= len(tokens))
                word = np.concatenate([word[many], [BEGIN, np.uint64(0)]])  # 0 stands for all
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.concatenate([n[many], [len(sizes), len(tokens)]]))], ["word", "n"])

    sums = some.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = sums.where("word = 0").select(F.col("n").alias("all"))
    share = F.col("n") / F.col("all") * n_buckets
    rows = sums.where("word <> 0").crossJoin(F.broadcast(total)).select("word", share.alias("share")).where("share >= 2").collect()  # one row of totals
    return Splits({r[0] % (1 << 64): int(r[1]) + 1 for r in rows})


def score(docs: DataFrame, trained: Callable[[list[int | None]], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score); trained says of each id whether to learn from it."""
    if order < 2:
        raise ValueError(f"order must be 2 or more, got {order}")
    chunks = pack(docs, id_col=id_col, text_col=text_col)
    n = buckets_for(chunks, size=CHUNK)  # deep levels weigh more than the text: half of the usual share a bucket
    splits = frequent(chunks, n)
    told = answer(send(chunks, lambda c: Tokens(c, n, trained, order, splits).ask()), _bucket_of(order, splits), n)
    # the first 16 bytes of an answer: little-endian totals, in one answer of each bucket
    number = lambda at: F.expr("+".join(f"conv(hex(substring(payload, {at + i + 1}, 1)), 16, 10) * {1 << 8 * i}L" for i in range(7))).cast("long")
    total = told.select(number(0).alias("n"), number(8).alias("v")).agg(F.sum("n"), F.sum("v")).first()
    n_all, n_kinds = int(total[0] or 0), int(total[1] or 0)
    rows = told.where(F.expr("substring(payload, 21, 4) <> X'00000000'")).select("payload", F.lit(order - 1).alias("deep")).mapInArrow(_parts_of, "root long, n long, kinds long")
    parts = Parts(splits, [tuple(r) for r in rows.collect()] if len(splits.words) else [])  # a row a part
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return meet(chunks, told, lambda c, got: _scores(Tokens(c, n, trained, order, splits), c, got, n_all, n_kinds, parts), schema, n)
