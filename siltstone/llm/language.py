"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of order 3 with escape method C: in a context seen n times with q different next
bytes, a next byte seen c times has probability c / (n + q), and the escape to the next shorter context q / (n + q); the
last resort is 1/256 a byte. The trees are learnt from a bounded sample and frozen; a text's code length under each is
exact to double precision, and the shortest code wins. The nodes of all languages share one table with a row of log
probabilities each, so a byte costs one look-up for all languages unless it escapes.

Learning: at most `per_lang` labelled ids of a language, chosen by a hash of the id, one text each, learnt whole; so the
sample is bounded in texts for a language, whatever the size of the corpus, and no language goes unlearnt because its rows
repeat. Texts are judged whole, in pieces of bounded size.

Defined cases: a null text, or one without letters, is `und` with score 0; rows without a label are not learnt from;
rows with a null id are judged, but not learnt from; without any labelled row all texts are `und`; ties go to the smaller
language name; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import sample_texts
from siltstone.llm.lookup import Rows, pieces

ORDER = 3
PIECE = 1 << 19
_LETTER = regex.compile(r"\p{L}")  # what the learning side takes for a letter, too


def _grams(text: np.ndarray, k: int) -> np.ndarray:
    """Codes of the k-byte strings that end at each byte from ORDER on."""
    code = np.zeros(len(text) - ORDER, dtype=np.uint64)
    for i in range(k):
        code = (code << np.uint64(8)) | text[ORDER - k + 1 + i : len(text) - k + 1 + i].astype(np.uint64)
    return code


class Trees:
    """The context trees of all languages. sample: language to texts."""

    def __init__(self, sample: dict[str, list[bytes]]):
        self.langs = sorted(sample)
        n_lang = len(self.langs)
        if not n_lang:
            return
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for lang in self.langs:
            own = [np.frombuffer(b" " * ORDER + t, dtype=np.uint8) for t in sample[lang]]
            counts.append([np.unique(np.concatenate([_grams(t, k) for t in own]), return_counts=True) for k in range(1, ORDER + 2)])
        self.rows: list[Rows] = []
        self.values: list[np.ndarray] = []
        self.contexts: list[Rows] = []
        self.escapes: list[np.ndarray] = []  # by rows of contexts
        for k in range(1, ORDER + 2):
            keys = np.unique(np.concatenate([c[k - 1][0] for c in counts]))
            low = np.uint64((1 << (8 * (k - 1))) - 1)
            short = self.rows[k - 2].find(keys & low) if k > 1 else None
            contexts = Rows(np.unique(np.concatenate([c[k - 1][0] >> np.uint64(8) for c in counts])))
            value = np.empty((len(keys), n_lang), dtype=np.float64)
            escape = np.zeros((len(contexts.keys), n_lang), dtype=np.float64)
            for j in range(n_lang):
                grams, n = counts[j][k - 1]
                ctx, start = np.unique(grams >> np.uint64(8), return_index=True)
                total = np.add.reduceat(n, start)
                kinds = np.diff(np.append(start, len(grams)))
                esc = np.log2(kinds / (total + kinds))
                escape[contexts.find(ctx), j] = esc
                below = self.values[k - 2][short, j] if k > 1 else np.full(len(keys), -8.0)
                ctx_of = np.searchsorted(ctx, keys >> np.uint64(8))
                has = (ctx_of < len(ctx)) & (ctx[np.minimum(ctx_of, len(ctx) - 1)] == keys >> np.uint64(8))
                v = below + np.where(has, esc[np.minimum(ctx_of, len(ctx) - 1)], 0)
                where = np.searchsorted(keys, grams)
                v[where] = np.log2(n / np.repeat(total + kinds, kinds))
                value[:, j] = v
            self.rows.append(Rows(keys))
            self.values.append(value)
            self.contexts.append(contexts)
            self.escapes.append(escape)

    def bits(self, text: np.ndarray) -> np.ndarray:
        """Log2 probabilities (byte, language) of the bytes from ORDER on."""
        full = _grams(text, ORDER + 1)
        at = self.rows[ORDER].find(full)
        out = self.values[ORDER][at]
        todo = np.flatnonzero(at < 0)
        if len(todo):
            out[todo] = 0
        for k in range(ORDER + 1, 0, -1):
            if not len(todo):
                break
            if k > 1:
                size = np.uint64((1 << (8 * k)) - 1)
                ctx = self.contexts[k - 1].find((full[todo] & size) >> np.uint64(8))
                seen = ctx >= 0
                out[todo[seen]] += self.escapes[k - 1][ctx[seen]]
                row = self.rows[k - 2].find(full[todo] & np.uint64((1 << (8 * (k - 1))) - 1))
                hit = row >= 0
                out[todo[hit]] += self.values[k - 2][row[hit]]
                todo = todo[~hit]
            else:
                out[todo] += self.escapes[0][0] - 8.0
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits (text, language)."""
        total = np.zeros((len(texts), len(self.langs)))
        for who, what in pieces(texts, PIECE, ORDER):
            joined = np.frombuffer(b"".join(what), dtype=np.uint8)
            size = np.array([len(p) for p in what])
            end = np.cumsum(size)
            bits = np.vstack([np.zeros((ORDER, len(self.langs)), np.float64), self.bits(joined)])
            for i in range(ORDER):
                bits[end - size + i] = 0  # the context
            np.subtract.at(total, who, np.add.reduceat(bits, end - size, axis=0, dtype=np.float64))
        return total

    def best(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability (equal priors) of each text."""
        known = np.array([bool(t and self.langs and _LETTER.search(t)) for t in texts], dtype=bool)
        if not known.any():
            return ["und"] * len(texts), np.zeros(len(texts))
        bits = self.lengths([t.encode() if k else b"" for t, k in zip(texts, known, strict=True)])
        at = bits.argmin(axis=1)
        score = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
        return [self.langs[a] if k else "und" for a, k in zip(at, known, strict=True)], np.where(known, score, 0.0)


def sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 300) -> dict[str, list[bytes]]:
    """The bounded learning sample: of each language per_lang ids by a hash, one whole text an id."""
    text = F.col(text_col)
    rows = docs.where(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(F.col(lang_col).alias("label"), F.col(id_col).alias("i"), text.alias("t"))
    return {lang: [t.encode() for t in texts] for lang, texts in sample_texts(rows, per_lang).items()}


def identify(docs: DataFrame, trees: Trees, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = trees.best(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, lang_pred string, score double")
