"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models, of toxic and of ordinary labelled texts, of words after their predecessor:

- p(w | v, c) = max(n_c(v, w) - d, 0) / n_c(v) + left_c(v) b_c(w | v), where n_c counts the different words before the pair
  in class c. What rare expressions back off to is shared: b_c(w | v) = max(n(v, w) - d, 0) / n(v) l_c(w) + left(v) p(w | c)
  over its sum, with the counts n of both classes, leant by l_c(w) = p(w | c) / mean p(w) to the class's words.
- p(w | c) = (max(n_c(w) - d, 0) + d t_c p(begin | c) s(w | begin)) / n_c, where n_c(w) counts the different words before w.
- p(begin | c), of a word's first five bytes, is discounted alike from the number of words with this beginning, down to a
  shared distribution; there and in s, a word or a beginning counts once for each class that has it, and one more stands for
  the unknown. So what either class has seen rarely speaks for neither.

Pairs that both classes together have seen less than `least` times leave their mass to the backoff. All of it sums to 1.

The evidence is the difference of the two log-likelihoods divided by the number of words, over the whole text, and the
same over its most toxic passage of `passage` words, as a few toxic words in a long text drown in chance differences. A
logistic curve of both, fitted on a part of the sample that is set apart, gives the score. Words of unknown beginnings are
left out of the likelihoods.

Learning: at most `per_class` labelled ids of each class, chosen by a hash of the id, one text each, learnt whole; so the
sample is bounded in texts whatever the size of the corpus. A fifth of the sample is set apart for the curve. Texts are
scored whole, a batch of them in a task's memory.

Defined cases: null and empty texts carry no evidence and get the score of an even text; rows without a label are not
learnt from; without labelled rows of both classes all scores are 0; repeated rows are judged alike and learnt once an id;
of equally toxic words the score is the same whichever is meant; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import sample_texts
from siltstone.llm.lookup import Rows

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BEGIN = 5
SLICE = 1 << 18


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


class Classes:
    """The two models and the curve. toxic, ordinary: texts of the sample; prior: share of toxic labels.

    For (toxic, ordinary): single, log p(w | c) of the known words; begin, the same of an unknown word of a known beginning;
    back, what a context adds to the log probability of a word that is no kept pair with it; own, log p(w | v, c) of the pairs.
    """

    def __init__(self, toxic: list[str], ordinary: list[str], prior: float = 0.5, *, discount: float = 0.75, least: int = 2, passage: int = 1):
        self.passage, self.ready = passage, bool(toxic and ordinary)
        if not self.ready:
            return
        fit = [[t for i, t in enumerate(x) if i % 5 or len(x) < 5] for x in (toxic, ordinary)]
        rest = [[t for i, t in enumerate(x) if i % 5 == 0] for x in (toxic, ordinary)]
        self.vocabulary: dict[bytes, int] = {b"": 0}  # stands for texts without words
        number = self.vocabulary.setdefault
        ids = [[np.array([number(w, len(self.vocabulary)) for w in words_of(t)], dtype=np.uint64) for t in x] for x in fit]
        v = len(self.vocabulary)
        self.v = np.uint64(v)
        self.starts = {x: i for i, x in enumerate(sorted({w[:BEGIN] for w in self.vocabulary}))}
        start_of = np.array([self.starts[w[:BEGIN]] for w in self.vocabulary], dtype=np.int64)
        # Kneser-Ney counts: how many different words stand before a word, or before a pair; copies of a text add nothing
        twos = [_distinct([np.append(np.uint64(0), a[:-1]) * self.v + a for a in x]) for x in ids]
        threes = [_distinct([(np.append(np.uint64(0), a[:-2]) * self.v + a[:-1]) * self.v + a[1:] for a in x if len(a) > 1]) for x in ids]
        n = np.array([np.bincount((x % self.v).astype(np.int64), minlength=v) for x in twos], dtype=float)
        kinds = [np.bincount(start_of, x > 0, minlength=len(self.starts)) for x in n]
        # shared counts: a word, or a beginning, counts once for each class that has it; one more stands for the unknown
        has = np.maximum((n > 0).sum(axis=0), 1)
        of_start = np.bincount(start_of, has, minlength=len(self.starts)) + 1
        begin_has = np.maximum((np.array(kinds) > 0).sum(axis=0), 1)
        begin = np.array([_discounted(k, discount, begin_has / (begin_has.sum() + 1)) for k in kinds])
        p = np.array([_discounted(n[c], discount, begin[c][start_of] * has / of_start[start_of]) for c in (0, 1)])
        left = [discount * np.count_nonzero(x) / x.sum() if x.sum() else 1.0 for x in n]
        self.begin = np.log(np.array([begin[c] * left[c] / of_start for c in (0, 1)])).astype(np.float32)
        self.single = np.log(p).astype(np.float32)
        lean = p / p.mean(axis=0)
        # pairs: the shared counts of both classes, leant to a class's words, are what its own counts back off to
        counted = [np.unique(x % (self.v * self.v), return_counts=True) for x in threes]
        every, place = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
        m = np.zeros((2, len(every)))
        m[0, place[: len(counted[0][0])]], m[1, place[len(counted[0][0]) :]] = counted[0][1], counted[1][1]
        context = (every // self.v).astype(np.int64)
        kept = m.sum(axis=0) >= least  # the others leave their mass to the backoff
        keys = every[kept]
        self.rows = Rows(keys)
        v_of, w_of = context[kept], (keys % self.v).astype(np.int64)

        def mass(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Discounted shares of the kept pairs in their contexts, and what each context leaves."""
            total = np.bincount(context, x, minlength=v)
            own = np.maximum(x[kept] - discount, 0) / np.maximum(total[v_of], 1)
            return own, np.where(total > 0, 1 - np.bincount(v_of, own, minlength=v), 1.0)

        both, both_left = mass(m.sum(axis=0))
        self.back, self.own = np.empty((2, v), np.float32), np.empty((2, len(keys)), np.float32)
        for c in (0, 1):
            leant = both * lean[c][w_of]
            norm = np.bincount(v_of, leant, minlength=v) + both_left
            own, own_left = mass(m[c])
            self.back[c] = np.log(own_left * both_left / norm)
            self.own[c] = np.log(own + own_left[v_of] * (leant + both_left[v_of] * p[c][w_of]) / norm[v_of])
        x = self.evidences([words_of(t) for c in rest for t in c])
        size = np.array([len(c) for c in rest])
        self.curve = _logistic(x, np.repeat([1.0, 0.0], size), np.repeat(np.array([prior, 1 - prior]) * size.sum() / np.maximum(size, 1), size))

    def likelihoods(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities (class, word) of the documents' words, one document after the other, and which words have one: those
        of a known beginning. A word after an unknown one is taken without context; a text's first follows the empty word."""
        get, begins = self.vocabulary.get, self.starts.get
        flat = [w for d in docs for w in d]
        ids = np.array([get(w, -1) for w in flat], dtype=np.int64)
        n = np.array([len(d) for d in docs], dtype=np.int64)
        known = ids >= 0
        out = np.where(known, self.single[:, ids], 0).astype(float)
        heard = known.copy()
        for i in np.flatnonzero(~known):
            b = begins(flat[i][:BEGIN])
            if b is not None:
                out[:, i], heard[i] = self.begin[:, b], True
        prev = np.concatenate([np.zeros(min(1, len(ids)), np.int64), ids[:-1]])
        prev[(np.cumsum(n) - n)[n > 0]] = 0
        pair = np.flatnonzero((prev >= 0) & heard)
        at = np.full(len(pair), -1, np.int64)
        full = known[pair]
        at[full] = self.rows.find(prev[pair[full]].astype(np.uint64) * self.v + ids[pair[full]].astype(np.uint64))
        out[:, pair] = np.where(at >= 0, self.own[:, at] if self.own.shape[1] else 0, self.back[:, prev[pair]] + out[:, pair])
        return out, heard

    def evidences(self, docs: list[list[bytes]]) -> np.ndarray:
        """(document, 2): the difference of the log-likelihoods a word, over the whole text and over its most toxic passage."""
        n = np.array([len(d) for d in docs], dtype=np.int64)
        out = np.zeros((len(docs), 2))
        if not n.sum():
            return out
        p, heard = self.likelihoods(docs)
        odds = p[0] - p[1]
        starts, some = np.cumsum(n) - n, n > 0
        run = np.concatenate([[0.0], np.cumsum(odds)])
        said = np.add.reduceat(heard.astype(np.int64), starts[some])
        out[some, 0] = np.add.reduceat(odds, starts[some]) / np.maximum(said, 1)
        at = np.arange(len(odds))
        ahead = np.minimum(at + self.passage, np.repeat(starts + n, n))  # shorter at the end of a text
        out[some, 1] = np.maximum.reduceat((run[ahead] - run[at]) / self.passage, starts[some])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.ready:
            return np.zeros(len(texts))
        out, held, size = [], [], 0
        for t in texts:
            held.append(words_of(t))
            size += len(held[-1])
            if size > SLICE:
                out.append(self.evidences(held))
                held, size = [], 0
        out.append(self.evidences(held))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out) @ self.curve[:-1] + self.curve[-1], -50, 50)))


def _discounted(counts: np.ndarray, discount: float, below: np.ndarray) -> np.ndarray:
    """Interpolated absolute discounting of the counts with the distribution below."""
    total = counts.sum()
    return (np.maximum(counts - discount, 0) + discount * np.count_nonzero(counts) * below) / total if total else below


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Slopes, which are not negative, and offset, by Newton steps with a small ridge."""
    use = list(range(x.shape[1]))
    while True:
        z = np.concatenate([x[:, use], np.ones((len(x), 1))], axis=1)
        c = np.zeros(z.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ c, -50, 50)))
            g = z.T @ (w * (y - p)) - ridge * c
            h = (z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(c))
            step = np.linalg.solve(h, g)
            c = c + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        bad = [u for u, k in zip(use, c, strict=False) if k < 0]
        if not bad:
            out = np.zeros(x.shape[1] + 1)
            out[use], out[-1] = c[:-1], c[-1]
            return out
        use = [u for u in use if u not in bad]


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2000) -> tuple[list[str], list[str], float]:
    """The bounded learning sample: texts of toxic and of ordinary labelled rows, and the share of toxic labels.

    Of each class per_class ids by a hash, one whole text an id; an id labelled both ways is in both.
    """
    marks = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("m"), F.col(label_col).cast("int").alias("label")).distinct()
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    ids = rows.select("i").join(marks, F.col("i") == F.col("m")).select("label", "i")  # only ids go through the shuffle
    texts = sample_texts(rows, per_class, ids)
    share = marks.agg(F.avg("label")).first()[0]
    return texts.get(1, []), texts.get(0, []), float(min(0.99, max(0.01, share))) if share is not None else 0.5


def score(docs: DataFrame, classes: Classes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(classes.scores(b.column(1).to_pylist()))], ["doc_id", "score"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, score double")


def keep_ordinary(docs: DataFrame, classes: Classes, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without those that score threshold or more, all columns kept."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(classes.scores(b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
