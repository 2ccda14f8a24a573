"""Alignment of two tokenizers over the same texts, and corpus-wide counts of their linked tokens.

Both tokenizers cut the bytes of a text. A label stands for each byte: `.` (no token ends after it), `a` (one of A), `b`
(one of B) or `#` (one of each). A regular expression scans the labels up to each `#`; such a span is a group, and its
labels count the tokens that it has of either side. Tokens are linked where their byte ranges overlap: between two labels
there is one link.

A space after anything but white space always begins a token of both (A's pretokenizer cuts there, B has no piece that
holds a space after another character), so texts are cut there into chunks, and a worker labels each distinct chunk once.
Tokenizers for which this is not certain, and texts of which a chunk does not give its bytes back, are labelled whole.

Workers write blocks: of some 16 MB of texts the chunk numbers of each text, each chunk's links, and the block's distinct
linked pairs with totals. Totals are added up over blocks, joined back to the blocks' pairs, and meet the blocks' chunks
there; so no link of a text is a row of its own, and what a pair in all texts weighs is a row a block.

Defined cases: texts that are null or empty, or whose tokens of A or B do not give back the bytes of a space and the text,
have no tokens: zeros, and an empty digest; repeated rows and ids keep a row each and count each; pairs with the same count
are all the best of their B token; texts are taken whole, each as one value of one task; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.chunks import NO_ID, expand, squeeze
from siltstone.llm.common import stage

BLOCK, SLICE, CACHED, JOINED = 16 << 20, 256, 400_000, 128
#: Characters that some tokenizer might take for white space, beside those that Python does.
ODD = "\u0085\u180e\u200b\ufeff"
#: A character that is surely no white space, and after it a space that is not the text's last character.
CUT = re.compile(f"(?<=[^\\s{ODD}])(?= [\\s\\S])")
#: What no text has in which every space is such a place, beside a space at either end.
WHITE = frozenset(c for c in map(chr, range(0x110000)) if c.isspace() or c in ODD)
PAIRS = [f"{c} " for c in sorted(WHITE)]
SPAN = re.compile(rb"[^#]*#")
BINARY = ("ids", "null_ids", "digests", "numbers", "n_chunks", "chunks", "n_links", "links")
BLOCKS = "block long, " + ", ".join(f"{c} binary" for c in BINARY) + ", pairs array<long>, totals array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_of() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for: printable Latin-1 itself, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """A byte-level BPE (tokenizers, JSON) and a piece model (sentencepiece) from their files' contents."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.loads(a)
        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        own, byte = {t["id"]: t["content"] for t in spec["added_tokens"]}, _byte_of()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [t.encode() if i in own else bytes(byte[c] for c in t) for i, t in enumerate(names)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        # an id's name before another of its side, and as the last of it
        self.names = [f"{i}{mark}" for n, marks in ((len(names), ",|"), (len(pieces), ",;")) for i in range(n) for mark in marks]
        self.name_size = np.array([len(n) for n in self.names], np.int64)
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or spec["normalizer"] is not None:
            raise ValueError("A has to be a byte-level BPE without a normalizer")
        inner = any("▁" in p.lstrip("▁") for p in pieces)
        self.cuts = bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and not inner and self.b.encode("x  y") == [*self.b.encode("x"), *self.b.encode(" y")]

    def encode_a(self, texts: list[str], plain: int, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A for a space and each text, one after the other, and how many each has. The first `plain` texts do not end in white space."""
        joined = [" " + " ".join(texts[i : min(i + JOINED, plain)]) for i in range(0, plain, JOINED)]
        ids = [e.ids for e in self.a.encode_batch_fast([*joined, *[" " + t for t in texts[plain:]]], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), np.int64)
        ends, want = np.cumsum(self.a_size[flat]), np.cumsum(n_bytes)
        at = np.searchsorted(ends, want)
        if len(flat) and at[-1] == len(flat) - 1 and (ends[at] == want).all():
            return flat, np.diff(at, prepend=-1)
        ids = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int64), np.array([len(x) for x in ids], np.int64)

    def encode_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of B, which adds the space itself."""
        ids = self.b.encode(texts, num_threads=1)
        return np.fromiter(chain.from_iterable(ids), np.int64), np.array([len(x) for x in ids], np.int64)


def _fits(raw: list[bytes], ids: np.ndarray, n: np.ndarray, size: np.ndarray, token: list[bytes]) -> np.ndarray:
    """Which texts the tokens give back."""
    own = b"".join([token[i] for i in ids.tolist()])
    ends = np.concatenate([[0], np.cumsum(size[ids])])[np.cumsum(n)]
    if (np.diff(ends, prepend=0) == [len(r) for r in raw]).all() and own == b"".join(raw):
        return np.ones(len(raw), bool)
    return np.array([own[s:e] == r for s, e, r in zip([0, *ends.tolist()], ends.tolist(), raw, strict=False)], bool)


class Spans(dict):
    """A number for each span of labels; how many tokens of A and of B end in it, by that number."""

    def __init__(self) -> None:
        self.n_a: list[int] = []
        self.n_b: list[int] = []

    def __missing__(self, span: bytes) -> int:
        self[span] = number = len(self.n_a)
        self.n_a.append(span.count(b"a") + 1)
        self.n_b.append(span.count(b"b") + 1)
        return number


class Labels:
    """What the labels of each distinct text say, by number: tokens, groups as text, links as pairs (A id << 32 | B id)."""

    def __init__(self, tokenizers: Tokenizers):
        self.tok = tokenizers
        self.spans = Spans()
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str | None] = []  # None: the tokens do not give back the bytes
        self.counts: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []
        self.odd = False

    def learn(self, texts: list[str]) -> None:
        """Label texts that are not known yet (not empty, each once)."""
        t = self.tok
        plain = [x for x in texts if t.cuts and x[-1] not in WHITE]
        texts = [*plain, *[x for x in texts if not t.cuts or x[-1] in WHITE]]
        raw = [b" " + x.encode() for x in texts]
        n_bytes = np.fromiter(map(len, raw), np.int64, len(raw))
        (ids_a, len_a), (ids_b, len_b) = t.encode_a(texts, len(plain), n_bytes), t.encode_b(texts)
        fit = _fits(raw, ids_a, len_a, t.a_size, t.a_bytes) & _fits(raw, ids_b, len_b, t.b_size, t.b_bytes)
        if not fit.all():
            ids_a, ids_b, len_a, len_b = ids_a[np.repeat(fit, len_a)], ids_b[np.repeat(fit, len_b)], len_a * fit, len_b * fit
        label = np.zeros(int(t.a_size[ids_a].sum()), np.uint8)
        label[np.cumsum(t.a_size[ids_a]) - 1] |= 1
        label[np.cumsum(t.b_size[ids_b]) - 1] |= 2
        found = SPAN.findall(np.frombuffer(b".ab#", np.uint8)[label].tobytes())
        spans = np.fromiter(map(self.spans.__getitem__, found), np.int64, len(found))
        n_a, n_b = np.array(self.spans.n_a, np.int64)[spans], np.array(self.spans.n_b, np.int64)[spans]
        # between two labels lies one link; how many tokens of either ended before tells which
        kind = label[np.flatnonzero(label)]
        pair = ids_a[np.cumsum(kind & 1) - (kind & 1)] << 32 | ids_b[np.cumsum(kind >> 1) - (kind >> 1)]
        # a group's names: those of A, then those of B; the last of either carries the mark that follows
        place = np.arange(len(n_a))
        at_a = np.arange(len(ids_a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)
        at_b = np.arange(len(ids_b)) + np.repeat(np.cumsum(n_a), n_b)
        name = np.empty(len(ids_a) + len(ids_b), np.int64)
        name[at_a], name[at_b] = 2 * ids_a, 2 * (ids_b + len(t.a_bytes))
        name[at_a[np.cumsum(n_a) - 1]] += 1
        name[at_b[np.cumsum(n_b) - 1]] += 1
        written = "".join([t.names[i] for i in name.tolist()])
        wide = np.concatenate([[0], np.cumsum(t.name_size[name])])
        # the texts' groups end where their tokens do
        ends_a = np.cumsum(len_a)
        n_groups = np.diff(np.concatenate([place, [len(n_a)]])[np.searchsorted(np.concatenate([[0], np.cumsum(n_a)]), ends_a)], prepend=0)
        cut = wide[ends_a + np.cumsum(len_b)].tolist()
        first = len(self.groups)
        self.number.update(zip(texts, range(first, first + len(texts)), strict=True))
        self.groups += [written[s : e - 1] if ok else None for s, e, ok in zip([0, *cut], cut, fit.tolist(), strict=False)]
        self.counts.append(np.stack([len_a, len_b, n_groups, len_a + len_b - n_groups], axis=1))
        self.pairs.append(pair)
        self.odd |= not fit.all()

    def number_of(self, texts: list[str]) -> list[list[int]]:
        """For each text (not empty) the numbers of its chunks; none if its tokens do not give back its bytes."""
        cut = self.tok.cuts
        parts = [[t] if not cut else t.split(" ") if t[0] != " " != t[-1] and not any(p in t for p in PAIRS) else [p[1:] for p in CUT.split(" " + t)] for t in texts]
        self._meet(set().union(*parts))
        number = self.number.__getitem__
        out = [list(map(number, x)) for x in parts]
        odd = [i for i, x in enumerate(out) if any(self.groups[j] is None for j in x)] if self.odd else []
        self._meet({texts[i] for i in odd})
        for i in odd:
            j = self.number[texts[i]]
            out[i] = [] if self.groups[j] is None else [j]
        return out

    def _meet(self, texts: set[str]) -> None:
        new = [t for t in texts if t not in self.number]
        if new:
            self.learn(new)

    def render(self, numbers: list[int]) -> str:
        """The groups of a text as `a1,a2|b1;a3|b2,b3`."""
        return ";".join([self.groups[i] for i in numbers])  # type: ignore[misc]


def _block(number: int, ids: list, digests: list[bytes], numbers: list[list[int]], labels: Labels) -> pa.RecordBatch:
    sizes = np.array([len(x) for x in numbers], np.int64)
    stream = np.array([j for x in numbers for j in x], np.int64)
    counts = np.concatenate([np.zeros((0, 4), np.int64), *labels.counts])
    every = np.concatenate([np.zeros(0, np.int64), *labels.pairs])
    own, local = np.unique(stream, return_inverse=True)
    width, begin = counts[own, 3], (np.cumsum(counts[:, 3]) - counts[:, 3])[own]
    at = np.repeat(begin - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
    pairs, link = np.unique(every[at], return_inverse=True)
    weight = np.repeat(np.bincount(local, minlength=len(own)), width)
    totals = np.zeros(len(pairs), np.int64)
    np.add.at(totals, link, weight)
    ends = np.cumsum(sizes)
    summed = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts[stream], axis=0)])
    binary = [
        np.array([NO_ID if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], bool), np.frombuffer(b"".join(digests), np.uint8), (summed[ends] - summed[ends - sizes]).ravel(),
        sizes.astype(np.int32), local.astype(np.int32), width.astype(np.int32), link.astype(np.int32),
    ]
    cols = [pa.array([number], pa.int64()), *[pa.array([squeeze(x.tobytes())], pa.binary()) for x in binary], pa.array([pairs], pa.list_(pa.int64())), pa.array([totals], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, ["block", *BINARY, "pairs", "totals"])


def blocks(docs: DataFrame, a: bytes, b: bytes, *, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """The staged blocks of `size` bytes of texts each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, part, number, held = Labels(Tokenizers(a, b)), TaskContext.get().partitionId(), 0, 0
        ids: list = []
        digests: list[bytes] = []
        numbers: list[list[int]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                few = batch.slice(at, SLICE)
                texts = few.column(1).to_pylist()
                found = iter(labels.number_of([t for t in texts if t]))
                rows = [next(found) if t else [] for t in texts]
                ids += few.column(0).to_pylist()
                numbers += rows
                digests += [hashlib.sha256(labels.render(r).encode()).digest() if r else bytes(32) for r in rows]
                held += sum(map(len, filter(None, texts)))
                if held >= size:
                    yield _block((part << 32) + number, ids, digests, numbers, labels)
                    ids, digests, numbers, held, number = [], [], [], 0, number + 1
                    if len(labels.groups) > CACHED:
                        labels.clear()
        if ids:
            yield _block((part << 32) + number, ids, digests, numbers, labels)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage(d.mapInArrow(run, BLOCKS), codec="uncompressed")


def pair_counts(packed: DataFrame) -> DataFrame:
    """(pair, count, best), staged: how many links of all texts hold the pair, and whether no other pair of its B id has more."""
    summed = packed.select(F.inline(F.arrays_zip("pairs", "totals"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("totals").alias("count"))
    of_b = W.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return stage(summed.withColumn("best", F.col("count") == F.max("count").over(of_b)))


def _joined(left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows of the documents of a block, from its row and the counts of its pairs."""
    order = np.argsort(right.column("pair").to_numpy())
    score = np.stack([right.column("best").to_numpy(zero_copy_only=False).astype(np.int64), right.column("count").to_numpy()], axis=1)[order]
    tables = []
    for i in range(left.num_rows):
        raw = {c: expand(left.column(c)[i].as_py()) for c in BINARY}
        ids, null = np.frombuffer(raw["ids"], np.int64), np.frombuffer(raw["null_ids"], bool)
        numbers = np.frombuffer(raw["numbers"], np.int64).reshape(-1, 4)
        sizes, stream, width, link = (np.frombuffer(raw[c], np.int32).astype(np.int64) for c in ("n_chunks", "chunks", "n_links", "links"))

        def sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
            all_of, end = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(values, axis=0)]), np.cumsum(n)
            return all_of[end] - all_of[end - n]

        got = sums(sums(score[link], width)[stream], sizes)
        digest = [raw["digests"][32 * j : 32 * j + 32].hex() if n else "" for j, n in enumerate(sizes.tolist())]
        cols = [pa.array(ids, pa.int64(), mask=null), *[pa.array(numbers[:, j]) for j in range(4)], pa.array(got[:, 0]), pa.array(got[:, 1]), pa.array(digest, pa.string())]
        tables.append(pa.table(cols, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
    return pa.concat_tables(tables)


def align(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """For every row the numbers of tokens, groups and links, of links of a B id's most frequent pair, the sum of its links' counts, and the groups' digest."""
    packed = blocks(docs, Path(path_a).read_bytes(), Path(path_b).read_bytes(), id_col=id_col, text_col=text_col, size=size)
    counts = pair_counts(packed).withColumnRenamed("pair", "p")
    found = packed.select("block", F.explode("pairs").alias("pair")).join(counts, F.col("pair") == F.col("p")).select("block", "pair", "count", "best")
    return packed.select(F.col("block").alias("of"), *BINARY).groupBy("of").cogroup(found.groupBy("block")).applyInArrow(_joined, RESULT)


def groups(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups) for every row: each group's ids of A and of B, in order; no groups without tokens."""
    a, b = Path(path_a).read_bytes(), Path(path_b).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = Labels(Tokenizers(a, b))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                few = batch.slice(at, SLICE)
                texts = few.column(1).to_pylist()
                found = iter(labels.number_of([t for t in texts if t]))
                named = [labels.render(next(found)) if t else "" for t in texts]
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(named, pa.string())], ["doc_id", "groups"])
                if len(labels.groups) > CACHED:
                    labels.clear()

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    g = d.mapInArrow(run, "doc_id long, groups string").where(F.lit(True))
    ids = lambda x: F.transform(F.filter(F.split(x, ","), lambda i: i != ""), lambda i: i.cast("int"))
    one = lambda x: F.struct(ids(F.split_part(x, F.lit("|"), F.lit(1))).alias("a"), ids(F.split_part(x, F.lit("|"), F.lit(2))).alias("b"))
    return g.select("doc_id", F.transform(F.filter(F.split("groups", ";"), lambda x: x != ""), one).alias("groups"))
