"""Texts packed into chunks, and exchanges between chunks and hash buckets.

A chunk is a row with some megabytes of texts, compressed. Operators that look at every position of a corpus send from
each chunk one message per bucket with its distinct keys, sorted; a bucket joins the messages of all chunks and answers
each in its own order. So a row of an exchange stands for thousands of keys, a key that fills a third of the corpus
comes once a chunk, and no group is larger than its bucket's share of distinct keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import stage

CHUNK = 4 << 20
#: Stands for a null id: after all others.
NO_ID = (1 << 63) - 1
_SCHEMA = pa.schema([("chunk", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.binary()), ("null_ids", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary())])
MESSAGE = "chunk long, bucket int, kind string, payload binary"
MESSAGE_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("kind", pa.string()), ("payload", pa.binary())])


def squeeze(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def expand(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def squeeze_longs(x: np.ndarray) -> bytes:
    """int64 values, of which neighbours are often equal or near: differences by byte planes, compressed."""
    return squeeze(np.ascontiguousarray(np.diff(x, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T).tobytes())


def expand_longs(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


class Chunk:
    """ids (int64), null_ids (bool), sizes (bytes of each text) and the texts one after the other."""

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.ids, self.null_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["null_ids"], bool)
        self.sizes, self.raw = np.frombuffer(row["sizes"], np.int64), expand(row["texts"])
        self.ends = np.cumsum(self.sizes)

    def texts(self) -> Iterator[bytes]:
        at = 0
        for n in self.sizes.tolist():
            yield self.raw[at : at + n]
            at += n

    def id_list(self) -> list[int | None]:
        return [None if n else i for i, n in zip(self.ids.tolist(), self.null_ids.tolist(), strict=True)]


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int | None = None) -> DataFrame:
    """The staged chunk table, `size` bytes a chunk (CHUNK). Null texts are empty; a text is never cut."""
    size = size or CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def out() -> pa.RecordBatch:
            null = np.array([i is None for i in ids], dtype=bool)
            own = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            row = [(part << 32) + number, held, own.tobytes(), null.tobytes(), sizes.tobytes(), squeeze(b"".join(texts), 3)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                few = b.slice(at, 256)
                for i, t in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
                    ids.append(i)
                    texts.append(t or b"")
                    held += len(texts[-1])
                    if held >= size:
                        yield out()
                        ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield out()

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return stage(d.mapInArrow(run, "chunk long, n_bytes long, ids binary, null_ids binary, sizes binary, texts binary"), codec="uncompressed")


def buckets_for(chunks: DataFrame, size: int | None = None) -> int:
    """Number of buckets: one for each `size` bytes of text (2 CHUNK)."""
    size = size or 2 * CHUNK
    return max(4, int((chunks.agg(F.sum("n_bytes")).first()[0] or 0) // size) + 1)


def message(rows: list[tuple[int, int, str, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, MESSAGE_ARROW, strict=True)], schema=MESSAGE_ARROW)


def send(chunks: DataFrame, f: Callable[[Chunk], Iterator[tuple[int, str, bytes]]]) -> DataFrame:
    """Messages (chunk, bucket, kind, payload) that f makes of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                yield message([(row["chunk"], *m) for m in f(Chunk(row))])

    return chunks.mapInArrow(run, MESSAGE)


def parts_for(n_buckets: int) -> int:
    """Tasks that buckets or chunks are dealt to: four of them a task, one after the other, as each task leaves a file."""
    return max(4, -(-n_buckets // 4))


def answer(messages: DataFrame, f: Callable[[list[bytes]], tuple[list[bytes], str]], n_buckets: int) -> DataFrame:
    """Each bucket's answers, staged: f gets the payloads of a bucket and gives an answer for each, and a kind."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        replies, kind = f(t.column("payload").to_pylist())
        return pa.table([t.column("chunk"), t.column("bucket"), pa.array([kind] * t.num_rows, pa.string()), pa.array(replies, pa.binary())], schema=MESSAGE_ARROW)

    dealt = messages.repartition(parts_for(n_buckets), "bucket")
    return stage(dealt.groupBy("bucket").applyInArrow(run, MESSAGE))


def meet(chunks: DataFrame, replies: DataFrame, f: Callable[[Chunk, dict[tuple[str, int], bytes]], pa.Table], schema: str, n_buckets: int) -> DataFrame:
    """f of each chunk with its answers by (kind, bucket)."""
    fields = replies.sparkSession.createDataFrame([], schema).schema

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = {(k, b): p for k, b, p in zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True)}
        tables = [f(Chunk(left.slice(i, 1).to_pylist()[0]), got) for i in range(left.num_rows)]
        return pa.concat_tables(tables)

    parts = parts_for(n_buckets)
    a, b = chunks.repartition(parts, "chunk"), replies.repartition(parts, "chunk")
    return a.groupBy("chunk").cogroup(b.groupBy("chunk")).applyInArrow(run, fields)
