"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has the majority bit of its word shingles' hashes. Two fingerprints a and b with d <= 3
differing bits meet at a variant: with d <= 2 both flip at most one bit; with d = 3 one of them has at least two ones
among the differing bits, clears two of these, and the other is then one flip away. So each fingerprint emits itself
and its 64 one-bit flips (near), and its variants with two ones cleared (far). All that meet at a variant are linked to
the smallest near one there: all of these pairs are verified links or lie two flips from it, no pairs within a group are
listed, and as fingerprints are distinct, a variant never has more than 2081 of them.

Before that, a fingerprint is dropped from the search if it is alone: one of its halves differs in at most one bit from
its partner's half, so the two share a half, or a half with a one cleared. These keys are only counted.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; repeated rows and ids keep a row
each; null ids are never the smallest of a component that has another; texts are taken whole, each as one value of one task;
an empty table gives no rows; other columns are ignored, whatever their names. Ties: of a component's rows dedup keeps the
one with the smallest id, then the smallest text hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.llm.common import free_names, small, stage
from siltstone.llm.graph import components

SEED, SHINGLE, SLICE = 42, 3, 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split()  # bytes: A-Z only, and splits at ASCII white space
    if not words:
        return 0
    if len(words) < shingle:
        parts: Iterator = iter([words])
        n = 1
    else:
        parts = zip(*(words[i:] for i in range(shingle)), strict=False)
        n = len(words) - shingle + 1
    ones, digest, join = np.zeros(64, dtype=np.int64), xxhash.xxh64_digest, b" ".join
    for at in range(0, n, SLICE):
        raw = b"".join([digest(join(next(parts)), SEED) for _ in range(min(SLICE, n - at))])
        ones += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = [fingerprint(t or b"") for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64()), b.column(2)], ["doc_id", "fp", "mark"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, mark) of every row; mark is a hash of the text."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("mark"))
    return d.mapInArrow(_map, "doc_id long, fp long, mark long")


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")")


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _halves() -> Column:
    """Keys of both halves of fp: as it is, and with one of its ones cleared."""
    bits = _longs([1 << i for i in range(32)])
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)

    def keys(v: Column, tag: int) -> Column:
        cleared = F.transform(F.filter(bits, lambda b: v.bitwiseAND(b) != 0), lambda b: v.bitwiseXOR(b))
        return F.transform(F.concat(F.array(v), cleared), lambda k: k + F.lit(tag << 32))

    return F.concat(keys(low, 0), keys(high, 1))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that have the same components as all pairs within 3 bits."""
    keyed = prints.select("fp", F.explode(_halves()).alias("key"))
    shared = stage(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    live = stage(keyed.join(small(shared), "key", "left_semi").select("fp").distinct())
    one = _longs([0] + [_signed(1 << i) for i in range(64)])
    two = _longs([_signed(1 << i | 1 << j) for i in range(64) for j in range(i)])
    fp = F.col("fp")
    near = live.select("fp", F.explode(one).alias("m"), F.lit(True).alias("near"))
    far = live.select("fp", F.explode(F.filter(two, lambda m: fp.bitwiseAND(m) == m)).alias("m"), F.lit(False).alias("near"))
    met = near.union(far).select("fp", fp.bitwiseXOR(F.col("m")).alias("variant"), "near")
    hub = F.min(F.when(F.col("near"), fp)).over(W.partitionBy("variant"))
    pairs = met.withColumn("hub", hub).where("fp <> hub").select(F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3)


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, mark, root, component_id) of every row; root is the component's smallest fingerprint."""
    rows = stage(fingerprints(docs, id_col, text_col))
    kinds = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(kinds.select("fp"))).withColumnRenamed("node", "n_fp")
    placed = stage(kinds.join(roots, F.col("fp") == F.col("n_fp"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    best = stage(placed.groupBy("root").agg(F.min("rep").alias("component_id"))).withColumnRenamed("root", "r")
    label = stage(placed.join(best, F.col("root") == F.col("r")).select(F.col("fp").alias("l_fp"), "root", "component_id"))
    return rows.join(label, F.col("fp") == F.col("l_fp")).select("doc_id", "fp", "mark", "root", "component_id")


def group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id reachable by links."""
    return _placed(docs, id_col, text_col).select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, all columns kept: of the smallest id, nulls last, and then of the text with the smallest hash."""
    i, m, r = free_names(docs, "kept_id", "kept_mark", "own_mark")
    g = stage(_placed(docs, id_col, text_col).select("doc_id", "mark", "root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "mark")).alias("x")
    kept = g.groupBy("root").agg(first).select(F.col("x.doc_id").alias(i), F.col("x.mark").alias(m))
    mark = F.xxhash64(text_col)
    out = docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (mark == F.col(m)), "left_semi")
    again = g.groupBy("doc_id", "mark").count().where("count > 1").limit(1).count() > 0
    # rows of one id and text are of one component
    return out.withColumn(r, mark).dropDuplicates([id_col, r]).drop(r) if again else out
