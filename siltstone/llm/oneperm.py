"""One-permutation MinHash fingerprints with optimal densification, packed to low-order bits.

The hashes of a text's shingles of five words (lower-cased, repeats do not count) are dealt once to bins by their leading
bits, and each bin keeps its smallest hash. An empty bin takes the value of another: a 2-universal hash of the bin and the
attempt names one bin after the other until one is not empty, so equal bins of two texts look in the same places. Of each
value the low-order bits stay, eight by default, packed into 64-bit words. Two fingerprints agree in a share of their bins;
less the share that agrees by chance (2^-bits), that is their likeness, an estimate of the Jaccard similarity of the
shingles whose standard error is at most 0.5 / sqrt(bins): 0.03 with 256 bins.

Everything is a Column expression over the text's own row: hashes, one sort together with a mark for each bin, the bins'
first values, attempts that stop at the first bin found. Nothing is shuffled for a fingerprint.

`followed` gives each document the next one in descending order of the ids without one window over all: the ids alone are
range-partitioned, the ranges' first ids are the bounds of blocks of some 64 MB, and the first row of each block stands as
the last in the block before, too.

Defined cases: a null text is empty; a text of fewer than five words, or of none, has one shingle of all of its words; ATTEMPTS
are enough but for texts of very few shingles, whose last empty bins take any of the values by the bin's hash; equal texts have
equal fingerprints; null ids come last; documents of one id follow one another by their texts' hashes; rows equal in id and
text are one document, and each of them gets its result; texts are taken whole, each as one value of one task; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import SPACES, stage

SHINGLE, BINS, BITS, ATTEMPTS, BLOCK = 5, 256, 8, 128, 64 << 20
#: Of the attempts' hash ((STEP * (ATTEMPTS * bin + attempt) + SHIFT) mod PRIME) mod bins.
STEP, SHIFT, PRIME = 40503, 7919, 65537


def _shingles(df: DataFrame, text: str, out: str, shingle: int) -> DataFrame:
    """df with the hashes of the shingles of the text; columns named out + "_" are used on the way."""
    a = f"{out}_w"
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACES), "")
    df = df.withColumn(a, F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size(a)
    each = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(F.col(a), i + k) for k in range(shingle)]))
    return df.withColumn(out, F.when(n >= shingle, each).otherwise(F.array(F.xxhash64(a)))).drop(a)


def fingerprint(df: DataFrame, text: str, out: str, *, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """df with the packed fingerprint of the text, array<long>. bins and bits are powers of two, bits at most 32."""
    lead, low = 64 - (bins.bit_length() - 1), (1 << bits) - 1
    mark = (1 << lead) - 1  # the greatest hash of a bin stands for an empty one
    a, b, c = f"{out}_a", f"{out}_b", f"{out}_c"
    df = _shingles(df, text, a, shingle)
    marks = F.transform(F.sequence(F.lit(-bins // 2), F.lit(bins // 2 - 1)), lambda j: F.shiftleft(j.cast("long"), lead).bitwiseOR(F.lit(mark)))
    df = df.withColumn(b, F.sort_array(F.concat(F.col(a), marks))).drop(a)
    bin_of = lambda x: F.shiftright(x, lead)
    firsts = F.filter(F.col(b), lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(b), i - 1))))
    df = df.withColumn(a, F.transform(firsts, lambda x: F.when(x.bitwiseAND(F.lit(mark)) != mark, x.bitwiseAND(F.lit(low))))).drop(b)
    df = df.withColumn(b, F.filter(F.col(a), lambda x: x.isNotNull()))
    tries = ", ".join(f"get(`{a}`, (own + {STEP * t}) % {PRIME} & {bins - 1})" for t in range(ATTEMPTS))
    own = f"sequence({SHIFT}, {SHIFT + STEP * ATTEMPTS * (bins - 1)}, {STEP * ATTEMPTS})"
    any_of = f"get(`{b}`, own % {PRIME} % size(`{b}`))"
    df = df.withColumn(c, F.expr(f"zip_with(`{a}`, {own}, (x, own) -> coalesce(x, {tries}, {any_of}))")).drop(a, b)
    per = 64 // bits

    def packed(w: Column) -> Column:
        word = F.lit(0).cast("long")
        for k in range(per):
            word = word.bitwiseOR(F.shiftleft(F.get(F.col(c), w * per + k), bits * (per - 1 - k)))
        return word

    return df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(bins // per - 1)), packed)).drop(c)


def likeness(a: Column, b: Column, *, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated similarity of two packed fingerprints, 0 to 1, less what agrees by chance."""
    lanes = sum(1 << k for k in range(0, 64, bits))

    def differing(x: Column, y: Column) -> Column:
        v, s = x.bitwiseXOR(y), bits // 2
        while s:  # any difference within a lane reaches its lowest bit
            v, s = v.bitwiseOR(F.shiftrightunsigned(v, s)), s // 2
        return F.bit_count(v.bitwiseAND(F.lit(lanes)))

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda n, x: n + x)
    chance = 2.0**-bits
    return F.greatest(F.lit(0.0), ((1 - apart / float(bins)) - chance) / (1 - chance))


def hex_of(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def _order(doc_id: Column, h: Column) -> Column:
    """Sorts as descending ids, nulls last, then by the text's hash."""
    return F.struct(doc_id.isNull().alias("n"), F.coalesce(F.bitwise_not(doc_id), F.lit(0).cast("long")).alias("i"), h.alias("h"))


def followed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp) for every row: the document after it in descending order of ids, the first after the last."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("o", _order(F.col("doc_id"), F.xxhash64("text")))
    keys = stage(d.groupBy("o").agg(F.count(F.lit(1)).alias("m"), F.max(F.octet_length("text")).cast("long").alias("wide")))
    n, most, size = keys.agg(F.count(F.lit(1)), F.max("m"), F.sum("wide")).first()
    parts = max(1, min(n, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // block + 1)))
    firsts = keys.repartitionByRange(parts, "o").groupBy(F.spark_partition_id().alias("p")).agg(F.min("o").alias("o")).orderBy("o").collect()
    bounds = [{"n": r["o"]["n"], "i": r["o"]["i"], "h": r["o"]["h"]} for r in firsts]  # one a block
    known = F.from_json(F.lit(json.dumps(bounds)), "array<struct<n:boolean,i:long,h:long>>")
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, len(bounds).bit_length()) - 1, -1, -1)])
    if most and most > 1:
        d = d.dropDuplicates(["o"])
    step = lambda at, s: F.when(F.get(known, at + s - 1) <= F.col("o"), at + s).otherwise(at)
    at = F.aggregate(steps, F.lit(0), step) - 1  # the last bound that is not above
    d = fingerprint(d.withColumn("at", at), "text", "fp")
    stands = F.array(F.struct(F.col("at").alias("block"), F.lit(False).alias("last")))
    before = F.array(F.struct(F.pmod(F.col("at") - 1, F.lit(max(1, len(bounds)))).alias("block"), F.lit(True).alias("last")))
    d = d.withColumn("stands", F.explode(F.when(F.get(known, F.col("at")) == F.col("o"), F.concat(stands, before)).otherwise(stands)))
    order = W.partitionBy("stands.block").orderBy("stands.last", "o")
    d = d.select("*", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp")).where(~F.col("stands.last"))
    if most and most > 1:
        again = keys.where("m > 1").select(F.col("o").alias("again"), "m")
        d = d.join(again, F.col("o") == F.col("again"), "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("m", F.lit(1).cast("long")))))
    return d.select("doc_id", "text", "fp", "next_text", "next_fp")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, fp) of every row."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return fingerprint(d, "text", "fp", shingle=shingle, bins=bins, bits=bits).select("doc_id", "fp")
