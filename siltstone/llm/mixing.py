"""Mixing sources to target weights by pivotal dependent rounding in a distributed reduction tree.

Each document of a source gets the same expected number of copies, target / source size. The whole part is granted; of
the fractions, two at a time exchange mass (words times probability) at random until one is 0 or 1, so the expected mix
is the target and the words taken differ from it by less than one document of the source. Blocks of some tens of
documents of like size are folded in parallel, each leaves one undecided fraction, and these meet in the next level of
the tree. The last fold goes from large to small, so what stays undecided at the end is a small document.

Defined cases: null or empty texts have size 0 and are taken 0 times; a source may be null (it is a source of its own,
last in order); rows equal in id, source and text are pooled and share their copies evenly; texts are counted whole, as one
value of a task; fractions of equal size meet in the order of a hash; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import free_names, n_spaced_words, stage


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeat: float = 3) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes by them; a target stops
    at max_repeat times its source, and what it leaves is shared again: water filling, solved in one sorted pass.
    The table has a row per source, so the windows over all of it stay small.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    t = sizes.withColumn("w", w).withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (total - before) / F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing))
    t = t.withColumn("total", total).withColumn("full", F.col("cap") <= level * F.col("w"))
    everyone = W.partitionBy()
    left = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everyone)
    share = left / F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everyone)
    spread = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), share * F.col("w")))
    return t.select("source", "source_size", "n", spread.alias("target"))


def _fold(elements: Column, seed: int) -> Column:
    """Sequential pivotal steps over an array of (size, r, doc_id, h, p, base, m): struct(c: undecided one, done)."""
    none = F.filter(elements, lambda e: F.lit(False))

    def decided(e: Column, up: Column) -> Column:
        return e.withField("p", F.when(up, 1.0).otherwise(0.0))

    def step(acc: Column, e: Column) -> Column:
        a = acc["c"][0]
        draw = F.pmod(F.xxhash64(a["r"], e["r"], F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        x = F.struct(a.alias("a"), (a["size"] * a["p"]).alias("ma"), (a["size"] * (1 - a["p"])).alias("ra"), (e["size"] * e["p"]).alias("mb"), (e["size"] * (1 - e["p"])).alias("rb"), draw.alias("u"))

        def settle(v: Column) -> Column:
            up, down = F.least(v["ra"], v["mb"]), F.least(v["ma"], v["rb"])
            to_a = v["u"] * (up + down) < down
            a_done = F.when(to_a, v["ra"] <= v["mb"]).otherwise(v["ma"] <= v["rb"])
            moved = F.when(to_a, up).otherwise(-down)
            a_left = v["a"].withField("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v["ma"] + moved) / v["a"]["size"])))
            e_left = e.withField("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v["mb"] - moved) / e["size"])))
            return F.struct(
                F.when(a_done, F.array(e_left)).otherwise(F.array(a_left)).alias("c"),
                F.concat(acc["done"], F.when(a_done, F.array(decided(v["a"], to_a))).otherwise(F.array(decided(e, ~to_a)))).alias("done"),
            )

        return F.when(F.size(acc["c"]) == 0, F.struct(F.array(e).alias("c"), acc["done"].alias("done"))).otherwise(F.transform(F.array(x), settle)[0])

    return F.aggregate(elements, F.struct(none.alias("c"), none.alias("done")), step)


def _levels(n: int, fan_in: int) -> int:
    """Levels of the tree that leave at most 2 * fan_in fractions of a band, whose blocks are dealt by a hash."""
    k = 0
    while n > 2 * fan_in:
        n, k = ceil(n / fan_in), k + 1
    return k


def _units(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], max_repeat: float, seed: int, fan_in: int) -> DataFrame:
    """(doc_id, source, h, size, source_size, target, m, all): of the m rows that are equal in id, source and text (hash h), the copies taken of all of them."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("h"), n_spaced_words(F.col(text_col)).alias("size"))
    units = stage(d.groupBy("doc_id", "source", "h", "size").agg(F.count("*").alias("m")))
    src = stage(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n")), weights, max_repeat).withColumnRenamed("source", "s"))
    most = src.agg(F.max("n")).first()[0] or 0
    share = F.when(F.col("source_size") > 0, F.col("m") * F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.when(F.abs(share - F.round(share)) < 1e-9, F.round(share)).otherwise(share)
    u = units.join(src, F.col("source").eqNullSafe(F.col("s"))).withColumn("x", F.when(F.col("size") > 0, near).otherwise(0.0))
    u = u.withColumn("base", F.floor("x").cast("long")).withColumn("p", F.col("x") - F.col("base"))
    r = F.xxhash64("doc_id", "size", "source", "h", F.lit(seed))
    u = u.withColumn("r", r).withColumn("band", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int"))
    keys = ["source", "source_size", "target"]
    element = F.struct("size", "r", "doc_id", "h", "p", "base", "m")
    parts = [u.where("p = 0").select(*keys, element.alias("e"))]
    level = u.where("p > 0").select(*keys, "band", F.col("r").alias("spot"), element.alias("e"))
    roots = []
    # within a band of like sizes: fold blocks until few fractions are left; then one fold a source, from large to small
    for _ in range(_levels(most, fan_in)):
        cells = stage(level.groupBy("source", "band").agg(F.count("*").alias("n"))).withColumnsRenamed({"source": "c_source", "band": "c_band"})
        level = level.join(cells, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("band") == F.col("c_band"))).drop("c_source", "c_band")
        level = stage(level)
        roots.append(level.where(F.col("n") <= fan_in).select(*keys, "e"))
        block = F.pmod(F.xxhash64("spot"), F.ceil(F.col("n") / fan_in).cast("long"))
        cut = level.where(F.col("n") > fan_in).withColumn("block", block)
        folded = stage(cut.groupBy(*keys, "band", "block").agg(_fold(F.sort_array(F.collect_list("e"), asc=False), seed).alias("f")))
        parts.append(folded.select(*keys, F.explode("f.done").alias("e")))
        level = folded.select(*keys, "band", F.col("block").alias("spot"), F.explode("f.c").alias("e"))
    roots.append(level.select(*keys, "e"))
    root = roots[0]
    for x in roots[1:]:
        root = root.union(x)
    # at most some fan_in fractions for each power of two that a size can have
    folded = stage(root.groupBy(*keys).agg(_fold(F.sort_array(F.collect_list("e"), asc=False), seed).alias("f")))
    parts.append(folded.select(*keys, F.explode("f.done").alias("e")))
    level = folded.select(*keys, F.explode("f.c").alias("e"))
    last = F.pmod(F.xxhash64(F.col("e.r"), F.lit("last"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    parts.append(level.select(*keys, F.col("e").withField("p", F.when(last < F.col("e.p"), 1.0).otherwise(0.0)).alias("e")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.select(*keys, "e.doc_id", "e.h", "e.size", "e.m", (F.col("e.base") + F.col("e.p").cast("long")).alias("all"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), max_repeat: float = 3, seed: int = 29, fan_in: int = 32) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): a row per document row; taken = copies * size."""
    rows = _units(docs, id_col, text_col, source_col, weights, max_repeat, seed, fan_in)
    # pooled rows are dealt again, in slices so that no array grows with the number of repeats
    rows = rows.withColumn("hi", F.explode(F.expr("sequence(0L, (m - 1) div 4096)")))
    rows = rows.withColumn("i", F.explode(F.expr("sequence(hi * 4096, least(m, (hi + 1) * 4096) - 1)")))
    copies = F.expr("all div m + if(i < all % m, 1, 0)")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), max_repeat: float = 3, seed: int = 29, fan_in: int = 32) -> DataFrame:
    """The mix itself: the documents that it takes, all columns kept, with copies and taken (which replace columns so named).

    Rows that are equal in id, source and text are one document here: one of them stays, with the copies of all.
    """
    units = stage(_units(docs, id_col, text_col, source_col, weights, max_repeat, seed, fan_in))
    again = not units.where("m > 1").isEmpty()
    docs = docs.drop("copies", "taken")
    i, s, h, own = free_names(docs, "unit_id", "unit_source", "unit_h", "own_h")
    got = units.where("all > 0").select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("h").alias(h), F.col("all").alias("copies"), (F.col("all") * F.col("size")).alias("taken"))
    d = docs.withColumn(own, F.xxhash64(text_col))
    if again:
        d = d.dropDuplicates([id_col, source_col, own])
    on = F.col(id_col).eqNullSafe(F.col(i)) & F.col(source_col).cast("string").eqNullSafe(F.col(s)) & (F.col(own) == F.col(h))
    return d.join(got, on).select(*[f"`{c}`" for c in docs.columns], "copies", "taken")
