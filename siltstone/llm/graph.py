"""Connected components by alternating large-star and small-star steps on a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import stage


def _joined(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges (u, v) with the low neighbour m of u. `low` is staged, so both sides are dealt anew and skewed hubs are split."""
    return edges.join(stage(low).withColumnRenamed("u", "k"), F.col("u") == F.col("k")).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return _joined(both.where("v > u"), low).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    kept = low.select(F.col("u").alias("a"), F.col("m").alias("b"))
    moved = _joined(down, low).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return kept.union(moved).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node that it is connected with."""
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(e)
    while mark[0]:
        e = stage(_small_star(stage(_large_star(e))))
        if (now := _mark(e)) == mark:
            break
        mark = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stage(e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots))
