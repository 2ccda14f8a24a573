"""Deduplication, splits, subsets and ranks. Every choice among rows has a total order, so results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import exact_hash, normalized_hash
from siltstone.operators.common import cut, small


def deduplicate(df: DataFrame, code: str, order: str, mode: str = "normalized") -> DataFrame:
    """The first row, by order, of each digest of the code; missing code counts as empty. The order must be unique.

    One shuffle carries digest, order and a short hash of the code: an aggregation finds the winners, a semi-join on order
    and hash keeps them, so a loser that shares a winner's order stays out unless it has the same code.
    """
    if mode not in ("exact", "normalized"):
        raise ValueError(f"mode must be exact or normalized, got {mode!r}")
    digest, mark = (exact_hash if mode == "exact" else normalized_hash)(F.col(code)), F.xxhash64(code)
    first = df.select(digest.alias("_d"), F.struct(F.col(order).alias("o"), mark.alias("h")).alias("_f")).groupBy("_d").agg(F.min("_f").alias("_f")).select("_f.o", "_f.h")
    return df.join(first.withColumnsRenamed({"o": "_o", "h": "_h"}), (F.col(order) == F.col("_o")) & (mark == F.col("_h")), "left_semi")


def reject_stream(df: DataFrame, code: str, sample_id: str, order: str) -> DataFrame:
    """df with reason: `empty_code`, `duplicate_id` for all but the first usable row of an id, null for good rows."""
    empty = F.coalesce(F.trim(F.regexp_replace(F.col(code), r"\s+", " ")), F.lit("")) == ""
    nth = F.row_number().over(W.partitionBy(F.col(sample_id), empty).orderBy(order))
    return df.withColumn("reason", F.when(empty, "empty_code").when(nth > 1, "duplicate_id"))


def global_rank(df: DataFrame, *order: Column, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """df with its place (from 1) in a total order, without moving all rows to one task.

    Rows are range-partitioned and sorted; a row's place is its position in the partition plus the sizes of those before,
    and only these sizes, one a partition, meet in one window.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # null-safe copies of the order keys would change the order; the columns are used as they are
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_rank_m", F.monotonically_increasing_id()))
    part = placed.withColumn("_rank_p", F.shiftright("_rank_m", 33)).withColumn("_rank_i", F.col("_rank_m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = part.groupBy("_rank_p").agg(F.count("*").alias("_rank_n"))
    before = sizes.select(F.col("_rank_p").alias("_rank_q"), F.coalesce(F.sum("_rank_n").over(W.orderBy("_rank_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_rank_b"))
    out = part.join(F.broadcast(before), F.col("_rank_p") == F.col("_rank_q"))  # a row a partition
    return out.withColumn(name, (F.col("_rank_b") + F.col("_rank_i") + 1).cast("long")).drop("_rank_m", "_rank_p", "_rank_i", "_rank_q", "_rank_b")


def rank_rows(df: DataFrame, score: str = "rank_score", sample_id: str = "sample_id", top_k: int | None = None) -> DataFrame:
    """Rank by falling score, then id; a missing score counts as 0. top_k keeps the first ranks."""
    s = F.coalesce(F.col(score), F.lit(0.0)).desc()
    if top_k is None:
        return global_rank(df, s, F.col(sample_id).asc())
    first = df.orderBy(s, F.col(sample_id).asc()).limit(top_k)
    return first.withColumn("rank", F.row_number().over(W.orderBy(s, F.col(sample_id).asc())).cast("long"))


def top_k(df: DataFrame, k: int, score: str = "rank_score", sample_id: str = "sample_id") -> DataFrame:
    """The k best rows; k below 1 is an error."""
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    return rank_rows(df, score, sample_id, top_k=k)


def _by_share(df: DataFrame, place: Column, n: Column, train: float, valid: float) -> DataFrame:
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(valid))
    return df.withColumn("split", F.when(place <= a, "train").when(place <= a + b, "valid").otherwise("test"))


def _with_split(df: DataFrame, ranked: DataFrame, n: Column, train: float, valid: float, sample_id: str) -> DataFrame:
    """df with the split of its ids: ids alone are ranked, the rest of a row meets its split in one join."""
    split = _by_share(ranked, F.col("_place"), n, train, valid).select(F.col(sample_id).alias("_i"), "split")
    return df.drop("split").join(split, F.col(sample_id).eqNullSafe(F.col("_i"))).drop("_i")


def _seeded(sample_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(sample_id).cast("string"), F.lit("")), F.lit(f":{seed}")))


def random_split(df: DataFrame, sample_id: str = "sample_id", train: float = 0.7, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """Train, valid and test by place in the order of a seeded hash of the id; shares of the ids are cut to whole ones, and rows that share an id share a split."""
    ids = cut(df.select(sample_id).distinct())
    ranked = global_rank(ids, _seeded(sample_id, seed).asc(), F.col(sample_id).asc(), name="_place")
    return _with_split(df, ranked, F.lit(float(ids.count())), train, valid, sample_id)


def time_split(df: DataFrame, time: str, sample_id: str = "sample_id", train: float = 0.7, valid: float = 0.1) -> DataFrame:
    """Earliest ids train, latest test; ids without a time come last, by id. An id's first time counts."""
    ids = cut(df.groupBy(sample_id).agg(F.min(time).alias("_t")))
    ranked = global_rank(ids, F.col("_t").asc_nulls_last(), F.col(sample_id).asc(), name="_place")
    return _with_split(df, ranked, F.lit(float(ids.count())), train, valid, sample_id)


def _places(df: DataFrame, label: str, sample_id: str, seed: int) -> DataFrame:
    """(_l, _i, _place, _n): place of each (label, id) within its label, in the order of a seeded hash, and the label's number."""
    ids = cut(df.select(F.col(label).alias("_l"), F.col(sample_id).alias("_i")).distinct())
    counts = ids.groupBy(F.col("_l").alias("_k")).agg(F.count("*").alias("_n"))
    ranked = global_rank(ids, F.col("_l").asc_nulls_first(), _seeded("_i", seed).asc(), F.col("_i").asc(), name="_g")
    before = counts.select("_k", "_n", F.coalesce(F.sum("_n").over(W.orderBy(F.col("_k").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return ranked.join(small(before), F.col("_l").eqNullSafe(F.col("_k"))).select("_l", "_i", (F.col("_g") - F.col("_b")).alias("_place"), "_n")


def _kept(df: DataFrame, chosen: DataFrame, label: str, sample_id: str, how: str = "inner") -> DataFrame:
    return df.join(chosen, F.col(label).eqNullSafe(F.col("_l")) & F.col(sample_id).eqNullSafe(F.col("_i")), how)


def stratified_split(df: DataFrame, label: str = "label", sample_id: str = "sample_id", train: float = 0.7, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """Shares within each label, rounded half to even, in the order of a seeded hash."""
    a = F.bround(F.col("_n") * F.lit(train), 0)
    b = F.least(F.bround(F.col("_n") * F.lit(valid), 0), F.col("_n") - a)
    split = F.when(F.col("_place") <= a, "train").when(F.col("_place") <= a + b, "valid").otherwise("test")
    return _kept(df.drop("split"), _places(df, label, sample_id, seed).select("_l", "_i", split.alias("split")), label, sample_id).drop("_l", "_i")


def resolve_split(df: DataFrame, manifest: DataFrame, sample_id: str = "sample_id", **kw) -> DataFrame:
    """The manifest's split if it covers every id and has two splits or more; else a stratified one."""
    m = manifest.select(F.col(sample_id).alias("_i"), F.col("split").alias("split"))
    lacking = df.join(m, F.col(sample_id) == F.col("_i"), "left_anti").limit(1).count()
    kinds = m.select("split").distinct().count()
    if lacking or kinds < 2:
        return stratified_split(df, sample_id=sample_id, **kw)
    return df.drop("split").join(m, F.col(sample_id) == F.col("_i")).drop("_i")


def allocate(counts: dict[object, int], size: int) -> dict[object, int]:
    """Rows to take of each label: proportional, rounded, what is left over goes to the larger labels first."""
    total = sum(counts.values())
    size = min(size, total)
    order = sorted(counts, key=lambda k: (-counts[k], str(k)))
    out = {k: min(counts[k], round(size * counts[k] / total)) if total else 0 for k in counts}
    while (d := size - sum(out.values())) != 0:
        for k in order:
            if d > 0 and out[k] < counts[k]:
                out[k] += 1
                break
            if d < 0 and out[k] > 0:
                out[k] -= 1
                break
    return out


def stratified_subset(df: DataFrame, size: int, label: str = "label", sample_id: str = "sample_id", seed: int = 42) -> DataFrame:
    """`size` ids with the labels' shares, chosen by a seeded hash."""
    places = _places(df, label, sample_id, seed)
    take = allocate({r[0]: r[1] for r in places.select("_l", "_n").distinct().collect()}, size)  # a row a label
    if not take:
        return df.limit(0)
    limit = F.lit(take.get(None, 0))
    for k, n in take.items():
        limit = F.when(F.col("_l") == F.lit(k), F.lit(n)).otherwise(limit) if k is not None else limit
    return _kept(df, places.where(F.col("_place") <= limit), label, sample_id, "left_semi")


def balanced_subset(df: DataFrame, label: str = "label", score: str = "rank_score", sample_id: str = "sample_id", seed: int = 42) -> DataFrame:
    """As many positives as negatives, chosen by a seeded hash, ranked anew."""
    places = _places(df.where(F.col(label).isin(0, 1)), label, sample_id, seed)
    n = {r[0]: r[1] for r in places.select("_l", "_n").distinct().collect()}  # two rows
    k = min(n.get(0, 0), n.get(1, 0))
    return rank_rows(_kept(df, places.where(F.col("_place") <= k), label, sample_id, "left_semi").drop("rank"), score, sample_id)


def only_split(df: DataFrame, manifest: DataFrame, split: str = "test", sample_id: str = "sample_id", score: str = "rank_score") -> DataFrame:
    """Rows of one split, ranked anew within it."""
    ids = manifest.where(F.col("split") == split).select(F.col(sample_id).alias("_i"))
    return rank_rows(df.drop("rank").join(ids, F.col(sample_id) == F.col("_i"), "left_semi"), score, sample_id)


def join_all(left: DataFrame, right: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """left with right's columns; an id that right lacks is an error."""
    mark = right.withColumn("_there", F.lit(True))
    out = left.join(mark, sample_id, "left")
    missing = F.raise_error(F.concat(F.lit("no row for "), F.col(sample_id).cast("string")))
    return out.where(F.when(F.col("_there"), True).otherwise(missing)).drop("_there")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last by order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def missing_ids(left: DataFrame, right: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """(sample_id, side): ids that only one of the two has."""
    a, b = left.select(sample_id).distinct(), right.select(sample_id).distinct()
    return a.join(b, sample_id, "left_anti").withColumn("side", F.lit("missing")).union(b.join(a, sample_id, "left_anti").withColumn("side", F.lit("extra")))


def manifest_stats(df: DataFrame) -> DataFrame:
    """(metric, key, value): totals, labels, splits and weakness ids of a manifest."""
    total = df.agg(F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))
    flat = total.select(F.explode(F.create_map(F.lit("total"), "total", F.lit("positive"), "positive", F.lit("negative"), "negative")).alias("key", "value")).select(F.lit("rows").alias("metric"), "key", "value")
    split = df.groupBy("split").count().select(F.lit("split").alias("metric"), F.col("split").alias("key"), F.col("count").alias("value"))
    cwe = df.select(F.explode("cwe").alias("key")).groupBy("key").count().select(F.lit("cwe").alias("metric"), "key", F.col("count").alias("value"))
    return flat.union(split).union(cwe)


