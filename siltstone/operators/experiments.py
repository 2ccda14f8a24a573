"""Method matrices, false-positive reduction, ranking quality and run comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.scores import final_score, label_of
from siltstone.operators.common import cut
from siltstone.operators.evaluation import classification, costs, localization, ranking
from siltstone.operators.relational import global_rank

# Weights of the methods, and the signals that they use.
METHODS = {
    "static_only": (1.0, 0.0, 0.0), "ranker_only": (0.0, 1.0, 0.0), "static_ranker": (0.4, 0.6, 0.0),
    "static_llm": (0.5, 0.0, 0.5), "llm_only": (0.0, 0.0, 1.0), "full": (0.25, 0.45, 0.30),
}
PAIRS = (("static_ranker", "full"), ("static_only", "static_llm"))


def without_verifier(weights: tuple[float, float, float]) -> tuple[float, float, float]:
    """Weights without the verifier's, made to sum to 1; all zero if nothing is left."""
    s = weights[0] + weights[1]
    return (weights[0] / s, weights[1] / s, 0.0) if s > 0 else (0.0, 0.0, 0.0)


def cells(spark: SparkSession, ks: Sequence[int], methods: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """(method, k, w_static, w_rank, w_llm): a row a cell."""
    rows = [(m, k, *(without_verifier(w) if k == 0 else w)) for m, w in (methods or METHODS).items() for k in ks]
    return spark.createDataFrame(rows, "method string, k int, w_static double, w_rank double, w_llm double")


def matrix(scored: DataFrame, ks: Sequence[int], methods: dict[str, tuple[float, float, float]] | None = None, threshold: float = 0.5) -> DataFrame:
    """Classification of every method and k.

    scored: rank, label, static_score, rank_score, llm_score. A verdict counts in a cell if its sample is among the k best.
    All cells are one pass over the samples: the few cells are exploded beside each row and summed before the shuffle.
    """
    c = cells(scored.sparkSession, ks, methods)
    j = scored.crossJoin(F.broadcast(c))  # a row a cell: methods times k
    llm = F.when((F.col("rank") <= F.col("k")) & (F.col("w_llm") > 0), F.col("llm_score")).otherwise(0.0)
    final = final_score(F.col("static_score"), F.col("rank_score"), llm, {"static": F.col("w_static"), "ranker": F.col("w_rank"), "llm": F.col("w_llm")})
    return classification(j.withColumn("_f", final), F.col("label"), F.col("_f"), threshold, "method", "k")


def matrix_cells(scored: DataFrame, ks: Sequence[int], methods: dict[str, tuple[float, float, float]] | None = None, threshold: float = 0.5, truth: DataFrame | None = None, findings: DataFrame | None = None, cost_log: DataFrame | None = None, at: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """matrix() with, for each cell, its samples, the verdicts that it uses, the signals it has, the ranking of its final scores, and
    the areas under its curves; with truth and findings the localisation, with a cost log its totals, which all cells share.

    Cells are ranked all at once, by (cell, score, id), so a cell's ranks are places less those of the cells before.
    """
    c = cells(scored.sparkSession, ks, methods)
    j = scored.select("sample_id", "label", "rank", "static_score", "rank_score", "llm_score").crossJoin(F.broadcast(c))  # a row a cell
    uses = (F.col("rank") <= F.col("k")) & (F.col("w_llm") > 0) & F.col("llm_score").isNotNull() & (F.col("llm_score") > 0)
    final = final_score(F.col("static_score"), F.col("rank_score"), F.when(uses, F.col("llm_score")).otherwise(0.0), {"static": F.col("w_static"), "ranker": F.col("w_rank"), "llm": F.col("w_llm")})
    f = cut(j.select("method", "k", "sample_id", "label", uses.alias("uses"), final.alias("score")))
    base = classification(f, F.col("label"), F.col("score"), threshold, "method", "k")
    more = f.groupBy("method", "k").agg(F.count("*").alias("samples"), F.count_if("uses").alias("llm_verified_count"))
    places = global_rank(f, F.col("method").asc(), F.col("k").asc(), F.col("score").desc(), F.col("sample_id").asc(), name="_place")
    first = places.groupBy(F.col("method").alias("_m"), F.col("k").alias("_k")).agg(F.min("_place").alias("_f"))
    ranked = places.join(F.broadcast(first), (F.col("method") == F.col("_m")) & (F.col("k") == F.col("_k"))).withColumn("rank", F.col("_place") - F.col("_f") + 1)  # a row a cell
    out = base.join(more, ["method", "k"]).join(ranking(ranked, "label", at, "method", "k"), ["method", "k"]).join(cell_aucs(ranked), ["method", "k"], "left")
    flags = c.select("method", "k", (F.col("w_static") > 0).alias("static_enabled"), (F.col("w_rank") > 0).alias("ranker_enabled"), ((F.col("w_llm") > 0) & (F.col("k") > 0)).alias("llm_enabled"))
    out = out.join(F.broadcast(flags), ["method", "k"])  # a row a cell
    if truth is not None and findings is not None:
        out = out.crossJoin(F.broadcast(localization(truth, findings).drop("samples")))  # one row
    if cost_log is not None:
        out = out.crossJoin(F.broadcast(costs(cost_log).select("total_cost", "avg_latency")))  # one row
    return out


def cell_aucs(ranked: DataFrame) -> DataFrame:
    """(method, k, roc_auc, pr_auc) of cells, from scores summed by value: ties count half in ROC, PR is average precision."""
    by = ranked.groupBy("method", "k", "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))
    # values of one cell in blocks of bounded size: sums of the blocks before, then of the values before in the block
    g = global_rank(by, F.col("method").asc(), F.col("k").asc(), F.col("score").desc(), name="_r").withColumn("_b", F.floor(F.col("_r") / 10_000))
    blocks = g.groupBy("method", "k", "_b").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    w = W.partitionBy("method", "k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    before = blocks.select("method", "k", "_b", zero(F.sum("bp").over(w)).alias("bp"), zero(F.sum("bn").over(w)).alias("bn"))
    inside = W.partitionBy("method", "k", "_b").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    x = g.join(before, ["method", "k", "_b"]).withColumns({"tp": F.col("bp") + zero(F.sum("p").over(inside)), "fp": F.col("bn") + zero(F.sum("n").over(inside))})
    area = (F.col("n") * (F.col("tp") + F.col("p") / F.lit(2.0))).cast("double")
    step = F.col("p") * (F.col("tp") + F.col("p")) / (F.col("tp") + F.col("p") + F.col("fp") + F.col("n"))
    s = x.groupBy("method", "k").agg(F.sum(area).alias("a"), F.sum(step).alias("s"), F.sum("p").alias("P"), F.sum("n").alias("N"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return s.select("method", "k", F.when(both, F.try_divide("a", F.col("P").cast("double") * F.col("N"))).alias("roc_auc"), F.when(both, F.try_divide("s", F.col("P").cast("double"))).alias("pr_auc"))


def fp_reduction(cells_: DataFrame, pairs: Sequence[tuple[str, str]] = PAIRS) -> DataFrame:
    """False positives and precision of methods with and without the verifier, at each k."""
    out = None
    for base, llm in pairs:
        b = cells_.where(F.col("method") == base).select("k", F.col("fp").alias("fp_before"), F.col("precision").alias("precision_before"))
        a = cells_.where(F.col("method") == llm).select("k", F.col("fp").alias("fp_after"), F.col("precision").alias("precision_after"))
        one = b.join(a, "k").select(F.lit(base).alias("baseline_method"), F.lit(llm).alias("llm_method"), "k", "fp_before", "fp_after", (F.col("fp_before") - F.col("fp_after")).alias("fp_reduction"), "precision_before", "precision_after", (F.col("precision_after") - F.col("precision_before")).alias("precision_gain"))
        out = one if out is None else out.union(one)
    return out


def ranking_quality(df: DataFrame, scores: Sequence[str], ks: Sequence[int] = (10, 30, 50), label: str = "label", sample_id: str = "sample_id") -> DataFrame:
    """mrr, recall and ndcg of each score column."""
    out = None
    for s in scores:
        r = global_rank(df.drop("rank"), F.coalesce(F.col(s), F.lit(0.0)).desc(), F.col(sample_id).asc())
        one = ranking(r, label, ks)
        one = one.select(F.lit(s).alias("score_type"), *one.columns)
        out = one if out is None else out.union(one)
    return out


def compare_runs(before: DataFrame, after: DataFrame, metric: str, keys: Sequence[str] = ("method", "k"), margin: float = 0.01) -> DataFrame:
    """Mean difference of a metric over the cells of both runs, and whether it is comparable, better or worse."""
    j = before.select(*keys, F.col(metric).alias("_a")).join(after.select(*keys, F.col(metric).alias("_b")), list(keys))
    d = j.agg(F.count("*").alias("cells"), F.avg(F.col("_b") - F.col("_a")).alias("mean_delta"))
    return d.withColumn("verdict", F.when(F.abs("mean_delta") <= margin, "comparable").when(F.col("mean_delta") > 0, "better").otherwise("worse"))


def three_runs(now: DataFrame, first: DataFrame, second: DataFrame, metrics: Sequence[str] = ("f1", "mcc", "pr_auc"), keys: Sequence[str] = ("method", "k")) -> DataFrame:
    """now's cells with the metrics of two earlier runs beside them (<metric>_first, <metric>_second), null where a run lacks the cell."""
    out = now.select(*keys, *metrics)
    for name, run in (("first", first), ("second", second)):
        out = out.join(run.select(*keys, *[F.col(m).alias(f"{m}_{name}") for m in metrics]), list(keys), "left")
    return out.select(*keys, *[c for m in metrics for c in (f"{m}_first", f"{m}_second", m)])


def best_row(df: DataFrame, metric: str, order: str) -> DataFrame:
    """The row with the highest metric, nulls last, the first among equals."""
    return df.orderBy(F.col(metric).desc_nulls_last(), order).limit(1)


def param_grid(scored: DataFrame, grid: Sequence[tuple[float, float, float]], threshold: float = 0.5) -> DataFrame:
    """Classification of each weight triple of a grid."""
    c = scored.sparkSession.createDataFrame([(i, *w) for i, w in enumerate(grid)], "cell int, w_static double, w_rank double, w_llm double")
    j = scored.crossJoin(F.broadcast(c))  # the grid is a literal
    final = final_score(F.col("static_score"), F.col("rank_score"), F.col("llm_score"), {"static": F.col("w_static"), "ranker": F.col("w_rank"), "llm": F.col("w_llm")})
    return classification(j.withColumn("_f", final), F.col("label"), F.col("_f"), threshold, "cell", "w_static", "w_rank", "w_llm")


def label_counts(df: DataFrame, score: str = "final_score", threshold: float = 0.5) -> DataFrame:
    return df.groupBy(label_of(F.col(score), threshold).alias("final_label")).count()


def score_stats(df: DataFrame, score: str = "rank_score") -> DataFrame:
    return df.agg(F.min(score).alias("min"), F.max(score).alias("max"), F.avg(score).alias("mean"), F.count_if(F.col("label") == 1).alias("positives"))


def price(log: DataFrame, prompt_price: float, completion_price: float) -> DataFrame:
    """log with api_cost_usd from prices a million tokens, null where both counts are missing."""
    cost = (F.coalesce("prompt_tokens", F.lit(0)) * prompt_price + F.coalesce("completion_tokens", F.lit(0)) * completion_price) / F.lit(1e6)
    return log.withColumn("api_cost_usd", F.when(F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull(), F.round(cost, 8)))


def cost_preview(prompts: DataFrame, text: str, prompt_price: float, completion_price: float, completion_tokens: int = 500) -> DataFrame:
    """Calls, tokens (four characters each) and cost of prompts before they are sent."""
    a = prompts.agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.floor(F.length(text) / 4)), F.lit(0)).alias("prompt_tokens"))
    a = a.withColumn("completion_tokens", F.col("calls") * completion_tokens)
    return a.withColumn("cost_usd", (F.col("prompt_tokens") * prompt_price + F.col("completion_tokens") * completion_price) / F.lit(1e6))
