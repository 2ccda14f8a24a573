"""Classification, ranking, localisation and cost metrics, and audits. Metrics stay unrounded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.lines import hit, iou
from siltstone.functions.normalize import safe_div
from siltstone.operators.relational import global_rank
from siltstone.schemas import VERDICTS, validate


def confusion(df: DataFrame, label: Column, predicted: Column, *keys: str) -> DataFrame:
    """tp, fp, tn, fn, of each group of keys."""
    y, p = label == 1, predicted == 1
    counts = {"tp": y & p, "fp": ~y & p, "tn": ~y & ~p, "fn": y & ~p}
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def mcc(tp: Column, fp: Column, tn: Column, fn: Column, empty: Column | None = None) -> Column:
    """Matthews correlation in doubles; `empty` (0 by default) where a margin is 0."""
    a, b, c, d = (x.cast("double") for x in (tp, fp, tn, fn))
    den = (a + b) * (a + d) * (c + b) * (c + d)
    return F.when(den == 0, F.lit(0.0) if empty is None else empty).otherwise((a * c - b * d) / F.sqrt(den))


def classification(df: DataFrame, label: Column, score: Column, threshold: float = 0.5, *keys: str) -> DataFrame:
    """Confusion counts with accuracy, precision, recall, f1 and mcc."""
    m = confusion(df, label, (score >= threshold).cast("int"), *keys)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return m.withColumns({"accuracy": safe_div(tp + tn, tp + fp + tn + fn), "precision": p, "recall": r, "f1": safe_div(2 * p * r, p + r), "mcc": mcc(tp, fp, tn, fn)})


def aucs(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """(roc_auc, pr_auc): ties count half in ROC; PR is average precision by steps; null with one class only.

    Rows are first summed by distinct score; running counts over these come from a range-partitioned pass.
    """
    by = df.select(label.alias("y"), score.alias("s")).groupBy("s").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("n"))
    run = running_sums(by, F.col("s").desc(), ["p", "n"])
    t = run.crossJoin(F.broadcast(by.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))))  # one row
    area = (F.col("n") * (F.col("p_before") + F.col("p") / F.lit(2.0))).cast("double")
    step = F.col("p") * (F.col("p_before") + F.col("p")) / (F.col("p_before") + F.col("p") + F.col("n_before") + F.col("n"))
    out = t.agg(F.sum(area).alias("a"), F.sum(step).alias("s"), F.max("tp").alias("tp"), F.max("tn").alias("tn"))
    both = (F.col("tp") > 0) & (F.col("tn") > 0)
    return out.select(F.when(both, F.try_divide("a", F.col("tp").cast("double") * F.col("tn"))).alias("roc_auc"), F.when(both, F.try_divide("s", F.col("tp").cast("double"))).alias("pr_auc"))


#: Rows, blocks and blocks of blocks that one window takes.
BLOCK = 10_000


def running_sums(df: DataFrame, order: Column, sums: Sequence[str]) -> DataFrame:
    """df with <c>_before for each c: the sum of c over the rows before in the order, without a window over all rows.

    Rows are numbered; blocks of them are summed up, blocks of these blocks, and so on (three levels reach 10^16 rows), and
    the sums before each block are handed down again. Every window is over the members of one block.
    """
    ranked = global_rank(df, order, name="_r").withColumn("_k0", F.floor((F.col("_r") - 1) / BLOCK))
    levels = [ranked.groupBy("_k0").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])]
    for i in range(1, 3):
        up = levels[-1].withColumn(f"_k{i}", F.floor(F.col(f"_k{i - 1}") / BLOCK))
        levels[-1] = up
        levels.append(up.groupBy(f"_k{i}").agg(*[F.sum(f"_t_{c}").alias(f"_t_{c}") for c in sums]))
    levels[-1] = levels[-1].withColumn("_k3", F.floor(F.col("_k2") / BLOCK))
    before = None
    for i in (2, 1, 0):
        own = W.partitionBy(f"_k{i + 1}").orderBy(f"_k{i}").rowsBetween(W.unboundedPreceding, -1)
        t = levels[i].select(f"_k{i}", f"_k{i + 1}", *[F.coalesce(F.sum(f"_t_{c}").over(own), F.lit(0)).alias(f"_w_{c}") for c in sums])
        if before is not None:
            t = t.join(before, F.col(f"_k{i + 1}") == F.col("_j")).select(f"_k{i}", *[(F.col(f"_w_{c}") + F.col(f"_b_{c}")).alias(f"_w_{c}") for c in sums])
        before = t.select(F.col(f"_k{i}").alias("_j"), *[F.col(f"_w_{c}").alias(f"_b_{c}") for c in sums])
    inside = W.partitionBy("_k0").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    out = ranked.join(before, F.col("_k0") == F.col("_j"))
    return out.withColumns({f"{c}_before": F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).drop("_r", "_k0", "_j", *[f"_b_{c}" for c in sums])


def order_statistics(df: DataFrame, column: str, share: float, buckets: int = 4096) -> tuple[float, float, float] | None:
    """(lower value, upper value, weight of the upper) at the share of the sorted values, null ones left out; None without values.

    Exact, in bounded memory: values are counted by sign and exponent, with each bucket's least and greatest value; the bucket
    that holds the wanted place is cut into buckets of equal width, and so on, until it holds one value: some six passes at
    most. Infinite values and, after all others, NaN are counted apart.
    """
    x = F.col(column).cast("double")
    v = df.select(x.alias("x")).where("x is not null")
    odd = [F.count_if(F.col("x") == float("-inf")), F.count_if(F.col("x") == float("inf")), F.count_if(F.isnan("x"))]
    finite = ~F.isnan("x") & ~F.col("x").isin(float("inf"), float("-inf"))
    n, low, high, nan, least, most = v.agg(F.count(F.lit(1)), *odd, F.min(F.when(finite, F.col("x"))), F.max(F.when(finite, F.col("x")))).first()
    if not n:
        return None
    at = share * (n - 1)
    below = int(at)
    above = min(below + 1, n - 1) if at > below else below

    def value(place: int) -> float:
        if place < low:
            return float("-inf")
        if place >= n - nan:
            return float("nan")
        if place >= n - nan - high:
            return float("inf")
        a, b, left, scale = least, most, place - low, True
        while a != b:
            half, step = a / 2, (b / 2 - a / 2) / buckets * 2  # halves, as the range of doubles is no double
            near = v.where(finite & F.col("x").between(a, b))
            cell = F.least(F.lit(buckets - 1), F.floor((F.col("x") / 2 - F.lit(half)) / F.lit(step) * 2)) if step else F.when(F.col("x") == a, 0).otherwise(1)
            if scale:
                cell, scale = F.when(F.col("x") == 0, 0).otherwise(F.signum("x") * (F.floor(F.log2(F.abs("x"))) + 1100)), False
            for _, count, first, last in sorted(map(tuple, near.groupBy(cell.alias("c")).agg(F.count(F.lit(1)), F.min("x"), F.max("x")).collect())):  # a row a bucket
                if left < count:
                    if (first, last) == (a, b):  # neighbours that no width can part
                        return a if left < near.where(F.col("x") == a).count() else b
                    a, b = first, last
                    break
                left -= count
        return a

    lower = value(below)
    return lower, lower if above == below else value(above), at - below


def percentile(df: DataFrame, column: str, share: float) -> float | None:
    """The exact percentile with linear interpolation between neighbours."""
    found = order_statistics(df, column, share)
    if found is None:
        return None
    a, b, w = found
    return a if w == 0 or a == b else a + (b - a) * w


def ranking(ranked: DataFrame, label: str, ks: Sequence[int], *keys: str) -> DataFrame:
    """mrr, and recall and ndcg at each k, from ranks within the groups of keys."""
    y = F.col(label) == 1
    base = ranked.groupBy(*keys).agg(F.count_if(y).alias("positives"), F.min(F.when(y, F.col("rank"))).alias("first"), *[F.count_if(y & (F.col("rank") <= k)).alias(f"hits_{k}") for k in ks], *[F.sum(F.when(y & (F.col("rank") <= k), F.lit(1.0) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg_{k}") for k in ks])
    out = {"mrr": F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))}
    for k in ks:
        m = F.least("positives", F.lit(k))
        ideal = F.when(m > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1)))
        out[f"recall_at_{k}"] = safe_div(F.col(f"hits_{k}"), F.col("positives"))
        out[f"ndcg_at_{k}"] = F.coalesce(F.try_divide(F.col(f"dcg_{k}"), ideal), F.lit(0.0))
    return base.select(*keys, *[v.alias(n) for n, v in out.items()])


def grouped_ranking(df: DataFrame, label: str, score: str, sample_id: str, group: str | None, ks: Sequence[int] = (1, 5, 10, 20), source: str | None = None) -> DataFrame:
    """(scope, grp, metrics): each group by its own ranks, their unweighted mean, and all rows as one list.

    The group is a column, or with source a key of that map column. Rows without the column or the key are `__ungrouped__`,
    those with a null value `None`.
    """
    s = F.coalesce(F.col(score), F.lit(0.0)).desc()
    if source is not None:
        value = F.coalesce(F.try_element_at(source, F.lit(group)).cast("string"), F.lit("None"))
        value = F.when(F.coalesce(F.map_contains_key(source, group), F.lit(False)), value).otherwise("__ungrouped__")
    else:
        value = F.coalesce(F.col(group).cast("string"), F.lit("None")) if group in df.columns else F.lit("__ungrouped__")
    keep = [F.col(sample_id).alias("_id"), F.col(label).alias("_y"), F.col(score).alias("_s")]
    df = df.select(*keep, value.alias("_g"))  # what is ranked: ids, labels and scores alone
    label, sample_id, s, g = "_y", "_id", F.coalesce("_s", F.lit(0.0)).desc(), df
    # a group's ranks: places in the order of (group, score, id), less the rows of the groups before
    all_ranks = global_rank(g, F.col("_g").asc(), s, F.col(sample_id).asc(), name="_place")
    first = all_ranks.groupBy("_g").agg(F.min("_place").alias("_f")).withColumnRenamed("_g", "_h")
    each = ranking(all_ranks.join(first, F.col("_g") == F.col("_h")).withColumn("rank", F.col("_place") - F.col("_f") + 1), label, ks, "_g")
    names = [c for c in each.columns if c != "_g"]
    macro = each.agg(*[F.avg(c).alias(c) for c in names]).select(F.lit("macro").alias("scope"), F.lit("").alias("grp"), *names)
    whole = ranking(global_rank(df, s, F.col(sample_id).asc()), label, ks).select(F.lit("overall").alias("scope"), F.lit("").alias("grp"), *names)
    return each.select(F.lit("group").alias("scope"), F.col("_g").alias("grp"), *names).union(macro).union(whole)


def localization(truth: DataFrame, findings: DataFrame, ks: Sequence[int] = (1, 3, 5), sample_id: str = "sample_id") -> DataFrame:
    """Hit rates at k, mean IoU and coverage over the samples with true lines; samples without a finding miss."""
    t = truth.select(sample_id, F.col("vulnerable_lines").alias("t"))
    j = t.join(findings.select(sample_id, F.col("vulnerable_lines").alias("p")), sample_id, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.agg(F.count("*").alias("samples"), *[zero(F.avg(hit(F.col("p"), F.col("t"), k).cast("double"))).alias(f"top{k}_hit") for k in ks], zero(F.avg(iou(F.col("p"), F.col("t")))).alias("mean_iou"), zero(F.avg(F.col("p").isNotNull().cast("double"))).alias("coverage"))


def costs(log: DataFrame) -> DataFrame:
    """Totals and means of tokens, cost and latency, and the exact 95th percentile of the latency, which takes some passes. Missing is not 0: totals skip it, means of tokens and cost divide by all rows."""
    total = F.coalesce("total_tokens", F.when(F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull(), F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))))
    t = log.withColumn("_t", total).agg(F.count("*").alias("calls"), F.sum("_t").alias("total_tokens"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("api_cost_usd").alias("total_cost"), F.avg("latency_seconds").alias("avg_latency")).withColumn("p95_latency", F.lit(percentile(log, "latency_seconds", 0.95)).cast("double"))
    n = F.col("calls")
    return t.withColumns({"avg_tokens": F.try_divide(F.col("total_tokens").cast("double"), n), "avg_cost": F.try_divide("total_cost", n)})


def topk_verdicts(rows: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Verdicts on the k best: both settings of uncertain ones, and what the verifier gains over the ranker.

    rows: rank, label, verdict. Each row is counted once for each k that it belongs to.
    """
    r = rows.where(F.col("rank") <= max(ks)).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    r = r.withColumn("setting", F.explode(F.array(F.lit("uncertain_as_negative"), F.lit("uncertain_excluded"))))
    use = (F.col("setting") == "uncertain_as_negative") | (F.col("verdict") != "uncertain")
    v, y = F.col("verdict") == "vulnerable", F.col("label") == 1
    a = r.groupBy("k", "setting").agg(
        F.count("*").alias("n"), F.count_if(use).alias("candidates"), F.count_if(y).alias("positives_in_topk"), F.count_if(v).alias("vulnerable_n"), F.count_if(F.col("verdict") == "benign").alias("benign_n"), F.count_if(F.col("verdict") == "uncertain").alias("uncertain_n"),
        F.count_if(use & v & y).alias("tp"), F.count_if(use & v & ~y).alias("fp"), F.count_if(use & ~v & ~y).alias("tn"), F.count_if(use & ~v & y).alias("fn"), F.count_if((F.col("verdict") == "benign") & ~y).alias("benign_true"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, rec = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    kept, base = safe_div(tp, F.col("vulnerable_n")), safe_div(F.col("positives_in_topk"), F.col("n"))
    return a.withColumns({
        "precision": p, "recall": rec, "f1": safe_div(2 * p * rec, p + rec), "accuracy": safe_div(tp + tn, tp + fp + tn + fn), "mcc": mcc(tp, fp, tn, fn, F.lit(None).cast("double")), "uncertain_rate": safe_div(F.col("uncertain_n"), F.col("n")),
        "vulnerable_verdict_precision": kept, "benign_verdict_precision": safe_div(F.col("benign_true"), F.col("benign_n")), "ranker_precision": base, "precision_gain": kept - base,
    }).drop("benign_true")


def ablation(results: DataFrame, metric: str, baseline: str | None = None, full: str = "full") -> DataFrame:
    """results (config, metrics...) ranked by the metric, with the difference to baseline, `full` or the best; a row a run."""
    v = F.coalesce(F.col(metric), F.lit(0.0))
    order = W.orderBy(v.desc(), "config")
    everyone = W.partitionBy()
    ranked = results.withColumn("rank", F.row_number().over(order))
    if baseline is not None:
        ref = F.col("config") == baseline
    else:
        has = F.max((F.col("config") == full).cast("int")).over(everyone) == 1
        ref = F.when(has, F.col("config") == full).otherwise(F.col("rank") == 1)
    ranked = ranked.withColumn("is_reference", ref)
    of = F.max(F.when(F.col("is_reference"), v)).over(everyone)
    return ranked.select("config", F.lit(metric).alias("metric"), F.col(metric).alias("value"), (F.col(metric) - of).alias("delta"), "rank", "is_reference")


def audit_ranks(ranks: DataFrame, manifest: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """(check, failures): repeated, missing and extra ids, scores out of range, ranks that are not 1..n, labels that differ."""
    n = ranks.count()
    seen = ranks.select("rank").where(F.col("rank").between(1, n)).distinct().count()
    j = ranks.select(sample_id, F.col("label").alias("a")).join(manifest.select(sample_id, F.col("label").alias("b")), sample_id)
    s = F.col("rank_score")
    parts = [
        ("duplicate_ids", ranks.groupBy(sample_id).count().where("count > 1")),
        ("missing_ids", manifest.join(ranks, sample_id, "left_anti")),
        ("extra_ids", ranks.join(manifest, sample_id, "left_anti")),
        ("score_range", ranks.where(s.isNull() | F.isnan(s) | ~s.between(0, 1))),
        ("label_mismatch", j.where(~F.col("a").eqNullSafe(F.col("b")))),
    ]
    out = ranks.sparkSession.createDataFrame([("rank_gaps", n - seen)], "check string, failures long")
    for name, bad in parts:
        out = out.union(bad.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures"))
    return out


def _counted(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(check, failures): the rows of each part."""
    out = None
    for name, bad in parts:
        one = bad.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")
        out = one if out is None else out.union(one)
    return out


def audit_leakage(manifest: DataFrame, used: dict[str, DataFrame], test: str = "test", sample_id: str = "sample_id", code: str | None = None) -> DataFrame:
    """(check, failures): ids outside the test split in each used table, test ids that it lacks, ids or codes in two splits."""
    inside = manifest.where(F.col("split") == test).select(sample_id).distinct()
    parts = [("ids_in_two_splits", manifest.groupBy(sample_id).agg(F.count_distinct("split").alias("n")).where("n > 1"))]
    if code:
        parts.append(("code_in_two_splits", manifest.groupBy(F.sha2(F.coalesce(code, F.lit("")), 256).alias("h")).agg(F.count_distinct("split").alias("n")).where("n > 1")))
    for name, df in used.items():
        parts += [(f"{name}_outside_test", df.select(sample_id).distinct().join(inside, sample_id, "left_anti")), (f"{name}_lacks", inside.join(df.select(sample_id).distinct(), sample_id, "left_anti"))]
    return _counted(parts)


def audit_test_only(manifest: DataFrame, splits: DataFrame, features: DataFrame, scores: DataFrame, sample_id: str = "sample_id", static: str = "static_features") -> DataFrame:
    """(check, failures): the seven checks of an evaluation on the test split alone.

    manifest, features (label and a map of static features) and scores (rank) are what the evaluation uses, splits the whole
    manifest. All rows are looked at for features that repeat the label under a name that ends in `label`.
    """
    m, f, s = (x.select(sample_id).distinct() for x in (manifest, features, scores))
    apart = lambda a, b: a.join(b, sample_id, "left_anti")
    outside = splits.where(F.col("split").isin("train", "valid")).select(sample_id).distinct()
    labels = features.select(sample_id, F.col("label").alias("a")).join(manifest.select(sample_id, F.col("label").alias("b")), sample_id, "left")
    entries = features.select("label", F.explode(static).alias("k", "v")) if static in features.columns else features.select("label", F.lit("").alias("k"), F.lit("").alias("v")).limit(0)
    n, pos = scores.count(), manifest.agg(F.count_if(F.col("label") == 1)).first()[0]
    total = manifest.count()
    gaps = n - scores.where(F.col("rank").between(1, n)).select("rank").distinct().count()
    counted = _counted([
        ("split_filtered", manifest.where(~F.col("split").eqNullSafe(F.lit("test")))),
        ("train_or_valid_scored", scores.join(outside, sample_id, "left_semi")),
        ("id_sets_differ", apart(m, f).union(apart(f, m)).union(apart(m, s)).union(apart(s, m)).distinct()),
        ("label_mismatch", labels.where(~F.col("a").eqNullSafe(F.col("b")))),
        ("label_as_feature", entries.where(F.lower("k").endswith("label") & F.coalesce(F.col("v").cast("string").try_cast("double") == F.col("label"), F.lit(False)))),
    ])
    rest = manifest.sparkSession.createDataFrame([("rank_gaps", gaps), ("one_class", int(not 0 < pos < total))], "check string, failures long")
    return counted.union(rest)


def audit_features(features: DataFrame, manifest: DataFrame, code: str = "function_code", sample_id: str = "sample_id") -> DataFrame:
    """(check, failures): manifest ids without features, extra ones, repeated ones, empty code."""
    parts = [
        ("missing", manifest.join(features, sample_id, "left_anti")), ("extra", features.join(manifest, sample_id, "left_anti")),
        ("repeated", features.groupBy(sample_id).count().where("count > 1")), ("empty_code", features.where(F.coalesce(F.trim(F.col(code)), F.lit("")) == "")),
    ]
    return _counted(parts)


def readiness(samples: DataFrame, code: str = "code", least: int = 20, sample_id: str = "sample_id", kind: str | None = None) -> DataFrame:
    """(check, ok): unique ids, both classes, code present, enough rows; with kind, rows that keep its schema's checks, too."""
    have = samples
    extra = {}
    if kind is not None:
        have = validate(samples, kind)
        extra = {"schema": F.col("bad") == 0}
    bad = F.count_if(~F.col("valid")) if kind is not None else F.lit(0)
    a = have.agg(F.count("*").alias("n"), F.count_distinct(sample_id).alias("ids"), F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.coalesce(F.col(code), F.lit("")) != "").alias("code"), bad.alias("bad"))
    tests = {"unique_ids": F.col("n") == F.col("ids"), "both_classes": (F.col("pos") > 0) & (F.col("neg") > 0), "code_located": F.col("code") == F.col("n"), "enough_rows": F.col("n") >= least} | extra
    return a.select(F.explode(F.create_map(*[x for k, v in tests.items() for x in (F.lit(k), v)])).alias("check", "ok"))


#: What looks like a key, a token or a password.
SECRETS = (r"sk-[A-Za-z0-9]{20,}", r"AKIA[0-9A-Z]{16}", r"(?i:api[_-]?key)\s*[:=]\s*\S{12,}", r"ghp_[A-Za-z0-9]{36}", r"(?i:password)\s*=\s*[\"'][^\"']+[\"']")


def secrets(df: DataFrame, *cols: str, pattern: str = "(" + "|".join(SECRETS) + ")") -> DataFrame:
    """Rows with something like a key in one of the columns."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return df.where(bad)


#: Beyond the fixed ones: a quoted hexadecimal token.
QUOTED_TOKEN = r"(?i:token)\s*[:=]\s*[\"'][0-9a-fA-F]{32,}[\"']"


def secret_counts(df: DataFrame, text: str, patterns: Sequence[str] = (*SECRETS, QUOTED_TOKEN)) -> DataFrame:
    """df with matches, array<struct(pattern, n)>: the patterns, by number from 0, that the text holds, and how often; rows without any go."""
    found = F.array(*[F.struct(F.lit(i).alias("pattern"), F.regexp_count(text, F.lit(p)).alias("n")) for i, p in enumerate(patterns)])
    return df.withColumn("matches", F.filter(found, lambda m: m["n"] > 0)).where(F.size("matches") > 0)


def verdict_distribution(verdicts: DataFrame, *keys: str) -> DataFrame:
    """(keys, vulnerable, benign, uncertain): verdicts of each group."""
    return verdicts.groupBy(*keys).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])


def verify_release(tables: dict[str, tuple[DataFrame, int]], verdicts: DataFrame | None = None, expected: DataFrame | None = None, keys: Sequence[str] = (), texts: DataFrame | None = None) -> DataFrame:
    """(check, ok) of a release: least rows of each table, the verdicts' distribution as expected (keys and counts), and no secrets
    in its texts (column text)."""
    out = [(f"rows_{name}", df.agg((F.count("*") >= least).alias("ok"))) for name, (df, least) in tables.items()]
    if verdicts is not None and expected is not None:
        seen = verdict_distribution(verdicts, *keys).select(*keys, *VERDICTS)
        want = expected.select(*keys, *VERDICTS)
        out.append(("verdict_distribution", seen.exceptAll(want).union(want.exceptAll(seen)).agg((F.count("*") == 0).alias("ok"))))
    if texts is not None:
        out.append(("no_secrets", secrets(texts, "text").agg((F.count("*") == 0).alias("ok"))))
    found = None
    for name, df in out:
        one = df.select(F.lit(name).alias("check"), "ok")
        found = one if found is None else found.union(one)
    return found
