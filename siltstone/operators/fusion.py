"""Late fusion of static, ranker and verifier signals into localised findings, and reports of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.normalize import unknown_cwe
from siltstone.functions.scores import FUSION_WEIGHTS, LINE_WEIGHTS, alert_lines, final_score, graph_lines, label_of, line_scores, static_score, top_lines, trace_lines, verdict_score
from siltstone.operators.alerts import cwe_mode, grouped, static_scores
from siltstone.operators.relational import last_wins

_VERDICT = ("verdict", "confidence", "predicted_cwe", "vulnerable_lines", "evidence", "need_more_context", "missing_context", "patch_hint")


def join_signals(features: DataFrame, ranks: DataFrame, alerts: DataFrame, verdicts: DataFrame, order: str = "ord") -> DataFrame:
    """features with rank_score, alerts (array), alert_cwe and verdict (struct); all left joins, the last row of a key wins.

    The right sides are reduced to a row a key first, so each is one co-partitioned join on sample_id.
    """
    r = last_wins(ranks.select("sample_id", "rank_score", order), "sample_id", order).select("sample_id", "rank_score")
    v = verdicts.select("sample_id", order, F.struct(*[c for c in _VERDICT if c in verdicts.columns]).alias("v"))
    v = v.groupBy("sample_id").agg(F.max_by("v", F.col(order)).alias("v"))
    a = grouped(alerts, order)
    m = cwe_mode(alerts).select("sample_id", F.col("cwe").alias("alert_cwe"))
    out = features.join(r, "sample_id", "left").join(a, "sample_id", "left").join(m, "sample_id", "left").join(v, "sample_id", "left")
    return out.withColumn("rank_score", F.coalesce("rank_score", F.lit(0.0)))


def signals(samples: DataFrame, ranks: DataFrame, alerts: DataFrame, verdicts: DataFrame, threshold: float = 0.5, order: str = "ord") -> DataFrame:
    """(sample_id, label, rank_score, static_score, llm_score, final_score, final_label): the scores alone, without lines or evidence.

    Alerts are aggregated to a number a sample before the join, so no row holds them.
    """
    r = ranks.groupBy("sample_id").agg(F.max_by("rank_score", order).alias("rank_score"))
    v = verdicts.groupBy("sample_id").agg(F.max_by(F.struct("verdict", "confidence"), order).alias("v"))
    j = samples.select("sample_id", "label").join(r, "sample_id", "left").join(static_scores(alerts), "sample_id", "left").join(v, "sample_id", "left")
    j = j.select("sample_id", "label", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("rank_score", "static_score")], verdict_score(F.col("v.verdict"), F.col("v.confidence")).alias("llm_score"))
    j = j.withColumn("final_score", final_score(F.col("static_score"), F.col("rank_score"), F.col("llm_score")))
    return j.withColumn("final_label", label_of(F.col("final_score"), threshold))


def fuse(joined: DataFrame, threshold: float = 0.5, weights: dict[str, Column | float] | None = None, k: int = 5) -> DataFrame:
    """joined with static_score, llm_score, final_score, final_label, predicted_cwe, line_scores, vulnerable_lines, patch_hint."""
    none = F.array().cast("array<int>")
    alerts = F.coalesce("alerts", F.expr("slice(alerts, 1, 0)"))
    nodes = graph_lines(F.col("nodes")) if "nodes" in joined.columns else none
    own = lambda c: F.coalesce(F.col(c), none) if c in joined.columns else none
    voted = F.coalesce("v.vulnerable_lines", none)
    at = F.array_union(F.coalesce(alert_lines(alerts), none), own("alert_lines"))
    tr = F.array_union(F.coalesce(trace_lines(alerts), none), own("trace_lines"))
    cwe = F.coalesce(F.when(~unknown_cwe(F.col("v.predicted_cwe")), F.col("v.predicted_cwe")), F.col("alert_cwe"), F.get("cwe", F.lit(0)), F.lit("unknown"))
    out = joined.withColumns({"static_score": static_score(F.col("alerts")), "llm_score": verdict_score(F.col("v.verdict"), F.col("v.confidence")), "line_scores": line_scores(at, tr, voted, F.coalesce(nodes, none)), "predicted_cwe": cwe})
    out = out.withColumn("final_score", final_score(F.col("static_score"), F.col("rank_score"), F.col("llm_score"), weights))
    hint = F.coalesce("v.patch_hint", F.lit("")) if "patch_hint" in joined.schema["v"].dataType.names else F.lit("")
    return out.withColumns({"final_label": label_of(F.col("final_score"), threshold), "vulnerable_lines": top_lines(F.col("line_scores"), k), "patch_hint": hint})


def _json(c: Column) -> Column:
    """JSON that keeps null fields."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def evidence(fused: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """fused with evidence: JSON array of alerts, trace lines, verdict, rank score, fusion and line scores, as far as present."""
    w = weights or FUSION_WEIGHTS
    kind = lambda name, *cols: _json(F.struct(F.lit(name).alias("kind"), *cols))
    fields = ("tool", "query_id", "severity", "message", "file", "start_line", "end_line", "cwe")
    have = fused.schema["alerts"].dataType.elementType.names
    each = F.transform(F.coalesce("alerts", F.expr("slice(alerts, 1, 0)")), lambda a: kind("static_alert", *[a[f].alias(f) for f in fields if f in have]))
    lines = trace_lines(F.col("alerts"))
    v = F.col("v")
    scores = F.map_from_entries(F.transform("line_scores", lambda x: F.struct(x["line"].cast("string"), x["score"])))
    parts = F.concat(
        F.coalesce(each, F.array().cast("array<string>")),
        F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.array(kind("trace_lines", lines.alias("lines")))).otherwise(F.array().cast("array<string>")),
        F.when(v.isNotNull(), F.array(kind("llm_verdict", v["verdict"].alias("verdict"), v["confidence"].alias("confidence"), v["predicted_cwe"].alias("predicted_cwe"), v["vulnerable_lines"].alias("vulnerable_lines")))).otherwise(F.array().cast("array<string>")),
        F.array(
            kind("rank_score", F.col("rank_score").alias("value")),
            kind("fusion_scores", "static_score", "rank_score", "llm_score", "final_score", F.struct(*[F.lit(x).alias(n) for n, x in w.items()]).alias("weights")),
            kind("line_scores", scores.alias("scores")),
        ),
    )
    return fused.withColumn("evidence", F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")))


def findings(fused: DataFrame) -> DataFrame:
    return evidence(fused).select("sample_id", "final_label", F.col("final_score").alias("final_confidence"), "predicted_cwe", "vulnerable_lines", "evidence", "patch_hint")


def scored_lines(alerts: DataFrame, verdicts: DataFrame, flags: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(sample_id, line, score): the risk of every line that a signal names, capped at 1, without an array a sample.

    verdicts: a row a sample. flags: (sample_id, line) of flagged graph nodes. Lines are exploded, and of each line only
    which kinds name it is aggregated, partially before the shuffle.
    """
    w = weights or LINE_WEIGHTS
    kinds = {
        "static_alert_line": alerts.where("end_line >= start_line").select("sample_id", F.explode(F.sequence("start_line", "end_line")).alias("line")),
        "trace_line": alerts.select("sample_id", F.explode("trace_lines").alias("line")),
        "llm_vote": verdicts.select("sample_id", F.explode("vulnerable_lines").alias("line")),
    } | ({"graph_flag": flags.select("sample_id", "line")} if flags is not None else {})
    rows = None
    for k, df in kinds.items():
        one = df.withColumn("kind", F.lit(k))
        rows = one if rows is None else rows.union(one)
    has = {k: F.max((F.col("kind") == k).cast("int")) for k in kinds}
    seen = rows.where("line is not null").groupBy("sample_id", "line").agg(*[c.alias(k) for k, c in has.items()])
    total = F.lit(0.0)
    for k in kinds:
        total = total + F.when(F.col(k) == 1, F.lit(w[k])).otherwise(0.0)
    return seen.select("sample_id", "line", F.least(F.lit(1.0), total).alias("score"))


def best_lines(scored: DataFrame, k: int = 5) -> DataFrame:
    """(sample_id, vulnerable_lines): each sample's k lines with the highest scores, smaller lines first among equals."""
    order = W.partitionBy("sample_id").orderBy(F.col("score").desc(), "line")
    few = scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return few.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]).alias("vulnerable_lines"))


def report(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, rows) of a findings report: total and vulnerable_count, one row; and a row a finding, its JSON by sample_id.

    write_report puts them into one file; no row holds them all.
    """
    totals = found.agg(F.count("*").alias("total"), F.count_if(F.col("final_label") == 1).alias("vulnerable_count"))
    return totals, found.select("sample_id", _json(F.struct(*[F.col(c) for c in found.columns])).alias("json"))


def sarif(found: DataFrame, features: DataFrame, tool: str = "siltstone", order: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """(rules, results) of SARIF 2.1.0: rules (ord, rule) in the order in which they first occur; results (ord, json), a row a finding
    with label 1. A sample's file is the first by order in features; order is a column of both."""
    by = F.col(order) if order in features.columns else F.col("sample_id")
    files = features.groupBy("sample_id").agg(F.min_by("file", by).alias("uri"))
    f = found.where("final_label = 1").join(files, "sample_id", "left").withColumn("uri", F.coalesce("uri", F.col("sample_id").cast("string")))
    rule = F.when(unknown_cwe(F.col("predicted_cwe")), F.lit(tool)).otherwise(F.col("predicted_cwe"))
    line = F.coalesce(F.get("vulnerable_lines", F.lit(0)), F.lit(1))
    place = F.array(F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation")))
    text = F.format_string("Potential vulnerability (%s) with confidence %.2f", rule, "final_confidence")
    result = F.struct(rule.alias("ruleId"), F.lit("warning").alias("level"), F.struct(text.alias("text")).alias("message"), place.alias("locations"))
    r = f.select(F.col(order).alias("ord"), rule.alias("rule"), F.to_json(result).alias("json"))
    return r.groupBy("rule").agg(F.min("ord").alias("ord")).select("ord", "rule"), r.select("ord", "json")
