"""Risk scores of the three signals and of lines. Sums run in a fixed order, so results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.lines import covered, flagged, merged, union_of
from siltstone.functions.normalize import clamp, severity_weight

# Weights of the signals, of an alert and of a line.
FUSION_WEIGHTS = {"static": 0.25, "ranker": 0.45, "llm": 0.30}
LINE_WEIGHTS = {"static_alert_line": 0.35, "trace_line": 0.20, "llm_vote": 0.35, "graph_flag": 0.10}
ALERT_BASE, TRACE_BONUS, LOW_CAP = 0.4, 0.15, 0.3


def static_score(alerts: Column) -> Column:
    """Of an ordered array of alerts (severity, trace_lines); null or empty gives 0."""
    total = F.aggregate(alerts, F.lit(0.0), lambda s, a: s + F.lit(ALERT_BASE) * severity_weight(a["severity"]))
    bonus = F.when(F.exists(alerts, lambda a: F.coalesce(F.size(a["trace_lines"]), F.lit(0)) > 0), F.lit(TRACE_BONUS)).otherwise(0.0)
    return F.when(F.coalesce(F.size(alerts), F.lit(0)) <= 0, 0.0).otherwise(clamp(total + bonus))


def verdict_score(verdict: Column, confidence: Column) -> Column:
    """vulnerable: the confidence; benign: what is left of it, capped; uncertain: half, capped, never 0; none: 0."""
    half = F.lit(0.5) * confidence
    uncertain = F.when(half > 0, F.least(F.lit(LOW_CAP), half)).otherwise(LOW_CAP)
    return F.when(verdict.isNull(), 0.0).when(verdict == "vulnerable", clamp(confidence)).when(verdict == "benign", clamp(F.least(F.lit(LOW_CAP), 1.0 - confidence))).otherwise(clamp(uncertain))


def final_score(static: Column, rank: Column, verdict: Column, weights: dict[str, Column | float] | None = None) -> Column:
    w = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in (weights or FUSION_WEIGHTS).items()}
    return clamp(w["static"] * static + w["ranker"] * rank + w["llm"] * verdict)


def label_of(score: Column, threshold: float = 0.5) -> Column:
    return (score >= threshold).cast("int")


def alert_lines(alerts: Column) -> Column:
    return union_of(F.transform(alerts, lambda a: covered(a["start_line"], a["end_line"])))


def trace_lines(alerts: Column) -> Column:
    return union_of(F.transform(alerts, lambda a: F.coalesce(a["trace_lines"], F.array().cast("array<int>"))))


def line_scores(alert: Column, trace: Column, voted: Column, graph: Column, weights: dict[str, float] | None = None) -> Column:
    """array<struct(line, score)> by line, from four line sets; scores are capped at 1."""
    w = weights or LINE_WEIGHTS
    sets = ((alert, "static_alert_line"), (trace, "trace_line"), (voted, "llm_vote"), (graph, "graph_flag"))

    def score(line: Column) -> Column:
        total = F.lit(0.0)
        for lines, name in sets:
            total = total + F.when(F.array_contains(F.coalesce(lines, F.array().cast("array<int>")), line), F.lit(w[name])).otherwise(0.0)
        return F.least(F.lit(1.0), total)

    return F.transform(merged(alert, trace, voted, graph), lambda x: F.struct(x.alias("line"), score(x).alias("score")))


def top_lines(scored: Column, k: int = 5) -> Column:
    """Lines with the highest scores, smaller lines first among equals."""
    if k <= 0:
        return F.array().cast("array<int>")
    keyed = F.array_sort(F.transform(scored, lambda x: F.struct((-x["score"]).alias("s"), x["line"].alias("line"))))
    return F.transform(F.slice(keyed, 1, k), lambda x: x["line"])


def graph_lines(nodes: Column) -> Column:
    return flagged(nodes)
