"""Record schemas and their row checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<file:string,start_line:int,end_line:int>"
SAMPLE = f"sample_id string, dataset string, language string, repo string, commit_before string, commit_after string, file string, function string, span {SPAN}, label int, cwe array<string>, split string"
ALERT = "sample_id string, tool string, query_id string, message string, severity string, file string, start_line int, end_line int, cwe array<string>, trace_lines array<int>, raw string"
VERDICT = "sample_id string, verdict string, confidence double, predicted_cwe string, vulnerable_lines array<int>, evidence string, need_more_context boolean, missing_context array<string>, patch_hint string"
FINDING = "sample_id string, final_label int, final_confidence double, predicted_cwe string, vulnerable_lines array<int>, evidence string, patch_hint string"
NODE = "struct<node_id:string,node_type:string,code:string,line:int,line_index:int,static_flags:map<string,double>>"
EDGE = "struct<source:int,target:int,edge_type:string>"
FEATURE = f"sample_id string, label int, cwe array<string>, file string, function string, span {SPAN}, function_code string, code_lines array<string>, alert_lines array<int>, trace_lines array<int>, nodes array<{NODE}>, edges array<{EDGE}>, static_features map<string,string>, metadata map<string,string>"
RANK = "sample_id string, rank_score double, rank int, label int, metadata map<string,string>"
COST = "sample_id string, model string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, latency_seconds double, success boolean, api_cost_usd double, error_type string"
_ALERT_FIELDS = ",".join(x.replace(" ", ":", 1) for x in ALERT.split(", "))
PACKET = f"sample_id string, language string, function_code string, span {SPAN}, static_alerts array<struct<{_ALERT_FIELDS}>>, graph_evidence string, context map<string,string>"

VERDICTS = ("vulnerable", "benign", "uncertain")


def _no(c: Column) -> Column:
    """True where a check is not known to hold."""
    return ~F.coalesce(c, F.lit(False))


def _span(s: Column) -> dict[str, Column]:
    return {"span_order": _no(s["end_line"] >= s["start_line"]), "span_first": _no((s["start_line"] >= 1) & (s["end_line"] >= 1))}


def _lines_ok(c: Column) -> Column:
    return F.forall(F.coalesce(c, F.array().cast("array<int>")), lambda x: x >= 1)


def checks(kind: str) -> dict[str, Column]:
    """Reason to condition that a row breaks it."""
    c = F.col
    if kind == "sample":
        need = {f"missing_{k}": c(k).isNull() for k in ("sample_id", "dataset", "language", "file", "span", "label")}
        return need | {"label": _no(c("label").isin(0, 1)), "split": _no(c("split").isin("train", "valid", "test", "unknown"))} | _span(c("span"))
    if kind == "alert":
        need = {f"missing_{k}": c(k).isNull() for k in ("sample_id", "tool", "query_id", "message", "file")}
        own = F.struct("start_line", "end_line")
        return need | _span(own) | {"trace_lines": _no(_lines_ok(c("trace_lines")))}
    if kind == "verdict":
        need = {f"missing_{k}": c(k).isNull() for k in ("sample_id", "verdict", "confidence")}
        return need | {"verdict": _no(c("verdict").isin(*VERDICTS)), "confidence": _no(c("confidence").between(0, 1)), "vulnerable_lines": _no(_lines_ok(c("vulnerable_lines")))}
    if kind == "finding":
        need = {f"missing_{k}": c(k).isNull() for k in ("sample_id", "final_label", "final_confidence")}
        return need | {"final_label": _no(c("final_label").isin(0, 1)), "final_confidence": _no(c("final_confidence").between(0, 1)), "vulnerable_lines": _no(_lines_ok(c("vulnerable_lines")))}
    raise ValueError(f"unknown record kind {kind!r}")


def validate(df: DataFrame, kind: str, strict: bool = False) -> DataFrame:
    """df with valid and reasons; strict raises at the first bad row. Languages of samples are lower-cased."""
    if kind == "sample":
        df = df.withColumn("language", F.lower("language"))
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks(kind).items()]))
    out = df.withColumn("reasons", broken).withColumn("valid", F.size("reasons") == 0)
    if strict:
        out = out.withColumn("valid", F.when(F.col("valid"), True).otherwise(F.raise_error(F.concat(F.lit(f"bad {kind} row: "), F.array_join("reasons", ",")))))
    return out
