"""The driver's tables in the roles of samples, alerts, ranks, verdicts, costs and graphs, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(q, "doc_id", "left").selectExpr("doc_id AS sample_id", "text AS code", "lang AS language", "source AS repo", "CASE WHEN doc_id % 9 = 0 THEN array('CWE-20') ELSE CAST(array() AS array<string>) END AS cwe", "coalesce(quality, 0) AS label", "doc_id AS ord")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "CAST(get_json_object(props, '$.k') AS int) % 40 + 1 AS s")
    return e.selectExpr(
        "event_id div 25 AS sample_id", "CASE WHEN event_id % 3 = 0 THEN 'codeql' ELSE 'lint' END AS tool", "event_type AS query_id", "event_type AS message",
        "CASE event_type WHEN 'error' THEN 'Error ' WHEN 'click' THEN 'warning' WHEN 'signup' THEN 'note' WHEN 'view' THEN 'moderate' END AS severity",
        "concat('src/f', event_id % 10, '.c') AS file", "s AS start_line", "CAST(s + event_id % 4 AS int) AS end_line",
        "CASE event_id % 5 WHEN 0 THEN array('CWE-119', 'unknown') WHEN 1 THEN array('CWE-787') WHEN 2 THEN array('CWE-416', 'CWE-119') ELSE CAST(array() AS array<string>) END AS cwe",
        "CASE WHEN event_id % 7 = 0 THEN array(s, s + 2) ELSE CAST(array() AS array<int>) END AS trace_lines", "event_id AS ord",
    )


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).selectExpr("sample_id", "((sample_id * 7919) % 1000) / 1000.0D AS rank_score", "label", "ord")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS sample_id", "CASE doc_id % 3 WHEN 0 THEN 'vulnerable' WHEN 1 THEN 'benign' ELSE 'uncertain' END AS verdict", "(doc_id % 101) / 100.0D AS confidence",
        "CASE doc_id % 5 WHEN 0 THEN 'CWE-787' WHEN 1 THEN 'unknown' ELSE '' END AS predicted_cwe", "array(CAST(1 + doc_id % 7 AS int), CAST(3 + doc_id % 11 AS int)) AS vulnerable_lines", "'' AS patch_hint", "doc_id AS ord",
    )


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "value", "CAST(get_json_object(props, '$.k') AS bigint) AS k")
    return e.selectExpr(
        "event_id AS sample_id", "CASE WHEN event_id % 6 <> 0 THEN k END AS prompt_tokens", "CASE WHEN event_id % 4 <> 0 THEN k * 2 END AS completion_tokens", "CASE WHEN event_id % 2 <> 0 THEN k * 3 END AS total_tokens",
        "CASE WHEN event_id % 9 <> 0 THEN value END AS latency_seconds", "CASE WHEN event_id % 5 <> 0 THEN value / 1000.0D END AS api_cost_usd",
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id % 5 + conv_id div 1000 * 5 AS graph_id", "conv_id * 100 + turn AS id", "conv_id * 100 + turn AS ord", "role AS type", "text AS code", "concat('src/f', conv_id % 3, '.c') AS file",
        "CAST(turn + 1 + conv_id % 7 AS int) AS line", "concat('fn', conv_id % 4) AS function",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    own = c.selectExpr("conv_id % 5 + conv_id div 1000 * 5 AS graph_id", "conv_id * 100 + turn AS ord", "conv_id * 100 + turn AS source", "conv_id * 100 + turn + 1 AS target", "CASE WHEN turn % 2 = 0 THEN 'CFG' ELSE 'DDG' END AS type")
    cross = c.where("turn = 0").selectExpr("conv_id % 5 + conv_id div 1000 * 5", "1000000 + conv_id", "conv_id * 100", "(conv_id + 5) * 100", "'CALL'")
    return own.union(cross)


#: The same as common table expressions.
SQL = {
    "samples": "SELECT d.doc_id AS sample_id, d.text AS code, d.lang AS language, d.source AS repo, CASE WHEN d.doc_id % 9 = 0 THEN ['CWE-20'] ELSE CAST([] AS VARCHAR[]) END AS cwe, coalesce(l.quality, 0) AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "alerts": """SELECT event_id // 25 AS sample_id, CASE WHEN event_id % 3 = 0 THEN 'codeql' ELSE 'lint' END AS tool, event_type AS query_id,
  CASE event_type WHEN 'error' THEN 'Error ' WHEN 'click' THEN 'warning' WHEN 'signup' THEN 'note' WHEN 'view' THEN 'moderate' END AS severity, 'src/f' || (event_id % 10) || '.c' AS file,
  s AS start_line, CAST(s + event_id % 4 AS INT) AS end_line,
  CASE event_id % 5 WHEN 0 THEN ['CWE-119', 'unknown'] WHEN 1 THEN ['CWE-787'] WHEN 2 THEN ['CWE-416', 'CWE-119'] ELSE CAST([] AS VARCHAR[]) END AS cwe,
  CASE WHEN event_id % 7 = 0 THEN [s, s + 2] ELSE CAST([] AS INT[]) END AS trace_lines, event_id AS ord
  FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) % 40 + 1 AS s FROM events)""",
    "ranks": "SELECT sample_id, CAST((sample_id * 7919) % 1000 AS DOUBLE) / 1000 AS rank_score, label FROM samples",
    "verdicts": """SELECT doc_id AS sample_id, CASE doc_id % 3 WHEN 0 THEN 'vulnerable' WHEN 1 THEN 'benign' ELSE 'uncertain' END AS verdict, CAST(doc_id % 101 AS DOUBLE) / 100 AS confidence,
  CASE doc_id % 5 WHEN 0 THEN 'CWE-787' WHEN 1 THEN 'unknown' ELSE '' END AS predicted_cwe, [CAST(1 + doc_id % 7 AS INT), CAST(3 + doc_id % 11 AS INT)] AS vulnerable_lines FROM documents""",
    "costs": """SELECT CASE WHEN event_id % 6 <> 0 THEN k END AS prompt_tokens, CASE WHEN event_id % 4 <> 0 THEN k * 2 END AS completion_tokens, CASE WHEN event_id % 2 <> 0 THEN k * 3 END AS total_tokens,
  CASE WHEN event_id % 9 <> 0 THEN value END AS latency_seconds, CASE WHEN event_id % 5 <> 0 THEN value / 1000 END AS api_cost_usd FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "nodes": "SELECT conv_id % 5 + conv_id // 1000 * 5 AS graph_id, conv_id * 100 + turn AS id, role AS type, text AS code, 'src/f' || (conv_id % 3) || '.c' AS file, CAST(turn + 1 + conv_id % 7 AS INT) AS line, 'fn' || (conv_id % 4) AS function FROM conversations",
    "edges": """SELECT conv_id % 5 + conv_id // 1000 * 5 AS graph_id, conv_id * 100 + turn AS ord, conv_id * 100 + turn AS source, conv_id * 100 + turn + 1 AS target, CASE WHEN turn % 2 = 0 THEN 'CFG' ELSE 'DDG' END AS type FROM conversations
  UNION ALL SELECT conv_id % 5 + conv_id // 1000 * 5, 1000000 + conv_id, conv_id * 100, (conv_id + 5) * 100, 'CALL' FROM conversations WHERE turn = 0""",
    "ranked": "SELECT *, row_number() OVER (ORDER BY rank_score DESC, sample_id) AS rank FROM ranks",
    "static_scores": """SELECT sample_id, least(1.0, sum(CAST(0.4 AS DOUBLE) * CASE WHEN lower(trim(severity)) IN ('high', 'error', 'critical') THEN CAST(1.0 AS DOUBLE) WHEN lower(trim(severity)) IN ('medium', 'warning', 'moderate') THEN CAST(0.7 AS DOUBLE)
  WHEN lower(trim(severity)) IN ('low', 'note', 'recommendation') THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END) + CASE WHEN max(len(trace_lines)) > 0 THEN 0.15 ELSE 0 END) AS static_score FROM alerts GROUP BY sample_id""",
    "llm_scores": """SELECT sample_id, CASE verdict WHEN 'vulnerable' THEN confidence WHEN 'benign' THEN least(CAST(0.3 AS DOUBLE), 1 - confidence) ELSE CASE WHEN 0.5 * confidence > 0 THEN least(CAST(0.3 AS DOUBLE), CAST(0.5 AS DOUBLE) * confidence) ELSE CAST(0.3 AS DOUBLE) END END AS llm_score FROM verdicts""",
    "scored": "SELECT r.sample_id, r.label, r.rank, r.rank_score, coalesce(s.static_score, 0) AS static_score, coalesce(l.llm_score, 0) AS llm_score FROM ranked r LEFT JOIN static_scores s USING (sample_id) LEFT JOIN llm_scores l USING (sample_id)",
}
_NEEDS = {"ranks": ["samples"], "ranked": ["ranks"], "static_scores": ["alerts"], "llm_scores": ["verdicts"], "scored": ["ranked", "static_scores", "llm_scores"]}


def with_(*names: str, recursive: bool = False) -> str:
    """WITH clause of these expressions and what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({SQL[n]})" for n in order)
