"""Registered queries of the library's operators on the driver's tables, each with the same result in SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import lines as L
from siltstone.functions import normalize as N
from siltstone.functions import scores as S
from siltstone.functions import text as T
from siltstone.functions.vectors import node_vector
from siltstone.operators import alerts as A
from siltstone.operators import evaluation as E
from siltstone.operators import experiments as X
from siltstone.operators import fusion as U
from siltstone.operators import graph as G
from siltstone.operators import ranker as K
from siltstone.operators import relational as R
from siltstone.operators import verify as V
from siltstone.plans import proxies as P
from siltstone.plans import triage as T3
from siltstone.plans.proxies import table, with_

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KS = (10, 30, 50)

# Patterns as the SQL side writes them.
_TOKEN = r"[A-Za-z_][\p{L}\p{N}_]*|\p{Nd}+|[^\p{L}\p{N}_\s\x1c-\x1f\x{85}\p{Z}]"
_NAME = r"[A-Za-z_][\p{L}\p{N}_]*"
_LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_STRIP = r"^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison between engines; the operators themselves do not round."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- scalar functions ----------------------------------------------------------------------------------------------


@register("stable_id", "SELECT doc_id, substr(sha1(coalesce(source, '') || chr(0) || coalesce(text, '')), 1, 16) AS stable_id FROM documents")
def stable_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", N.stable_id(F.col("source"), F.col("text")).alias("stable_id"))


_RAW = "CASE event_id % 10 WHEN 0 THEN 'True ' WHEN 1 THEN 'no' WHEN 2 THEN '2' WHEN 3 THEN '0.5' WHEN 4 THEN 'abc' WHEN 5 THEN '' WHEN 6 THEN '-3' WHEN 7 THEN '1e2' WHEN 8 THEN ' VUL' END"


@register("coerce_labels", f"""SELECT event_id, CASE WHEN t IN ('1', 'true', 'vulnerable', 'vul', 'yes', 'bad') THEN 1 WHEN t IN ('0', 'false', 'benign', 'safe', 'no', 'good', '') THEN 0
  WHEN abs(TRY_CAST(t AS DOUBLE)) >= 1 THEN 1 ELSE 0 END AS label FROM (SELECT event_id, lower(trim({_RAW})) AS t FROM events)""")
def coerce_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", N.coerce_label(F.expr(_RAW)).alias("label"))


_CWES = "CASE event_id % 6 WHEN 0 THEN 'CWE-79' WHEN 1 THEN ' CWE-1, CWE-2 ;' WHEN 2 THEN '' WHEN 3 THEN 'CWE-3;CWE-4' WHEN 4 THEN ' ,' END"


@register("coerce_cwe", f"SELECT event_id, array_to_string(list_filter(list_transform(string_split_regex(coalesce({_CWES}, ''), '[,;]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS cwe FROM events")
def coerce_cwe(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.array_join(N.coerce_cwe(F.expr(_CWES)), "|").alias("cwe"))


_NAMES = "CASE event_id % 8 WHEN 0 THEN 'Training' WHEN 1 THEN ' val ' WHEN 2 THEN 'dev' WHEN 3 THEN 'test' WHEN 4 THEN 'holdout' WHEN 5 THEN 'EVAL' WHEN 6 THEN 'train' END"


@register("split_alias", f"""SELECT event_id, CASE WHEN t IN ('train', 'training') THEN 'train' WHEN t IN ('valid', 'validation', 'val', 'dev') THEN 'valid' WHEN t IN ('test', 'testing', 'eval') THEN 'test' ELSE 'unknown' END AS split
  FROM (SELECT event_id, lower(trim({_NAMES})) AS t FROM events)""")
def split_alias(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", N.split_name(F.expr(_NAMES)).alias("split"))


@register("severity_scores", with_("alerts") + """ SELECT ord, CASE WHEN t IN ('error', 'high', 'critical') THEN 3 WHEN t IN ('warning', 'medium') THEN 2 WHEN t IN ('note', 'low', 'recommendation', 'info') THEN 1 ELSE 0 END AS severity_rank,
  CAST(CASE WHEN t IN ('high', 'error', 'critical') THEN 1.0 WHEN t IN ('medium', 'warning', 'moderate') THEN 0.7 WHEN t IN ('low', 'note', 'recommendation') THEN 0.4 ELSE 0.3 END AS DOUBLE) AS severity_weight FROM (SELECT ord, lower(trim(severity)) AS t FROM alerts)""")
def severity_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("severity")
    return P.alerts(spark, sf).select("ord", N.severity_rank(s).alias("severity_rank"), N.severity_weight(s).alias("severity_weight"))


@register("url_paths", """SELECT page_id, regexp_extract(replace(url, '\\', '/'), '([^/]*)$', 1) AS base, p = 'example.com/en' OR ends_with(p, '/example.com/en') OR ends_with('example.com/en', '/' || p) AS matches
  FROM (SELECT page_id, url, regexp_replace(replace(regexp_replace(url, '^[a-z]+:', ''), '\\', '/'), '^/+', '') AS p FROM pages)""")
def url_paths(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", N.basename(u).alias("base"), N.paths_match(F.regexp_replace(u, "^[a-z]+:", ""), F.lit("example.com/en")).alias("matches"))


@register("line_masks", with_("alerts") + """ SELECT ord, array_to_string(list_transform(generate_series(CAST(start_line AS BIGINT), CAST(end_line + 2 AS BIGINT)), lambda x: CASE WHEN list_contains(trace_lines, CAST(x AS INT)) THEN 1 ELSE 0 END), '') AS mask,
  CASE WHEN 20 BETWEEN start_line AND end_line THEN 20 - start_line + 1 END AS relative FROM alerts""")
def line_masks(spark: SparkSession, sf: str) -> DataFrame:
    a = P.alerts(spark, sf)
    s, e = F.col("start_line"), F.col("end_line")
    return a.select("ord", F.array_join(F.transform(L.mask(F.col("trace_lines"), s, e + 2), lambda x: x.cast("string")), "").alias("mask"), L.to_relative(F.lit(20), s, e).alias("relative"))


# -- text ------------------------------------------------------------------------------------------------------------

_METRICS = ", ".join([
    "CAST(CASE WHEN c = '' THEN 0 ELSE length(c) - length(replace(c, chr(10), '')) + 1 END AS DOUBLE) AS line_count", "CAST(length(c) AS DOUBLE) AS char_count", "CAST(len(regexp_extract_all(c, '" + _TOKEN + "')) AS DOUBLE) AS token_count",
    "CAST(len(list_filter(ids, lambda t: list_contains([" + ", ".join(f"'{x}'" for x in T.DANGEROUS_CALLS) + "], t))) AS DOUBLE) AS dangerous_api_count",
    "CAST((length(c) - length(replace(c, '->', ''))) // 2 + length(c) - length(replace(c, '*', '')) + length(c) - length(replace(c, '&', '')) AS DOUBLE) AS pointer_operator_count", "CAST(length(c) - length(replace(c, '[', '')) AS DOUBLE) AS array_access_count",
    "CAST(len(list_filter(ids, lambda t: t = 'for' OR t = 'while')) AS DOUBLE) AS loop_count", "CAST(len(list_filter(ids, lambda t: t = 'if')) AS DOUBLE) AS if_count", "CAST(len(list_filter(ids, lambda t: t = 'return')) AS DOUBLE) AS return_count",
])


@register("code_metrics", f"SELECT doc_id, {_METRICS} FROM (SELECT doc_id, coalesce(text, '') AS c, regexp_extract_all(coalesce(text, ''), '{_NAME}') AS ids FROM documents)")
def code_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", *[v.alias(k) for k, v in T.code_metrics(F.col("text")).items()])


@register("tokenize_counts", f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST(len(list_distinct(t)) AS INT) AS n_kinds FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') AS t FROM documents)")
def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_kinds"))


_SPLIT = f"SELECT doc_id, c, CASE WHEN c = '' THEN [] WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, coalesce(text, '') AS c, string_split_regex(coalesce(text, ''), '{_LINE}') AS l FROM documents)"


@register("line_split_counts", f"SELECT doc_id, CAST(len(l) AS INT) AS n_lines, CAST(length(c) - length(replace(c, chr(10), '')) + 1 AS INT) AS span_lines, coalesce(l[1], '') AS first_line FROM ({_SPLIT})")
def line_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    lines = T.code_lines(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(lines).alias("n_lines"), N.count_lines(F.col("text")).cast("int").alias("span_lines"), F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("first_line"))


@register("truncated_lines", f"""SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE used <= 900), '') AS kept FROM (
  SELECT doc_id, x, i, sum(length(x) + CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l[:8] END) AS x, generate_subscripts(CASE WHEN len(l) = 0 THEN [NULL] ELSE l[:8] END, 1) AS i FROM ({_SPLIT}))) GROUP BY doc_id""")
def truncated_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.truncate_lines(T.code_lines(F.col("text")), 8, 900), "\n").alias("kept"))


_PLAIN = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\n]*', ' ', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'), '{_STRIP}', '', 'g')"


@register("normalized_dedup", f"SELECT min(doc_id) AS doc_id, sha256({_PLAIN}) AS digest FROM documents GROUP BY 2")
def normalized_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return R.deduplicate(table(spark, sf, "documents"), "text", "doc_id").select("doc_id", T.normalized_hash(F.col("text")).alias("digest"))


@register("exact_dedup", "SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS digest FROM documents GROUP BY 2")
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return R.deduplicate(table(spark, sf, "documents"), "text", "doc_id", "exact").select("doc_id", T.exact_hash(F.col("text")).alias("digest"))


@register("reject_stream", """SELECT event_id, CASE WHEN c = '' THEN 'empty_code' WHEN row_number() OVER (PARTITION BY k, c = '' ORDER BY event_id) > 1 THEN 'duplicate_id' END AS reason
  FROM (SELECT event_id, user_id * 10 + event_id % 10 AS k, CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type END AS c FROM events)""")
def reject_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").selectExpr("event_id", "user_id * 10 + event_id % 10 AS k", "CASE WHEN event_id % 13 = 0 THEN ' \n ' ELSE event_type END AS c")
    return R.reject_stream(e, "c", "k", "event_id").select("event_id", "reason")


_SECRETS = (*E.SECRETS, E.QUOTED_TOKEN)


@register("secret_scan", "SELECT doc_id, pattern, n FROM (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS pattern, CAST(len(regexp_extract_all(coalesce(text, ''), '{p.replace(chr(39), chr(39) * 2)}')) AS INT) AS n FROM documents" for i, p in enumerate(_SECRETS)) + ") WHERE n > 0")
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return E.secret_counts(table(spark, sf, "documents"), "text").select("doc_id", F.inline("matches"))


# -- splits and samples ------------------------------------------------------------------------------------------

_SHARE = "CASE WHEN p <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN p <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'valid' ELSE 'test' END AS split"
_HASHED = "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) AS p, count(*) OVER () AS n FROM documents"


@register("hash_split", f"SELECT doc_id, {_SHARE} FROM ({_HASHED})")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return R.random_split(table(spark, sf, "documents"), "doc_id").select("doc_id", "split")


@register("time_split", f"SELECT event_id, {_SHARE} FROM (SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 50 <> 0 THEN ts END NULLS LAST, event_id) AS p, count(*) OVER () AS n FROM events)")
def time_split(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").selectExpr("event_id", "CASE WHEN event_id % 50 <> 0 THEN ts END AS t")
    return R.time_split(e, "t", "event_id").select("event_id", "split")


@register("stratified_split", with_("samples") + """ SELECT sample_id, label, CASE WHEN p <= a THEN 'train' WHEN p <= a + least(b, n - a) THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, round_even(n * CAST(0.7 AS DOUBLE), 0) AS a, round_even(n * CAST(0.1 AS DOUBLE), 0) AS b FROM
  (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(sample_id || ':42'), sample_id) AS p, count(*) OVER (PARTITION BY label) AS n FROM samples))""")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return R.stratified_split(P.samples(spark, sf)).select("sample_id", "label", "split")


@register("stratified_subset", with_("samples") + """ SELECT sample_id, label FROM (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(sample_id || ':42'), sample_id) AS p,
  count(*) OVER (PARTITION BY label) AS k, count(*) OVER () AS n FROM samples) WHERE p <= round_even(least(120, n) * k / CAST(n AS DOUBLE), 0)""")
def stratified_subset(spark: SparkSession, sf: str) -> DataFrame:
    return R.stratified_subset(P.samples(spark, sf), 120).select("sample_id", "label")


@register("balanced_subset", with_("ranks") + """ SELECT sample_id, label, row_number() OVER (ORDER BY rank_score DESC, sample_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(sample_id || ':42'), sample_id) AS p FROM ranks)
  WHERE p <= (SELECT least(count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 0)) FROM ranks)""")
def balanced_subset(spark: SparkSession, sf: str) -> DataFrame:
    return R.balanced_subset(P.ranks(spark, sf)).select("sample_id", "label", "rank")


@register("manifest_stats", with_("samples") + f""", m AS (SELECT s.label, s.cwe, h.split FROM samples s JOIN (SELECT doc_id, {_SHARE} FROM ({_HASHED})) h ON s.sample_id = h.doc_id)
  SELECT 'rows' AS metric, 'total' AS key, count(*) AS value FROM m UNION ALL SELECT 'rows', 'positive', count(*) FROM m WHERE label = 1 UNION ALL SELECT 'rows', 'negative', count(*) FROM m WHERE label = 0
  UNION ALL SELECT 'split', split, count(*) FROM m GROUP BY split UNION ALL SELECT 'cwe', c, count(*) FROM (SELECT unnest(cwe) AS c FROM m) GROUP BY c""")
def manifest_stats(spark: SparkSession, sf: str) -> DataFrame:
    return R.manifest_stats(R.random_split(P.samples(spark, sf)))


@register("semi_test_only", with_("ranks") + f""" SELECT sample_id, row_number() OVER (ORDER BY rank_score DESC, sample_id) AS rank FROM ranks WHERE sample_id IN (SELECT doc_id FROM (SELECT doc_id, {_SHARE} FROM ({_HASHED})) WHERE split = 'test')""")
def semi_test_only(spark: SparkSession, sf: str) -> DataFrame:
    m = R.random_split(table(spark, sf, "documents"), "doc_id").select(F.col("doc_id").alias("sample_id"), "split")
    return R.only_split(P.ranks(spark, sf), m).select("sample_id", "rank")


# -- ranks -----------------------------------------------------------------------------------------------------------


@register("rank_global", with_("ranked") + " SELECT sample_id, rank_score, rank FROM ranked")
def rank_global(spark: SparkSession, sf: str) -> DataFrame:
    return R.rank_rows(P.ranks(spark, sf)).select("sample_id", "rank_score", "rank")


@register("topk_candidates", with_("ranked") + " SELECT sample_id, rank FROM ranked WHERE rank <= 50")
def topk_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k(P.ranks(spark, sf), 50).select("sample_id", "rank")


@register("anti_id_audit", "SELECT doc_id AS sample_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT event_id, 'extra' FROM events WHERE event_id NOT IN (SELECT doc_id FROM documents)")
def anti_id_audit(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    own = table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"))
    more = table(spark, sf, "events").select(F.col("event_id").alias("sample_id"))
    return R.missing_ids(d, own).where("side = 'missing'").union(R.missing_ids(d, more).where("side = 'extra'"))


# -- alerts ------------------------------------------------------------------------------------------------------------


@register("alert_group_features", with_("alerts") + """ SELECT a.sample_id, alert_count, unique_query_count, has_codeql_alert, max_severity_score, coalesce(t.n, 0) AS trace_line_count FROM (
  SELECT sample_id, count(*) AS alert_count, count(DISTINCT query_id) AS unique_query_count, max(CASE WHEN tool = 'codeql' THEN 1 ELSE 0 END) AS has_codeql_alert,
  max(CASE WHEN lower(trim(severity)) IN ('error', 'high', 'critical') THEN 3 WHEN lower(trim(severity)) IN ('warning', 'medium') THEN 2 WHEN lower(trim(severity)) IN ('note', 'low', 'recommendation', 'info') THEN 1 ELSE 0 END) AS max_severity_score FROM alerts GROUP BY sample_id) a
  LEFT JOIN (SELECT sample_id, count(DISTINCT t) AS n FROM (SELECT sample_id, unnest(trace_lines) AS t FROM alerts) GROUP BY sample_id) t USING (sample_id)""")
def alert_group_features(spark: SparkSession, sf: str) -> DataFrame:
    return A.static_summary(P.alerts(spark, sf))


@register("ranker_alert_features", with_("alerts") + """ SELECT a.sample_id, alert_count, CAST(1 AS DOUBLE) AS has_codeql_alert, high_severity_count, unique_query_count, CAST(coalesce(c.n, 0) AS DOUBLE) AS cwe_count, trace_line_count FROM (
  SELECT sample_id, CAST(count(*) AS DOUBLE) AS alert_count, CAST(count(*) FILTER (WHERE lower(severity) IN ('error', 'critical', 'high')) AS DOUBLE) AS high_severity_count, CAST(count(DISTINCT query_id) AS DOUBLE) AS unique_query_count, CAST(sum(len(trace_lines)) AS DOUBLE) AS trace_line_count FROM alerts GROUP BY sample_id) a
  LEFT JOIN (SELECT sample_id, count(DISTINCT c) AS n FROM (SELECT sample_id, unnest(cwe) AS c FROM alerts) GROUP BY sample_id) c USING (sample_id)""")
def ranker_alert_features(spark: SparkSession, sf: str) -> DataFrame:
    return A.ranker_features(P.alerts(spark, sf))


@register("line_unions", with_("alerts") + """, x AS (SELECT sample_id, unnest(generate_series(CAST(start_line AS BIGINT), CAST(end_line AS BIGINT))) AS l FROM alerts), y AS (SELECT sample_id, unnest(trace_lines) AS l FROM alerts),
  p AS (SELECT sample_id, string_agg(DISTINCT l, ',' ORDER BY l) AS alert_lines FROM x GROUP BY 1), q AS (SELECT sample_id, string_agg(DISTINCT l, ',' ORDER BY l) AS trace_lines FROM y GROUP BY 1)
  SELECT sample_id, alert_lines, coalesce(q.trace_lines, '') AS trace_lines FROM p LEFT JOIN q USING (sample_id)""")
def line_unions(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return A.line_unions(P.alerts(spark, sf)).select("sample_id", text("alert_lines"), text("trace_lines"))


@register("cwe_mode", with_("alerts") + """ SELECT sample_id, cwe, n FROM (SELECT sample_id, cwe, n, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, cwe) AS r FROM (SELECT sample_id, c AS cwe, count(*) AS n FROM (SELECT sample_id, unnest(cwe) AS c FROM alerts) WHERE c <> 'unknown' GROUP BY ALL)) WHERE r = 1""")
def cwe_mode(spark: SparkSession, sf: str) -> DataFrame:
    return A.cwe_mode(P.alerts(spark, sf))


@register("alert_counters", with_("alerts") + " SELECT 'query' AS kind, query_id AS key, count(*) AS n FROM alerts GROUP BY 2 UNION ALL SELECT 'cwe', c, count(*) FROM (SELECT unnest(cwe) AS c FROM alerts) GROUP BY c UNION ALL SELECT 'samples', 'covered', count(DISTINCT sample_id) FROM alerts")
def alert_counters(spark: SparkSession, sf: str) -> DataFrame:
    return A.counters(P.alerts(spark, sf))


_SPANS = "SELECT o_custkey AS k, CAST(o_orderkey % 5000 AS BIGINT) AS start_line, CAST(o_orderkey % 5000 + 20 + o_custkey % 300 AS BIGINT) AS end_line, o_orderkey AS ord FROM orders"
_NTH = "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)"
_POINTS = f"SELECT l_orderkey, l_linenumber, {_NTH} AS nth, l_partkey AS pk, l_orderkey % 6000 AS line FROM lineitem"


@register("span_range_join", f"""WITH s AS ({_SPANS}), p AS ({_POINTS})
  SELECT l_orderkey, l_linenumber, CAST(nth AS INT) AS nth, ord AS span_ord FROM (SELECT p.*, s.ord, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, nth ORDER BY s.end_line - s.start_line NULLS LAST, s.ord) AS r FROM p LEFT JOIN s ON p.pk = s.k AND p.line BETWEEN s.start_line AND s.end_line) WHERE r = 1""")
def span_range_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item; order and line number repeat, so items of the same two are numbered."""
    s = table(spark, sf, "orders").selectExpr("o_custkey AS k", "o_orderkey % 5000 AS start_line", "o_orderkey % 5000 + 20 + o_custkey % 300 AS end_line", "o_orderkey AS ord")
    p = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_NTH} AS nth", "l_partkey AS k", "l_orderkey % 6000 AS line").withColumn("pid", F.concat_ws(":", "l_orderkey", "l_linenumber", "nth"))
    return A.in_spans(p, s, key="k", line="line", ids="pid", bin_size=256).select("l_orderkey", "l_linenumber", "nth", "span_ord")


_LONG = "CASE line % 3 WHEN 0 THEN file WHEN 1 THEN '/home/build/' || file ELSE regexp_extract(file, '([^/]*)$', 1) END"


@register("map_alerts", with_("alerts", "nodes") + f""", s AS (SELECT graph_id * 1000 + line AS sample_id, {_LONG} AS file, min(line) AS a, max(line) + 4 AS b FROM nodes GROUP BY graph_id, line, file)
  SELECT ord, sample_id FROM (SELECT x.ord, s.sample_id, row_number() OVER (PARTITION BY x.ord ORDER BY s.b - s.a NULLS LAST, s.sample_id) AS r FROM alerts x LEFT JOIN s
    ON (x.file = ltrim(s.file, '/') OR ends_with(s.file, '/' || x.file) OR ends_with(x.file, '/' || s.file)) AND x.start_line <= s.b AND x.end_line >= s.a) WHERE r = 1""")
def map_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Sample paths are those of the alerts, or longer ones, or base names."""
    n = P.nodes(spark, sf).groupBy("graph_id", "line", "file").agg(F.min("line").alias("a"), (F.max("line") + 4).alias("b")).withColumn("file", F.expr(_LONG))
    s = n.select((F.col("graph_id") * 1000 + F.col("line")).alias("sample_id"), F.struct("file", F.col("a").alias("start_line"), F.col("b").alias("end_line")).alias("span"))
    return A.map_to_samples(P.alerts(spark, sf), s).select("ord", "sample_id")


@register("wrap_offsets", f"""WITH b AS (SELECT doc_id, CASE WHEN ends_with(c, chr(10)) THEN c ELSE c || chr(10) END AS c FROM ({_SPLIT}) WHERE trim(regexp_replace(c, '\\s+', ' ', 'g')) <> '' AND len(l) >= 2),
  n AS (SELECT doc_id, length(c) - length(replace(c, chr(10), '')) AS n, row_number() OVER (ORDER BY doc_id) AS r FROM b),
  o AS (SELECT doc_id, n, (r - 1) // 50 AS k, CAST(8 + coalesce(sum(n + 2) OVER (PARTITION BY (r - 1) // 50 ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_line FROM n)
  SELECT doc_id, 'batch_' || lpad(CAST(k AS VARCHAR), 3, '0') || '.c' AS batch_file, start_line, start_line + n - 1 AS end_line FROM o""")
def wrap_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return A.wrap(table(spark, sf, "documents"), F.col("text"), "doc_id", "doc_id").select("doc_id", "batch_file", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@register("rebase_alerts", with_("alerts") + """ SELECT ord, greatest(1, start_line - 4) AS start_line, greatest(greatest(1, start_line - 4), end_line - 4) AS end_line, array_to_string(list_transform(list_filter(trace_lines, lambda t: t BETWEEN 5 AND 30), lambda t: t - 4), ',') AS trace FROM alerts""")
def rebase_alerts(spark: SparkSession, sf: str) -> DataFrame:
    a = A.rebase(P.alerts(spark, sf).withColumns({"span_start": F.lit(5), "span_end": F.lit(30)}))
    return a.select("ord", "start_line", "end_line", F.array_join(F.transform("trace_lines", lambda x: x.cast("string")), ",").alias("trace"))


# -- fusion ------------------------------------------------------------------------------------------------------------


@register("static_scores", with_("static_scores") + " SELECT sample_id, round(CAST(static_score AS DOUBLE), 6) AS static_score FROM static_scores")
def static_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.static_scores(P.alerts(spark, sf)))


@register("static_scores_of_arrays", with_("static_scores") + " SELECT sample_id, round(CAST(static_score AS DOUBLE), 6) AS static_score FROM static_scores")
def static_scores_of_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.grouped(P.alerts(spark, sf), "ord").select("sample_id", S.static_score(F.col("alerts")).alias("static_score")))


@register("llm_scores", with_("llm_scores") + " SELECT sample_id, round(llm_score, 6) AS llm_score FROM llm_scores")
def llm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.verdicts(spark, sf).select("sample_id", S.verdict_score(F.col("verdict"), F.col("confidence")).alias("llm_score")))


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    return U.fuse(U.join_signals(P.samples(spark, sf), P.ranks(spark, sf), P.alerts(spark, sf), P.verdicts(spark, sf)))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    s = U.signals(P.samples(spark, sf), P.ranks(spark, sf), P.alerts(spark, sf), P.verdicts(spark, sf))
    return R.rank_rows(s.select("sample_id", "label", "rank_score", "static_score", "llm_score"))


_FINAL = "CAST(0.25 AS DOUBLE) * static_score + CAST(0.45 AS DOUBLE) * rank_score + CAST(0.30 AS DOUBLE) * llm_score"


@register("fuse_final", with_("scored", "samples", "alerts", "verdicts") + f""", m AS (SELECT sample_id, cwe FROM (SELECT sample_id, cwe, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, cwe) AS r FROM (SELECT sample_id, c AS cwe, count(*) AS n FROM (SELECT sample_id, unnest(cwe) AS c FROM alerts) WHERE c <> 'unknown' GROUP BY ALL)) WHERE r = 1)
  SELECT s.sample_id, round(static_score, 6) AS static_score, round(rank_score, 6) AS rank_score, round(llm_score, 6) AS llm_score, round(least(1, {_FINAL}), 6) AS final_score, CASE WHEN {_FINAL} >= 0.5 THEN 1 ELSE 0 END AS final_label,
  coalesce(CASE WHEN v.predicted_cwe NOT IN ('', 'unknown') THEN v.predicted_cwe END, m.cwe, d.cwe[1], 'unknown') AS predicted_cwe FROM scored s JOIN samples d USING (sample_id) LEFT JOIN verdicts v USING (sample_id) LEFT JOIN m USING (sample_id)""")
def fuse_final(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_fused(spark, sf).select("sample_id", "static_score", "rank_score", "llm_score", "final_score", "final_label", "predicted_cwe"))


@register("line_scores_topk", with_("alerts", "verdicts", "samples") + """, x AS (SELECT DISTINCT sample_id, 'a' AS k, unnest(generate_series(CAST(start_line AS BIGINT), CAST(end_line AS BIGINT))) AS l FROM alerts UNION SELECT sample_id, 't', unnest(trace_lines) FROM alerts UNION SELECT sample_id, 'v', unnest(vulnerable_lines) FROM verdicts),
  s AS (SELECT sample_id, l, least(CAST(1 AS DOUBLE), max(CASE WHEN k = 'a' THEN CAST(0.35 AS DOUBLE) ELSE 0 END) + max(CASE WHEN k = 't' THEN CAST(0.2 AS DOUBLE) ELSE 0 END) + max(CASE WHEN k = 'v' THEN CAST(0.35 AS DOUBLE) ELSE 0 END)) AS score FROM x GROUP BY sample_id, l),
  r AS (SELECT sample_id, l, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, l) AS r FROM s)
  SELECT d.sample_id, coalesce(string_agg(l, ',' ORDER BY r) FILTER (WHERE r <= 5), '') AS lines FROM samples d LEFT JOIN r USING (sample_id) GROUP BY d.sample_id""")
def line_scores_topk(spark: SparkSession, sf: str) -> DataFrame:
    best = U.best_lines(U.scored_lines(P.alerts(spark, sf), P.verdicts(spark, sf)))
    s = P.samples(spark, sf).select("sample_id").join(best, "sample_id", "left")
    return s.select("sample_id", F.coalesce(F.array_join(F.transform("vulnerable_lines", lambda x: x.cast("string")), ","), F.lit("")).alias("lines"))


_FINDINGS = f"SELECT f.*, l.lines FROM ({ORACLES['fuse_final']}) f JOIN ({ORACLES['line_scores_topk']}) l USING (sample_id)"


@register("findings_report", f"SELECT sample_id, final_label, final_score AS final_confidence, predicted_cwe, lines, count(*) OVER () AS total, count(*) FILTER (WHERE final_label = 1) OVER () AS vulnerable_count FROM ({_FINDINGS})")
def findings_report(spark: SparkSession, sf: str) -> DataFrame:
    totals, rows = U.report(U.findings(_fused(spark, sf)))
    f = F.from_json("json", "sample_id long, final_label int, final_confidence double, predicted_cwe string, vulnerable_lines array<int>")
    out = rows.select(f.alias("f")).select("f.sample_id", "f.final_label", "f.final_confidence", "f.predicted_cwe", F.array_join(F.transform("f.vulnerable_lines", lambda x: x.cast("string")), ",").alias("lines"))
    return rounded(out.crossJoin(F.broadcast(totals)))  # one row


@register("sarif_report", with_("samples") + f""", f AS ({_FINDINGS}), r AS (SELECT f.sample_id, CASE WHEN predicted_cwe = 'unknown' THEN 'siltstone' ELSE predicted_cwe END AS rule, 'src/' || coalesce(s.repo, '') || '.c' AS uri, CASE WHEN lines = '' THEN 1 ELSE CAST(split_part(lines, ',', 1) AS BIGINT) END AS line
  FROM f JOIN samples s USING (sample_id) WHERE final_label = 1) SELECT sample_id, rule, uri, line, min(sample_id) OVER (PARTITION BY rule) AS first_of_rule FROM r""")
def sarif_report(spark: SparkSession, sf: str) -> DataFrame:
    f = _fused(spark, sf).withColumn("file", F.concat(F.lit("src/"), F.coalesce("repo", F.lit("")), F.lit(".c")))
    rules, results = U.sarif(U.findings(f), f)
    x = F.from_json("json", "ruleId string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:long>>>>")
    at = F.get("x.locations", F.lit(0))["physicalLocation"]
    out = results.withColumn("x", x).where(F.col("x.message.text").startswith(F.concat(F.lit("Potential vulnerability ("), F.col("x.ruleId"), F.lit(") with confidence "))))
    out = out.select(F.col("ord").alias("sample_id"), F.col("x.ruleId").alias("rule"), at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("line"))
    return out.join(rules.withColumnRenamed("ord", "first_of_rule"), "rule")


@register("finding_evidence", with_("alerts", "verdicts", "scored") + """, a AS (SELECT sample_id, count(*) AS n, coalesce(sum(len(trace_lines)), 0) AS t FROM alerts GROUP BY 1)
  SELECT s.sample_id, repeat('static_alert,', coalesce(CAST(a.n AS INT), 0)) || CASE WHEN coalesce(a.t, 0) > 0 THEN 'trace_lines,' ELSE '' END || CASE WHEN v.sample_id IS NOT NULL THEN 'llm_verdict,' ELSE '' END || 'rank_score,fusion_scores,line_scores' AS kinds, round(s.rank_score, 6) AS rank_score, round(s.static_score, 6) AS static_score
  FROM scored s LEFT JOIN a USING (sample_id) LEFT JOIN verdicts v USING (sample_id)""")
def finding_evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = F.from_json("evidence", "array<struct<kind:string,value:double,static_score:double>>")
    of = lambda k: F.get(F.filter("e", lambda x: x["kind"] == k), F.lit(0))
    f = U.findings(_fused(spark, sf)).select("sample_id", e.alias("e"))
    return rounded(f.select("sample_id", F.array_join(F.transform("e", lambda x: x["kind"]), ",").alias("kinds"), of("rank_score")["value"].alias("rank_score"), of("fusion_scores")["static_score"].alias("static_score")))


# -- evaluation --------------------------------------------------------------------------------------------------------

_DIV = "CASE WHEN {d} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({n} AS DOUBLE) / ({d}) END"


def _div(n: str, d: str) -> str:
    return _DIV.format(n=n, d=d)


def _class_sql(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    p, r = _div("tp", "tp + fp"), _div("tp", "tp + fn")
    m = "CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)"
    return f"""SELECT {k}tp, fp, tn, fn, round({_div('tp + tn', 'tp + fp + tn + fn')}, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1,
  round(CASE WHEN {m} = 0 THEN 0 ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt({m}) END, 6) AS mcc FROM (SELECT *, {p} AS p, {r} AS r FROM (SELECT {k}count(*) FILTER (WHERE y = 1 AND f = 1) AS tp, count(*) FILTER (WHERE y = 0 AND f = 1) AS fp, count(*) FILTER (WHERE y = 0 AND f = 0) AS tn, count(*) FILTER (WHERE y = 1 AND f = 0) AS fn FROM ({source}){' GROUP BY ' + keys if keys else ''}))"""


@register("confusion_metrics", with_("ranks") + " " + _class_sql("SELECT label AS y, CASE WHEN rank_score >= 0.5 THEN 1 ELSE 0 END AS f FROM ranks"))
def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.classification(P.ranks(spark, sf), F.col("label"), F.col("rank_score")))


@register("roc_pr_auc", with_("ranks") + """, g AS (SELECT rank_score AS s, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM ranks GROUP BY 1),
  c AS (SELECT p, n, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM g)
  SELECT round(sum(n * (cp - p + p / CAST(2 AS DOUBLE))) / max(CAST(tp AS DOUBLE) * tn), 6) AS roc_auc, round(sum(p * cp / CAST(cp + cn AS DOUBLE)) / max(tp), 6) AS pr_auc FROM c""")
def roc_pr_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.aucs(P.ranks(spark, sf), F.col("label"), F.col("rank_score")))


def _rank_sql(source: str, ks: tuple[int, ...], keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    cols = ["round(coalesce(CAST(1 AS DOUBLE) / min(rank) FILTER (WHERE label = 1), 0), 6) AS mrr"]
    pos = "count(*) FILTER (WHERE label = 1)"
    for n in ks:
        cols.append(f"round(CASE WHEN {pos} = 0 THEN 0 ELSE count(*) FILTER (WHERE label = 1 AND rank <= {n}) / CAST({pos} AS DOUBLE) END, 6) AS recall_at_{n}")
        ideal = f"list_sum(list_transform(generate_series(1, least({pos}, {n})), lambda i: 1 / log2(i + 1)))"
        cols.append(f"round(CASE WHEN {pos} = 0 THEN 0 ELSE coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE label = 1 AND rank <= {n}), 0) / {ideal} END, 6) AS ndcg_at_{n}")
    return f"SELECT {k}{', '.join(cols)} FROM ({source}){' GROUP BY ' + keys if keys else ''}"


@register("ranking_metrics", with_("ranked") + " " + _rank_sql("SELECT label, rank FROM ranked", (1, 5, 50)))
def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.ranking(R.rank_rows(P.ranks(spark, sf)), "label", (1, 5, 50)))


_EACH = _rank_sql("SELECT repo, s.label, row_number() OVER (PARTITION BY repo ORDER BY rank_score DESC, sample_id) AS rank FROM ranks r JOIN (SELECT sample_id, repo, label FROM samples) s USING (sample_id)", (1, 5, 10, 20), "repo").replace("round(", "(").replace(", 6)", ")")
_GNAMES = ["mrr", *[f"{m}_at_{k}" for k in (1, 5, 10, 20) for m in ("recall", "ndcg")]]


@register("grouped_ranking", with_("ranked", "samples") + f""", e AS ({_EACH}) SELECT 'group' AS scope, repo AS grp, {', '.join(f'round({c}, 6) AS {c}' for c in _GNAMES)} FROM e UNION ALL SELECT 'macro', '', {', '.join(f'round(avg({c}), 6)' for c in _GNAMES)} FROM e
  UNION ALL SELECT 'overall', '', * FROM ({_rank_sql('SELECT label, rank FROM ranked', (1, 5, 10, 20))})""")
def grouped_ranking(spark: SparkSession, sf: str) -> DataFrame:
    s = P.samples(spark, sf).select("sample_id", "repo")
    return rounded(E.grouped_ranking(P.ranks(spark, sf).join(s, "sample_id"), "label", "rank_score", "sample_id", "repo"))


@register("localization_metrics", with_("alerts", "verdicts") + """, t AS (SELECT sample_id, list_sort(list_distinct(flatten(list(trace_lines)))) AS t FROM alerts GROUP BY sample_id HAVING sum(len(trace_lines)) > 0),
  j AS (SELECT t.t, v.vulnerable_lines AS p FROM t LEFT JOIN verdicts v USING (sample_id))
  SELECT count(*) AS samples, round(avg(CASE WHEN list_has_any(p[:1], t) THEN 1 ELSE 0 END), 6) AS top1_hit, round(avg(CASE WHEN list_has_any(p[:3], t) THEN 1 ELSE 0 END), 6) AS top3_hit, round(avg(CASE WHEN list_has_any(p[:5], t) THEN 1 ELSE 0 END), 6) AS top5_hit,
  round(avg(CASE WHEN p IS NULL THEN 0 ELSE len(list_intersect(p, t)) / CAST(len(list_distinct(list_concat(p, t))) AS DOUBLE) END), 6) AS mean_iou, round(avg(CASE WHEN p IS NULL THEN 0 ELSE 1 END), 6) AS coverage FROM j""")
def localization_metrics(spark: SparkSession, sf: str) -> DataFrame:
    truth = A.line_unions(P.alerts(spark, sf)).where("size(trace_lines) > 0").select("sample_id", F.col("trace_lines").alias("vulnerable_lines"))
    return rounded(E.localization(truth, P.verdicts(spark, sf)))


@register("cost_summary", with_("costs") + """, c AS (SELECT *, coalesce(total_tokens, CASE WHEN prompt_tokens IS NOT NULL OR completion_tokens IS NOT NULL THEN coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) END) AS t FROM costs)
  SELECT count(*) AS calls, CAST(sum(t) AS BIGINT) AS total_tokens, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(api_cost_usd), 6) AS total_cost, round(avg(latency_seconds), 6) AS avg_latency,
  round(quantile_cont(latency_seconds, 0.95), 6) AS p95_latency, round(sum(t) / CAST(count(*) AS DOUBLE), 6) AS avg_tokens, round(sum(api_cost_usd) / count(*), 6) AS avg_cost FROM c""")
def cost_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.costs(P.costs(spark, sf)))


_VROWS = with_("ranked", "verdicts") + ", t AS (SELECT r.rank, r.label, v.verdict FROM ranked r JOIN verdicts v USING (sample_id))"


@register("topk_verdict_analysis", _VROWS + """, x AS (SELECT k, setting, rank, label, verdict, setting = 'uncertain_as_negative' OR verdict <> 'uncertain' AS u FROM t, (VALUES (10), (30), (50)) a(k), (VALUES ('uncertain_as_negative'), ('uncertain_excluded')) b(setting) WHERE rank <= k),
  a AS (SELECT k, setting, count(*) AS n, count(*) FILTER (WHERE u) AS candidates, count(*) FILTER (WHERE label = 1) AS positives_in_topk, count(*) FILTER (WHERE verdict = 'vulnerable') AS vulnerable_n, count(*) FILTER (WHERE verdict = 'benign') AS benign_n, count(*) FILTER (WHERE verdict = 'uncertain') AS uncertain_n,
  count(*) FILTER (WHERE u AND verdict = 'vulnerable' AND label = 1) AS tp, count(*) FILTER (WHERE u AND verdict = 'vulnerable' AND label = 0) AS fp, count(*) FILTER (WHERE u AND verdict <> 'vulnerable' AND label = 0) AS tn, count(*) FILTER (WHERE u AND verdict <> 'vulnerable' AND label = 1) AS fn, count(*) FILTER (WHERE verdict = 'benign' AND label = 0) AS bt FROM x GROUP BY k, setting),
  """ + f"b AS (SELECT *, {_div('tp', 'tp + fp')} AS p, {_div('tp', 'tp + fn')} AS r, CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn) AS d FROM a)" + f""" SELECT k, setting, n, candidates, positives_in_topk, vulnerable_n, benign_n, uncertain_n, tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1,
  round({_div('tp + tn', 'tp + fp + tn + fn')}, 6) AS accuracy, round(CASE WHEN d <> 0 THEN (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(d) END, 6) AS mcc, round({_div('uncertain_n', 'n')}, 6) AS uncertain_rate, round({_div('tp', 'vulnerable_n')}, 6) AS vulnerable_verdict_precision,
  round({_div('bt', 'benign_n')}, 6) AS benign_verdict_precision, round({_div('positives_in_topk', 'n')}, 6) AS ranker_precision, round({_div('tp', 'vulnerable_n')} - {_div('positives_in_topk', 'n')}, 6) AS precision_gain FROM b""")
def topk_verdict_analysis(spark: SparkSession, sf: str) -> DataFrame:
    r = R.join_all(R.top_k(P.ranks(spark, sf), max(KS)), P.verdicts(spark, sf).select("sample_id", "verdict"))
    return rounded(E.topk_verdicts(r, KS))


_CELLS = "(VALUES " + ", ".join(f"('{m}', {k}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE))" for m, w in X.METHODS.items() for k in (0, *KS) for a, b, c in [X.without_verifier(w) if k == 0 else w]) + ") c(method, k, ws, wr, wl)"
_MATRIX = _class_sql(f"SELECT method, k, label AS y, CASE WHEN ws * static_score + wr * rank_score + wl * CASE WHEN rank <= k AND wl > 0 THEN llm_score ELSE 0 END >= 0.5 THEN 1 ELSE 0 END AS f FROM scored, {_CELLS}", "method, k")


@register("method_matrix", with_("scored") + " " + _MATRIX)
def method_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.matrix(_scored(spark, sf), (0, *KS)))


@register("fp_reduction", with_("scored") + f""", m AS ({_MATRIX}) SELECT b.method AS baseline_method, a.method AS llm_method, b.k, b.fp AS fp_before, a.fp AS fp_after, b.fp - a.fp AS fp_reduction, b.precision AS precision_before, a.precision AS precision_after, round(a.precision - b.precision, 5) AS precision_gain
  FROM m b JOIN m a ON a.k = b.k AND ((b.method = 'static_ranker' AND a.method = 'full') OR (b.method = 'static_only' AND a.method = 'static_llm'))""")
def fp_reduction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.fp_reduction(rounded(X.matrix(_scored(spark, sf), (0, *KS))))).withColumn("precision_gain", F.round("precision_gain", 5))


@register("ablation_delta", with_("scored") + f""", m AS ({_MATRIX}), r AS (SELECT method AS config, f1 FROM m WHERE k = 50), f AS (SELECT f1 AS v FROM r WHERE config = 'full')
  SELECT config, 'f1' AS metric, f1 AS value, round(f1 - v, 6) AS delta, CAST(row_number() OVER (ORDER BY f1 DESC, config) AS INT) AS rank, config = 'full' AS is_reference FROM r, f""")
def ablation_delta(spark: SparkSession, sf: str) -> DataFrame:
    m = rounded(X.matrix(_scored(spark, sf), (50,))).select(F.col("method").alias("config"), "f1")
    return rounded(E.ablation(m, "f1"))


@register("ranking_quality", with_("scored") + " SELECT 'rank_score' AS score_type, * FROM (" + _rank_sql("SELECT label, rank FROM ranked", KS) + ") UNION ALL SELECT 'static_score', * FROM (" + _rank_sql("SELECT label, row_number() OVER (ORDER BY static_score DESC, sample_id) AS rank FROM scored", KS) + ")")
def ranking_quality(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.ranking_quality(_scored(spark, sf).withColumn("static_score", F.round("static_score", 9)), ("rank_score", "static_score")))


@register("compare_runs", with_("scored") + f""", m AS ({_MATRIX}) SELECT count(*) AS cells, round(avg(b.recall - a.recall), 5) AS mean_delta, CASE WHEN abs(avg(b.recall - a.recall)) <= 0.01 THEN 'comparable' WHEN avg(b.recall - a.recall) > 0 THEN 'better' ELSE 'worse' END AS verdict
  FROM m a JOIN m b ON a.method = b.method AND a.k = 10 AND b.k = 50""")
def compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    m = rounded(X.matrix(_scored(spark, sf), (10, 50)))
    return X.compare_runs(m.where("k = 10"), m.where("k = 50"), "recall", ("method",)).withColumn("mean_delta", F.round("mean_delta", 5))


@register("param_grid", with_("scored") + " " + _class_sql("SELECT cell, w_static, w_rank, w_llm, label AS y, CASE WHEN w_static * static_score + w_rank * rank_score + w_llm * llm_score >= 0.5 THEN 1 ELSE 0 END AS f FROM scored, (VALUES (0, CAST(0.2 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.3 AS DOUBLE)), (1, CAST(0.1 AS DOUBLE), CAST(0.8 AS DOUBLE), CAST(0.1 AS DOUBLE))) c(cell, w_static, w_rank, w_llm)", "cell, w_static, w_rank, w_llm"))
def param_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.param_grid(_scored(spark, sf), [(0.2, 0.5, 0.3), (0.1, 0.8, 0.1)]))


@register("score_stats", with_("ranks") + " SELECT round(min(rank_score), 6) AS min, round(max(rank_score), 6) AS max, round(avg(rank_score), 6) AS mean, count(*) FILTER (WHERE label = 1) AS positives FROM ranks")
def score_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.score_stats(P.ranks(spark, sf)))


@register("rank_audit", with_("ranked") + """ SELECT * FROM (VALUES ('rank_gaps', 0), ('duplicate_ids', 0), ('extra_ids', 0), ('score_range', 0)) t("check", failures) UNION ALL SELECT 'missing_ids', count(*) FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM ranked WHERE rank <= 100)
  UNION ALL SELECT 'label_mismatch', count(*) FROM ranked r JOIN labels l ON r.sample_id = l.doc_id AND r.rank <= 100 WHERE r.label <> l.quality""")
def rank_audit(spark: SparkSession, sf: str) -> DataFrame:
    return E.audit_ranks(R.top_k(P.ranks(spark, sf), 100), P.samples(spark, sf))


_SPLITS = f"(SELECT doc_id AS sample_id, {_SHARE} FROM ({_HASHED}))"


@register("leakage_audit", f"""WITH m AS {_SPLITS}, t AS (SELECT sample_id FROM m WHERE split = 'test'), v AS (SELECT DISTINCT doc_id AS sample_id FROM labels)
  SELECT 'ids_in_two_splits' AS "check", 0 AS failures UNION ALL SELECT 'code_in_two_splits', count(*) FROM (SELECT sha256(coalesce(d.text, '')) AS h FROM documents d JOIN m ON d.doc_id = m.sample_id GROUP BY 1 HAVING count(DISTINCT split) > 1)
  UNION ALL SELECT 'labels_outside_test', count(*) FROM v WHERE sample_id NOT IN (SELECT sample_id FROM t) UNION ALL SELECT 'labels_lacks', count(*) FROM t WHERE sample_id NOT IN (SELECT sample_id FROM v)""")
def leakage_audit(spark: SparkSession, sf: str) -> DataFrame:
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"))
    return E.audit_leakage(R.random_split(P.samples(spark, sf)), {"labels": labelled}, code="code")


@register("feature_audit", """SELECT 'missing' AS "check", count(*) AS failures FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'extra', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'repeated', 0
  UNION ALL SELECT 'empty_code', count(*) FROM labels l LEFT JOIN documents d USING (doc_id) WHERE trim(coalesce(text, '')) = ''""")
def feature_audit(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").selectExpr("doc_id AS sample_id", "text AS function_code")
    f = table(spark, sf, "labels").selectExpr("doc_id AS sample_id").join(d, "sample_id", "left")
    return E.audit_features(f, P.samples(spark, sf))


@register("readiness", with_("samples") + """ SELECT 'unique_ids' AS "check", count(*) = count(DISTINCT sample_id) AS ok FROM samples UNION ALL SELECT 'both_classes', count(DISTINCT label) = 2 FROM samples UNION ALL SELECT 'code_located', count(*) = count(*) FILTER (WHERE coalesce(code, '') <> '') FROM samples UNION ALL SELECT 'enough_rows', count(*) >= 20 FROM samples""")
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    return E.readiness(P.samples(spark, sf))


# -- graphs ------------------------------------------------------------------------------------------------------------

_HOPS = """, ways AS (SELECT graph_id, source AS id, target AS o FROM edges UNION SELECT graph_id, target, source FROM edges), z AS (SELECT graph_id, id FROM nodes WHERE file = 'src/f1.c' AND line IN (3, 4)),
  h1 AS (SELECT graph_id, id FROM z UNION SELECT w.graph_id, w.o FROM z JOIN ways w USING (graph_id, id)), h2 AS (SELECT graph_id, id FROM h1 UNION SELECT w.graph_id, w.o FROM h1 JOIN ways w USING (graph_id, id)),
  dist AS (SELECT graph_id, id, CASE WHEN (graph_id, id) IN (SELECT (graph_id, id) FROM z) THEN 0 WHEN (graph_id, id) IN (SELECT (graph_id, id) FROM h1) THEN 1 ELSE 2 END AS d FROM h2),
  kept AS (SELECT graph_id, id FROM (SELECT graph_id, id, row_number() OVER (PARTITION BY graph_id ORDER BY d, coalesce(line, 1000000000), id) AS r FROM dist JOIN nodes USING (graph_id, id)) WHERE r <= 40)"""


@register("khop_slice", with_("nodes", "edges") + _HOPS + " SELECT graph_id, id FROM kept")
def khop_slice(spark: SparkSession, sf: str) -> DataFrame:
    return G.slice_around(P.nodes(spark, sf), P.edges(spark, sf), "f1.c", [3, 4], k=2, max_nodes=40)[0].select("graph_id", "id")


@register("induced_subgraph", with_("nodes", "edges") + _HOPS + " SELECT e.graph_id, e.ord, source, target, type FROM edges e JOIN kept a ON a.graph_id = e.graph_id AND a.id = source JOIN kept b ON b.graph_id = e.graph_id AND b.id = target")
def induced_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return G.slice_around(P.nodes(spark, sf), P.edges(spark, sf), "f1.c", [3, 4], k=2, max_nodes=40)[1].select("graph_id", "ord", "source", "target", "type")


@register("function_slice", with_("nodes") + " SELECT graph_id, id FROM nodes WHERE file = 'src/f2.c' AND (function = 'fn2' OR line BETWEEN 4 AND 6)")
def function_slice(spark: SparkSession, sf: str) -> DataFrame:
    return G.slice_function(P.nodes(spark, sf), P.edges(spark, sf), "/root/src/f2.c", 4, 6, "fn2")[0].select("graph_id", "id")


@register("adjacency", with_("nodes", "edges") + """, w AS (SELECT graph_id, source AS id, target AS o FROM edges UNION SELECT graph_id, target, source FROM edges), p AS (SELECT w.* FROM w JOIN nodes a ON a.graph_id = w.graph_id AND a.id = w.id JOIN nodes b ON b.graph_id = w.graph_id AND b.id = w.o)
  SELECT n.graph_id, n.id, coalesce(string_agg(o, ',' ORDER BY o), '') AS others FROM nodes n LEFT JOIN p ON p.graph_id = n.graph_id AND p.id = n.id GROUP BY n.graph_id, n.id""")
def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return G.adjacency(P.nodes(spark, sf), P.edges(spark, sf)).select("graph_id", "id", F.array_join(F.transform("others", lambda x: x.cast("string")), ",").alias("others"))


@register("feature_graph", with_("nodes", "edges") + """, i AS (SELECT graph_id, id, row_number() OVER (PARTITION BY graph_id ORDER BY id) - 1 AS i FROM nodes) SELECT e.graph_id, e.ord, a.i AS source, b.i AS target, e.type AS edge_type FROM edges e JOIN i a ON a.graph_id = e.graph_id AND a.id = e.source JOIN i b ON b.graph_id = e.graph_id AND b.id = e.target""")
def feature_graph(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<int>")
    n = G.feature_nodes(P.nodes(spark, sf), none, none, F.lit(1), F.lit(50))
    return G.feature_edges(n, P.edges(spark, sf)).select("graph_id", "ord", F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), "edge_type")


@register("feature_nodes", with_("nodes") + """ SELECT id AS node_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY id) - 1 AS INT) AS index, type AS node_type, CASE WHEN line BETWEEN 2 AND 8 THEN line - 1 END AS line_index, CAST(CASE WHEN line IN (3, 5) THEN 1 ELSE 0 END AS DOUBLE) AS is_alert_line,
  CAST(CASE WHEN regexp_matches(lower(coalesce(code, '')), 'recv|read|scanf|argv|getenv|fgets|gets') THEN 1 ELSE 0 END AS DOUBLE) AS is_source_like, CAST(CASE WHEN regexp_matches(lower(coalesce(code, '')), 'memcpy|strcpy|strcat|sprintf|system|free|malloc|memmove|alloca') THEN 1 ELSE 0 END AS DOUBLE) AS is_sink_like FROM nodes""")
def feature_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = G.feature_nodes(P.nodes(spark, sf), F.array(F.lit(3), F.lit(5)), F.array(F.lit(4)), F.lit(2), F.lit(8))
    return n.select("node_id", "index", "node_type", "line_index", *[F.element_at("static_flags", F.lit(k)).alias(k) for k in ("is_alert_line", "is_source_like", "is_sink_like")])


@register("graph_summary", with_("nodes", "edges") + """ SELECT graph_id, n AS graph_node_count, e AS graph_edge_count, d AS dangerous_api_count FROM (SELECT graph_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(coalesce(code, '')), 'memcpy|strcpy|strcat|sprintf|system|free|malloc|memmove|alloca')) AS d FROM nodes GROUP BY 1) JOIN (SELECT graph_id, count(*) AS e FROM edges GROUP BY 1) USING (graph_id)""")
def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    return G.summary(P.nodes(spark, sf), P.edges(spark, sf))


@register("graph_collate", "SELECT conv_id, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS \"offset\", CAST(row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id) - 1 AS INT) AS batch_index FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) WINDOW w AS (PARTITION BY conv_id % 8 ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def graph_collate(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("batch", F.col("conv_id") % 8)
    return G.collate(g, "batch", "conv_id").select("conv_id", "offset", "batch_index")


@register("mean_pool", "SELECT graph_id, round(avg(x), 6) AS v0, round(avg(y), 6) AS v1 FROM (SELECT conv_id % 5 + conv_id // 1000 * 5 AS graph_id, CAST(turn AS DOUBLE) AS x, CAST(length(text) AS DOUBLE) AS y FROM conversations) GROUP BY 1")
def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    n = P.nodes(spark, sf)
    v = table(spark, sf, "conversations").selectExpr("conv_id % 5 + conv_id div 1000 * 5 AS graph_id", "array(CAST(turn AS double), CAST(length(text) AS double)) AS vector")
    return rounded(G.mean_pool(n.select("graph_id").distinct(), v, 2).select("graph_id", F.get("vector", F.lit(0)).alias("v0"), F.get("vector", F.lit(1)).alias("v1")))


def crc_sql(text: str) -> str:
    """SQL of the CRC-32 of a text's UTF-8 bytes: eight shifts after each byte."""
    steps = ", ".join(["256"] * 8)
    byte = f"flatten(list_transform(generate_series(1, octet_length(encode({text}))), lambda i: [CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT), {steps}]))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {byte}), lambda c, x: CASE WHEN x = 256 THEN xor(c >> 1, 3988292384 * (c & 1)) ELSE xor(c, x) END), CAST(4294967295 AS BIGINT))"


@register("node_hash_vectors", with_("nodes") + f""", t AS (SELECT id, unnest(regexp_extract_all(coalesce(code, ''), '{_TOKEN}')) AS w FROM nodes), k AS (SELECT w, {crc_sql('w')} % 16 AS slot FROM (SELECT DISTINCT w FROM t)), s AS (SELECT id, slot, count(*) AS n FROM t JOIN k USING (w) GROUP BY ALL),
  h AS (SELECT id, string_agg(slot || ':' || n, ',' ORDER BY slot) AS tokens, sum(n) AS total FROM s GROUP BY id)
  SELECT graph_id, id AS node_id, {crc_sql("coalesce(type, 'UNKNOWN')")} % 16 AS type_slot, CASE WHEN line BETWEEN 1 AND 40 THEN line ELSE 0 END AS line, CAST(CASE WHEN line = 3 THEN 1 ELSE 0 END + CASE WHEN line = 4 THEN 2 ELSE 0 END AS INT) AS flags, coalesce(tokens, '') AS tokens, 37 AS width FROM nodes LEFT JOIN h USING (id)""")
def node_hash_vectors(spark: SparkSession, sf: str) -> DataFrame:
    n = G.feature_nodes(P.nodes(spark, sf), F.array(F.lit(3)), F.array(F.lit(4)), F.lit(1), F.lit(40))
    v = n.withColumn("v", node_vector(F.col("node_type"), F.col("code"), F.col("line_index"), F.col("static_flags"))).withColumn("n", F.size(T.tokens(F.col("code"))))
    slots = F.transform(F.slice("v", 22, 16), lambda x, i: F.struct(i.alias("i"), F.round(x * F.col("n")).cast("long").alias("k")))
    tokens = F.array_join(F.transform(F.filter(slots, lambda x: x["k"] > 0), lambda x: F.concat_ws(":", x["i"], x["k"])), ",")
    return v.select("graph_id", "node_id", (F.array_position(F.slice("v", 1, 16), 1.0) - 1).alias("type_slot"), F.round(F.get("v", F.lit(16)) * 100).cast("int").alias("line"), (F.get("v", F.lit(17)) + 2 * F.get("v", F.lit(18))).cast("int").alias("flags"), tokens.alias("tokens"), F.size("v").alias("width"))


# -- verifier ------------------------------------------------------------------------------------------------------------

_RISKY = "regexp_matches(t, 'memcpy|strcpy|strcat|sprintf|system|free|gets')"
_GUARD = r"regexp_matches(t, 'if \(|if\(|sizeof|strncpy|snprintf|bounds|assert')"


@register("mock_verdicts", f"""SELECT sample_id, verdict, CAST(CASE verdict WHEN 'vulnerable' THEN 0.9 WHEN 'benign' THEN 0.8 ELSE 0.5 END AS DOUBLE) AS confidence, CAST(length(t) // 4 AS BIGINT) AS prompt_tokens FROM (SELECT sample_id, t, CASE WHEN {_RISKY} AND NOT {_GUARD} THEN 'vulnerable' WHEN {_RISKY} THEN 'uncertain' ELSE 'benign' END AS verdict
  FROM (SELECT doc_id AS sample_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' memcpy' WHEN 1 THEN ' memcpy sizeof' ELSE '' END AS t FROM documents))""")
def mock_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "documents").selectExpr("doc_id AS sample_id", "concat(coalesce(text, ''), CASE doc_id % 3 WHEN 0 THEN ' memcpy' WHEN 1 THEN ' memcpy sizeof' ELSE '' END) AS prompt")
    return V.mock_verdicts(p).select("sample_id", "verdict", "confidence", "prompt_tokens")


_ANSWERS = """CASE event_id % 7 WHEN 0 THEN '{"verdict": "vulnerable", "confidence": 0.5, "vulnerable_lines": [1, 2]}' WHEN 1 THEN '```json\n{"sample_id": "x", "verdict": "benign", "confidence": 1.04}\n```' WHEN 2 THEN 'no json' WHEN 3 THEN '{"verdict": "maybe", "confidence": 0.5}'
  WHEN 4 THEN '{"verdict": "benign", "confidence": 1.5}' WHEN 5 THEN '{"verdict": "benign"}' END"""


@register("parse_verdicts", """SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS sample_id, CASE event_id % 7 WHEN 0 THEN 'vulnerable' WHEN 1 THEN 'benign' END AS verdict, CAST(CASE event_id % 7 WHEN 0 THEN 0.5 WHEN 1 THEN 1 END AS DOUBLE) AS confidence,
  CASE event_id % 7 WHEN 2 THEN 'json' WHEN 3 THEN 'verdict' WHEN 4 THEN 'confidence range' WHEN 5 THEN 'confidence' WHEN 6 THEN 'json' END AS error FROM events""")
def parse_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "events").select("event_id", V.parse(F.expr(_ANSWERS), F.col("event_id")).alias("v"))
    ok = F.col("v.error").isNull()
    return p.select("event_id", "v.sample_id", F.when(ok, F.col("v.verdict")).alias("verdict"), F.when(ok, F.col("v.confidence")).alias("confidence"), "v.error")


@register("prompt_cost_preview", "SELECT count(*) AS calls, CAST(sum(length(text) // 4) AS BIGINT) AS prompt_tokens, count(*) * 500 AS completion_tokens, round((sum(length(text) // 4) * 0.14 + count(*) * 500 * 0.28) / 1e6, 6) AS cost_usd FROM conversations")
def prompt_cost_preview(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.cost_preview(table(spark, sf, "conversations"), "text", 0.14, 0.28))


@register("priced_log", with_("costs") + " SELECT prompt_tokens, completion_tokens, round(CASE WHEN prompt_tokens IS NOT NULL OR completion_tokens IS NOT NULL THEN (coalesce(prompt_tokens, 0) * CAST(0.14 AS DOUBLE) + coalesce(completion_tokens, 0) * CAST(0.28 AS DOUBLE)) / 1e6 END, 6) AS api_cost_usd FROM costs")
def priced_log(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.price(P.costs(spark, sf), 0.14, 0.28).select("prompt_tokens", "completion_tokens", "api_cost_usd"))


@register("evidence_lines", f"""WITH l AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM ({_SPLIT})) SELECT d.doc_id AS sample_id, coalesce(string_agg(i, ',' ORDER BY i) FILTER (WHERE regexp_matches(x, 'read|recv|scanf|argv|getenv|input')), '') AS source_like_lines FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id GROUP BY d.doc_id""")
def evidence_lines(spark: SparkSession, sf: str) -> DataFrame:
    s = P.samples(spark, sf).select("sample_id", F.col("code").alias("function_code"), N.span(F.lit("f.c"), F.col("code")).alias("span"), F.array().cast("array<int>").alias("trace_lines"), F.lit(0.5).alias("rank_score"))
    f = s.join(A.grouped(P.alerts(spark, sf), "ord"), "sample_id", "left")
    return V.evidence_summary(f).select("sample_id", F.array_join(F.transform("summary.source_like_lines", lambda x: x.cast("string")), ",").alias("source_like_lines"))


@register("rendered_prompts")
def rendered_prompts(spark: SparkSession, sf: str) -> DataFrame:
    s = R.top_k(P.ranks(spark, sf), 50).select("sample_id", "rank_score").join(P.samples(spark, sf).select("sample_id", F.col("code").alias("function_code"), N.span(F.lit("f.c"), F.col("code")).alias("span"), F.array().cast("array<int>").alias("trace_lines")), "sample_id")
    return V.prompt(V.evidence_summary(s.join(A.grouped(P.alerts(spark, sf), "ord"), "sample_id", "left")))


# -- ranker --------------------------------------------------------------------------------------------------------------

_TERM = r"[A-Za-z_][\p{L}\p{N}_]+|\p{Nd}+|[^\p{L}\p{N}_\s\x1c-\x1f\x{85}\p{Z}]"


@register("tfidf_top_terms", with_("samples") + f""", t AS (SELECT sample_id, regexp_extract_all(coalesce(code, ''), '{_TERM}') AS t FROM samples), g AS (SELECT sample_id, unnest(list_concat(t, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM t),
  f AS (SELECT sample_id, term, count(*) AS tf FROM g GROUP BY ALL), v AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM f GROUP BY 1) SELECT term, df, total, round(ln((1 + (SELECT count(*) FROM samples)) / CAST(1 + df AS DOUBLE)) + 1, 6) AS idf FROM v ORDER BY total DESC, term LIMIT 500""")
def tfidf_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    s = P.samples(spark, sf)
    return rounded(K.vocabulary(s, s.count(), 500))


@register("numeric_features", f"""SELECT sample_id, {_METRICS} FROM (SELECT doc_id AS sample_id, coalesce(text, '') AS c, regexp_extract_all(coalesce(text, ''), '{_NAME}') AS ids FROM documents)""")
def numeric_features(spark: SparkSession, sf: str) -> DataFrame:
    return K.numeric_rows(P.samples(spark, sf), P.alerts(spark, sf)).select("sample_id", *K.CODE)


@register("ranker_scores")
def ranker_scores(spark: SparkSession, sf: str) -> DataFrame:
    return T3.train_ranker(P.samples(spark, sf), P.alerts(spark, sf), limit=2000)[1]
