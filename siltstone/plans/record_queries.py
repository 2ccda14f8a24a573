"""Registered queries that write the driver's tables in the formats of the sources, read them again, and take records through
the stages, each with the same result in SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schemas as C
from siltstone.functions import lines as L
from siltstone.functions import normalize as N
from siltstone.functions.vectors import STATIC_KEYS, static_vector
from siltstone.operators import alerts as A
from siltstone.operators import evaluation as E
from siltstone.operators import experiments as X
from siltstone.operators import fusion as U
from siltstone.operators import ranker as K
from siltstone.operators import relational as R
from siltstone.operators import verify as V
from siltstone.operators.common import cut, shared_path
from siltstone.plans import proxies as P
from siltstone.plans import triage as T3
from siltstone.plans.proxies import table, with_
from siltstone.plans.queries import _MATRIX, _METRICS, _NAME, _SHARE, _SPLITS, _TERM, KS, _class_sql, _rank_sql, _scored, register, rounded
from siltstone.sources import graphs, records, sinks

# -- files of records -----------------------------------------------------------------------------------------------------


def _written(rows: DataFrame, name: str, **options: str) -> str:
    """Rows of one text column as a text file folder."""
    path = shared_path(rows.sparkSession, name)
    rows.write.options(**options).text(path)
    return path


def _text(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@register("jsonl_roundtrip", "SELECT doc_id, text, lang, source, (SELECT count(*) FROM documents) AS n_written FROM documents")
def jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "documents")
    n = sinks.write_jsonl(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), path)
    return records.read_jsonl(spark, path, "doc_id long, text string, lang string, source string").drop("ord").withColumn("n_written", F.lit(n).cast("long"))


@register("checked_records", with_("alerts") + """, x AS (SELECT ord, CASE WHEN ord % 19 <> 0 THEN tool END AS tool, start_line, CASE WHEN ord % 17 = 0 THEN start_line - 1 ELSE end_line END AS end_line, CASE WHEN ord % 23 = 0 THEN [0] ELSE trace_lines END AS trace FROM alerts)
  SELECT ord AS alert, reasons, reasons = '' AS valid FROM (SELECT ord, concat_ws(',', CASE WHEN tool IS NULL THEN 'missing_tool' END, CASE WHEN end_line < start_line THEN 'span_order' END, CASE WHEN least(start_line, end_line) < 1 THEN 'span_first' END, CASE WHEN ord % 23 = 0 THEN 'trace_lines' END) AS reasons FROM x)""")
def checked_records(spark: SparkSession, sf: str) -> DataFrame:
    a = P.alerts(spark, sf).selectExpr(
        "CAST(sample_id AS string) AS sample_id", "CASE WHEN ord % 19 <> 0 THEN tool END AS tool", "query_id", "message", "severity", "file", "start_line", "CASE WHEN ord % 17 = 0 THEN start_line - 1 ELSE end_line END AS end_line", "cwe",
        "CASE WHEN ord % 23 = 0 THEN array(0) ELSE trace_lines END AS trace_lines", "CAST(ord AS string) AS raw")
    path = shared_path(spark, "alerts")
    sinks.write_jsonl(a, path)
    r = records.read_records(spark, path, C.ALERT, "alert", strict=False)
    return r.select(F.col("raw").cast("long").alias("alert"), F.array_join("reasons", ",").alias("reasons"), "valid")


@register("tolerant_lines", """SELECT 'good' AS kind, event_id AS id, event_type AS v FROM events WHERE event_id % 9 <> 0 AND event_id % 4 >= 2 UNION ALL SELECT 'bad', CASE event_id % 4 WHEN 1 THEN event_id END, CASE event_id % 4 WHEN 0 THEN '{broken' END FROM events WHERE event_id % 9 <> 0 AND event_id % 4 < 2""")
def tolerant_lines(spark: SparkSession, sf: str) -> DataFrame:
    line = """CASE WHEN event_id % 9 = 0 THEN '  ' WHEN event_id % 4 = 0 THEN '{broken' WHEN event_id % 4 = 1 THEN concat('[', event_id, ']') ELSE to_json(named_struct('id', event_id, 'v', event_type)) END AS value"""
    good, bad = records.read_tolerant(spark, _written(table(spark, sf, "events").selectExpr(line), "lines"), "id long, v string")
    number = F.regexp_extract("value", r"^\[(\d+)\]$", 1).try_cast("long")
    return good.select(F.lit("good").alias("kind"), "id", "v").union(bad.select(F.lit("bad"), number, F.when(number.isNull(), F.col("value"))))


# Raw records made of documents: what a record has depends on its id, so every alias and gap occurs.
_RAW = "replace(text, '\r', ' ')"
_LABEL = "CASE doc_id % 5 WHEN 0 THEN '1' WHEN 1 THEN 'no' WHEN 2 THEN ' Vul ' WHEN 3 THEN '0.0' END"
_CWE = "CASE doc_id % 4 WHEN 0 THEN 'CWE-79, CWE-89' WHEN 1 THEN '[\"CWE-1\", \" \"]' WHEN 2 THEN '' END"
_FILE = "CASE WHEN doc_id % 3 <> 0 THEN 'src/' || doc_id || '.c' END"
_SPLIT_IN = "CASE doc_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'Train' END"


def _raw(spark: SparkSession, sf: str, ids: str, code: str, label: str, **more: str) -> DataFrame:
    d = table(spark, sf, "documents").where("length(text) > 0")
    named = {ids: "CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id AS string) END", code: _RAW, label: _LABEL, "cwe": _CWE, "file": _FILE, "split": _SPLIT_IN} | more
    return d.selectExpr(*[f"{e} AS `{n}`" for n, e in named.items()])


def _records_sql(name: str, repo: str, commit: str, function: str = "NULL", cwe: str | None = None) -> str:
    cwe = cwe or "CASE doc_id % 4 WHEN 0 THEN 'CWE-79,CWE-89' WHEN 1 THEN 'CWE-1' ELSE '' END"
    return f"""SELECT '{name}_' || CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id AS VARCHAR) ELSE substr(sha1(coalesce(f, 'unknown') || chr(0) || c), 1, 16) END AS sample_id, {repo} AS repo, {commit} AS commit_before, coalesce(f, 'unknown') AS file, {function} AS function,
  CAST(length(c) - length(replace(c, chr(10), '')) + 1 AS INT) AS end_line, CASE WHEN doc_id % 5 IN (0, 2) THEN 1 ELSE 0 END AS label, {cwe} AS cwe, CASE doc_id % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'train' ELSE 'unknown' END AS split, sha256(c) AS digest
  FROM (SELECT doc_id, replace(text, chr(13), ' ') AS c, {_FILE} AS f FROM documents WHERE length(text) > 0)"""


def _shown(r: DataFrame) -> DataFrame:
    return r.select("sample_id", "repo", "commit_before", "file", "function", "span.end_line", "label", F.array_join("cwe", ",").alias("cwe"), "split", F.sha2("code", 256).alias("digest"))


@register("devign_records", _records_sql("devign", "'p' || (doc_id % 2)", "'c' || doc_id"))
def devign_records(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "devign")
    more = {"func": f"CASE WHEN doc_id % 2 = 0 THEN {_RAW} END", "project": "'p' || (doc_id % 2)", "commit_id": "'c' || doc_id"}
    _raw(spark, sf, "idx", "function", "target", **more).write.json(path)
    return _shown(records.load_dataset(spark, path, "devign"))


@register("diversevul_records", _records_sql("diversevul", "'q'", "'d' || doc_id", "'fn' || (doc_id % 9)"))
def diversevul_records(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "diversevul")
    _raw(spark, sf, "id", "func", "label", repo="'q'", commit_before="'d' || doc_id", func_name="'fn' || (doc_id % 9)").write.json(path)
    return _shown(records.load_dataset(spark, path, "diversevul"))


@register("bigvul_records", _records_sql("bigvul", "'r'", "'e' || doc_id", "'fn' || (doc_id % 9)"))
def bigvul_records(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "bigvul")
    r = _raw(spark, sf, "id", "func_before", "vulnerable", project="'r'", commit_id="'e' || doc_id", function_name="'fn' || (doc_id % 9)")
    r.write.options(header="true", quoteAll="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    return _shown(records.load_dataset(spark, path, "bigvul"))


@register("raw_json_array", """SELECT 'devign_' || doc_id AS sample_id, CASE WHEN doc_id % 11 = 0 THEN 'empty_code' ELSE 'ok' END AS reason, CASE WHEN doc_id % 11 = 0 THEN '' ELSE sha256(replace(text, chr(13), ' ')) END AS digest FROM documents WHERE length(text) > 0""")
def raw_json_array(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("length(text) > 0")
    one = d.selectExpr("doc_id % 64 AS part", f"to_json(named_struct('idx', CAST(doc_id AS string), 'func', CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE {_RAW} END, 'target', 1)) AS j")
    arrays = one.groupBy("part").agg(F.concat(F.lit("[7, "), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))  # the fixture: 64 files
    path = shared_path(spark, "arrays")
    arrays.repartition(64, "part").select("value", "part").write.partitionBy("part").text(path)
    good, bad = records.load_raw(spark, f"{path}/*/*.txt", "devign")
    return good.select("sample_id", F.lit("ok").alias("reason"), F.sha2("code", 256).alias("digest")).union(bad.select("sample_id", "reason", F.lit("")))


@register("raw_csv", """SELECT 'bigvul_' || CASE WHEN doc_id % 7 = 0 THEN 'i' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS sample_id, CASE WHEN doc_id % 4 = 0 THEN 'CWE-20' ELSE '' END AS cwe, CASE WHEN doc_id % 5 IN (0, 2) THEN 1 ELSE 0 END AS label, sha256(replace(text, chr(13), ' ')) AS digest FROM documents WHERE length(text) > 0 AND length(regexp_replace(text, '\\s', '', 'g')) > 0""")
def raw_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "raw")
    d = table(spark, sf, "documents").where("length(text) > 0").selectExpr(
        "CASE WHEN doc_id % 7 = 0 THEN concat('i', doc_id) ELSE CAST(doc_id AS string) END AS index", f"CASE WHEN doc_id % 2 = 0 THEN {_RAW} END AS func_before", f"{_RAW} AS processed_func", "CASE doc_id % 4 WHEN 0 THEN ' CWE-20' WHEN 1 THEN 'None' END AS `CWE ID`", f"{_LABEL} AS target")
    d.write.options(header="true", quoteAll="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    good, _ = records.load_raw(spark, path, "bigvul")
    return good.select("sample_id", F.array_join("cwe", ",").alias("cwe"), "label", F.sha2("code", 256).alias("digest"))


@register("keyed_evidence", "SELECT CAST(c_custkey AS VARCHAR) AS sample_id, c_name AS name, c_nationkey AS region FROM customer")
def keyed_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON object of all customers, written by many tasks and read by byte ranges."""
    path = shared_path(spark, "keyed")
    member = F.concat(F.lit('"'), "c_custkey", F.lit('": '), F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("region"))))
    sinks.write_joined(table(spark, sf, "customer").select("c_custkey", member.alias("m")), "c_custkey", "m", path, "{", "}")
    r = records.read_keyed(spark, path).select("sample_id", F.from_json("evidence", "name string, region int").alias("e"))
    return r.select("sample_id", "e.name", "e.region")


@register("code_lookup", "SELECT CAST(n_nationkey AS VARCHAR) AS sample_id, n_name || chr(10) || n_regionkey AS code FROM nation")
def code_lookup(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "code")
    n = table(spark, sf, "nation").selectExpr("CAST(n_nationkey AS string) AS sample_id", "concat(n_name, '\n', n_regionkey) AS value")
    n.repartition("sample_id").write.partitionBy("sample_id").text(path)
    return records.code_files(spark, path).withColumn("code", F.regexp_replace("code", "\n$", ""))


@register("graph_files", with_("nodes", "edges") + """ SELECT CAST(graph_id AS VARCHAR) AS graph_id, 'node' AS kind, CAST(id AS VARCHAR) AS a, type AS b, coalesce(file, '') AS c, line FROM nodes UNION ALL SELECT CAST(graph_id AS VARCHAR), 'edge', CAST(source AS VARCHAR), type, CAST(target AS VARCHAR), NULL FROM edges""")
def graph_files(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "graphs")
    graphs.write_graphs(P.nodes(spark, sf), P.edges(spark, sf), path)
    n, e = graphs.read_graph(spark, path)
    return n.select("graph_id", F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("type").alias("b"), F.coalesce("file", F.lit("")).alias("c"), "line").union(e.select("graph_id", F.lit("edge"), "source", "type", "target", F.lit(None).cast("int")))


@register("graph_lines", with_("nodes", "edges") + """ SELECT CAST(graph_id AS VARCHAR) AS graph_id, 'node' AS kind, CAST(id AS VARCHAR) AS a, type AS b, coalesce(file, '') AS c, line FROM nodes UNION ALL SELECT CAST(graph_id AS VARCHAR), 'edge', CAST(source AS VARCHAR), type, CAST(target AS VARCHAR), NULL FROM edges""")
def graph_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Graphs packed into few files and read again."""
    path = shared_path(spark, "graph_lines")
    graphs.write_graph_lines(P.nodes(spark, sf), P.edges(spark, sf), path)
    n, e = graphs.read_graph_lines(spark, path)
    return n.select("graph_id", F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("type").alias("b"), F.coalesce("file", F.lit("")).alias("c"), "line").union(e.select("graph_id", F.lit("edge"), "source", "type", "target", F.lit(None).cast("int")))


@register("graphml_files", with_("nodes", "edges") + """ SELECT CAST(graph_id AS VARCHAR) AS graph_id, 'node' AS kind, CAST(id AS VARCHAR) AS a, type AS b, file AS c, line FROM nodes UNION ALL SELECT CAST(graph_id AS VARCHAR), 'edge', CAST(source AS VARCHAR), type, CAST(target AS VARCHAR), NULL FROM edges""")
def graphml_files(spark: SparkSession, sf: str) -> DataFrame:
    n = P.nodes(spark, sf).selectExpr("graph_id", "concat('<node id=\"', id, '\"><data key=\"t\">', type, '</data><data key=\"f\">', file, '</data><data key=\"l', graph_id, '\">', line, '</data></node>') AS x")
    e = P.edges(spark, sf).selectExpr("graph_id", "concat('<edge source=\"', source, '\" target=\"', target, '\" label=\"', type, '\"/>') AS x")
    keys = "concat('<?xml version=\"1.0\"?><graphml xmlns=\"http://graphml.graphdrawing.org/xmlns\"><key id=\"t\" attr.name=\"label\"/><key id=\"f\" attr.name=\"FILENAME\"/><key id=\"l', graph_id, '\" attr.name=\"LINE_NUMBER\"/><graph>', x, '</graph></graphml>') AS value"
    docs = n.union(e).groupBy("graph_id").agg(F.array_join(F.collect_list("x"), "").alias("x")).selectExpr("graph_id", keys)  # the fixture: a file a graph
    path = shared_path(spark, "graphml")
    docs.repartition("graph_id").write.partitionBy("graph_id").text(path)
    n, e = graphs.read_graphml(spark, path)
    return n.select("graph_id", F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("type").alias("b"), F.col("file").alias("c"), "line").union(e.select("graph_id", F.lit("edge"), "source", "type", "target", F.lit(None).cast("int")))


@register("sarif_alerts", "SELECT CAST(event_id AS VARCHAR) AS message, CASE WHEN event_id % 4 = 0 THEN 'r/' || (event_id % 3) ELSE event_type END AS query_id, CASE WHEN event_id % 2 = 0 THEN 'error' END AS severity, CAST(event_id % 50 + 1 AS INT) AS start_line, CAST(CASE WHEN event_id % 5 = 0 THEN event_id % 50 + 4 ELSE event_id % 50 + 1 END AS INT) AS end_line, CASE WHEN event_id % 4 = 0 AND event_id % 3 = 1 THEN 'CWE-119' ELSE '' END AS cwe FROM events")
def sarif_alerts(spark: SparkSession, sf: str) -> DataFrame:
    result = """to_json(named_struct('ruleId', CASE WHEN event_id % 4 <> 0 THEN event_type END, 'ruleIndex', CASE WHEN event_id % 4 = 0 THEN event_id % 3 END, 'level', CASE WHEN event_id % 2 = 0 THEN 'error' END, 'message', named_struct('text', CAST(event_id AS string)),
      'locations', array(named_struct('physicalLocation', named_struct('artifactLocation', named_struct('uri', 'a.c'), 'region', named_struct('startLine', event_id % 50 + 1, 'endLine', CASE WHEN event_id % 5 = 0 THEN event_id % 50 + 4 END)))))) AS x"""
    rules = json.dumps([{"id": f"r/{i}", "properties": {"tags": ["external/cwe/cwe-119"] if i == 1 else []}} for i in range(3)])
    e = table(spark, sf, "events").selectExpr("event_id % 32 AS part", result).groupBy("part").agg(F.array_join(F.collect_list("x"), ",").alias("x"))  # the fixture: 32 files
    docs = e.select("part", F.concat(F.lit('{"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "t", "rules": ' + rules + '}}, "results": ['), "x", F.lit("]}]}")).alias("value"))
    path = shared_path(spark, "sarif")
    docs.repartition(32, "part").write.partitionBy("part").text(path)
    return graphs.read_sarif(spark, f"{path}/*/*.txt").select("message", "query_id", "severity", "start_line", "end_line", F.array_join("cwe", ",").alias("cwe"))


@register("metric_csv", with_("scored") + f" SELECT method, CAST(k AS VARCHAR) AS k, CAST(tp AS VARCHAR) AS tp, printf('%.6f', f1) AS f1, CASE WHEN mcc <> 0 THEN printf('%.6f', mcc) END AS mcc FROM ({_MATRIX})")
def metric_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "metrics")
    m = rounded(X.matrix(_scored(spark, sf), (0, *KS))).withColumn("mcc", F.when(F.col("mcc") != 0, F.col("mcc")))
    sinks.write_csv(m, ["method", "k", "tp", "f1", "mcc"], path)
    return spark.read.option("header", "true").csv(path)


@register("concat_by_name", "SELECT doc_id, quality, CAST(NULL AS INT) AS toxic FROM labels UNION ALL SELECT doc_id, NULL, toxic FROM labels")
def concat_by_name(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "labels")
    return sinks.concat(t.selectExpr("doc_id", "CAST(quality AS int) AS quality"), t.selectExpr("CAST(toxic AS int) AS toxic", "doc_id"))


@register("cost_log_sink", with_("costs") + " SELECT event_id AS id, total_tokens, round(CASE WHEN p IS NOT NULL OR c IS NOT NULL THEN (coalesce(p, 0) * CAST(0.14 AS DOUBLE) + coalesce(c, 0) * CAST(0.28 AS DOUBLE)) / 1e6 END, 8) AS api_cost_usd, (SELECT count(*) FROM events) AS n FROM (SELECT event_id, p, c, p + c AS total_tokens FROM (SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN k END AS p, CASE WHEN event_id % 4 <> 0 THEN k * 2 END AS c FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)))")
def cost_log_sink(spark: SparkSession, sf: str) -> DataFrame:
    v = P.costs(spark, sf).selectExpr("CAST(sample_id AS string) AS sample_id", "prompt_tokens", "completion_tokens", "latency_seconds", "true AS success", "CAST(null AS string) AS error")
    path = shared_path(spark, "costs")
    V.write_cost_log(v.limit(3), "m", path)
    n = V.write_cost_log(v, "m", path, (0.14, 0.28))  # a run starts its log anew
    r = records.read_jsonl(spark, path, C.COST)
    return r.select(F.col("sample_id").cast("long").alias("id"), "total_tokens", "api_cost_usd", F.lit(n).cast("long").alias("n"))


@register("verified_cases", with_("ranked", "verdicts") + " SELECT CAST(r.sample_id AS VARCHAR) AS sample_id, r.rank, r.label, v.verdict, v.confidence, v.predicted_cwe FROM ranked r JOIN verdicts v USING (sample_id) WHERE r.rank <= 50")
def verified_cases(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "cases")
    best = R.top_k(P.ranks(spark, sf), 50).drop("ord").withColumn("sample_id", F.col("sample_id"))
    sinks.case_file(R.join_all(best, P.verdicts(spark, sf).drop("ord")).withColumn("evidence", F.lit("[]")).withColumn("sample_id", F.col("sample_id").cast("string")), path)
    return records.read_jsonl(spark, path, "sample_id string, rank long, label int, verdict string, confidence double, predicted_cwe string").drop("ord")


# -- functions ---------------------------------------------------------------------------------------------------------------

_ODD = "CASE event_id % 6 WHEN 0 THEN '12' WHEN 1 THEN '-3' WHEN 2 THEN '4.9' WHEN 3 THEN 'abc' WHEN 4 THEN '1e12' END"


@register("number_coercions", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 12 WHEN 2 THEN 4 END AS line, CAST(CASE event_id % 6 WHEN 0 THEN 12 WHEN 1 THEN -3 WHEN 2 THEN 4.9 WHEN 4 THEN 1e12 ELSE 0 END AS DOUBLE) AS number, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE printf('%.2f%%', (event_id % 7) / 8.0 * 100) END AS shown,
  'key *** of ' || event_type AS log, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN '0' END AS present FROM events""")
def number_coercions(spark: SparkSession, sf: str) -> DataFrame:
    o = F.expr(_ODD)
    return table(spark, sf, "events").select(
        "event_id", N.coerce_line(o).alias("line"), N.number_or_zero(o).alias("number"), N.percent(F.expr("CASE WHEN event_id % 7 <> 0 THEN (event_id % 7) / 8.0D END")).alias("shown"),
        N.redact_key(F.expr("concat('key s3cret of ', event_type)"), "s3cret").alias("log"), N.first_present(F.expr("CASE event_id % 3 WHEN 0 THEN 'a' ELSE '' END"), F.expr("CASE WHEN event_id % 3 = 1 THEN 0 END")).alias("present"),
    )


@register("line_sets", with_("alerts") + """ SELECT ord, 10 + start_line - 1 AS absolute, array_to_string(list_sort(list_distinct(list_concat(trace_lines, [start_line, end_line]))), ',') AS merged, CASE WHEN ord % 2 = 0 THEN CAST(start_line AS VARCHAR) || CASE WHEN end_line > start_line THEN ',' || end_line ELSE '' END ELSE '' END AS flagged FROM alerts""")
def line_sets(spark: SparkSession, sf: str) -> DataFrame:
    a = P.alerts(spark, sf)
    flag = lambda v: F.create_map(F.lit("is_alert_line"), v.cast("double"))
    on = F.when(F.col("ord") % 2 == 0, 1).otherwise(0)
    nodes = F.array(*[F.struct(c.cast("int").alias("line"), flag(on).alias("static_flags")) for c in (F.col("end_line"), F.col("start_line"), F.lit(None))])
    return a.select("ord", L.to_absolute(F.col("start_line"), F.lit(10)).alias("absolute"), _text(L.merged(F.col("trace_lines"), F.array("start_line", "end_line"), F.lit(None).cast("array<int>"))).alias("merged"), _text(L.flagged(nodes)).alias("flagged"))


@register("static_vectors", with_("alerts") + " SELECT ord, concat_ws(',', ord % 5, 0, 2, 0, CAST(start_line AS BIGINT), 0, 0, 0, 0) AS vector FROM alerts")
def static_vectors(spark: SparkSession, sf: str) -> DataFrame:
    a = P.alerts(spark, sf)
    given = F.create_map(F.lit(STATIC_KEYS[0]), (F.col("ord") % 5).cast("double"), F.lit(STATIC_KEYS[2]), F.lit(2.0), F.lit(STATIC_KEYS[4]), F.col("start_line").cast("double"), F.lit("other"), F.lit(9.0))
    return a.select("ord", F.array_join(F.transform(static_vector(given), lambda x: x.cast("long").cast("string")), ",").alias("vector"))


@register("scaled_numbers", with_("samples") + f", m AS (SELECT sample_id, {_METRICS} FROM (SELECT sample_id, coalesce(code, '') AS c, regexp_extract_all(coalesce(code, ''), '{_NAME}') AS ids FROM samples)) SELECT sample_id, round(line_count / (SELECT CASE WHEN stddev_pop(line_count) > 0 THEN stddev_pop(line_count) ELSE 1 END FROM m), 5) AS line_count, round(token_count / (SELECT stddev_pop(token_count) FROM m), 5) AS token_count, CAST(0 AS DOUBLE) AS rec_alert_count FROM m")
def scaled_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.numeric_rows(P.samples(spark, sf), P.alerts(spark, sf))
    names = ["line_count", "token_count", "rec_alert_count"]
    return rounded(K.scale(rows, K.scaler(rows, names)).select("sample_id", *names), 5)


@register("record_numbers", with_("alerts") + """, a AS (SELECT sample_id, CAST(count(*) AS DOUBLE) AS alert_count, CAST(sum(len(trace_lines)) AS DOUBLE) AS trace_line_count FROM alerts GROUP BY 1)
  SELECT doc_id AS sample_id, coalesce(alert_count, 0) AS alert_count, coalesce(trace_line_count, 0) AS trace_line_count, CAST(doc_id % 3 AS DOUBLE) AS rec_alert_count, CAST(0 AS DOUBLE) AS rec_graph_node_count, CAST(CASE WHEN doc_id % 2 = 0 THEN 1.5 ELSE 0 END AS DOUBLE) AS rec_max_severity_score FROM documents LEFT JOIN a ON doc_id = sample_id""")
def record_numbers(spark: SparkSession, sf: str) -> DataFrame:
    given = F.expr("map('alert_count', CAST(sample_id % 3 AS string), 'max_severity_score', CASE WHEN sample_id % 2 = 0 THEN '1.5' ELSE 'high' END)")
    rows = K.numeric_rows(P.samples(spark, sf).withColumn("static_features", given), P.alerts(spark, sf))
    return rows.select("sample_id", "alert_count", "trace_line_count", "rec_alert_count", "rec_graph_node_count", "rec_max_severity_score")


@register("tfidf_weights", with_("samples") + f""", t AS (SELECT sample_id, regexp_extract_all(coalesce(code, ''), '{_TERM}') AS t FROM samples), g AS (SELECT sample_id, unnest(list_concat(t, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM t),
  f AS (SELECT sample_id, term, count(*) AS tf FROM g GROUP BY ALL), v AS (SELECT term, ln((1 + (SELECT count(*) FROM samples)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf, sum(tf) AS total FROM f GROUP BY 1 ORDER BY total DESC, term LIMIT 300),
  w AS (SELECT sample_id, (1 + ln(tf)) * idf AS w FROM f JOIN v USING (term)), n AS (SELECT sample_id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1) SELECT sample_id, count(*) AS terms, round(sum(w.w / n.n), 5) AS total, round(max(w.w / n.n), 5) AS heaviest FROM w JOIN n USING (sample_id) GROUP BY 1""")
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    s = P.samples(spark, sf)
    v = cut(K.vocabulary(s, s.count(), 300))
    w = K.tfidf(K.ngrams(s, vocab=v), v)
    return rounded(w.groupBy("sample_id").agg(F.count("*").alias("terms"), F.sum("weight").alias("total"), F.max("weight").alias("heaviest")), 5)


# -- stages ------------------------------------------------------------------------------------------------------------------


@register("resolved_split", f"SELECT doc_id AS sample_id, {_SHARE} FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) AS p, count(*) OVER () AS n FROM documents)")
def resolved_split(spark: SparkSession, sf: str) -> DataFrame:
    s = P.samples(spark, sf)
    return R.resolve_split(s, R.random_split(s).select("sample_id", "split")).select("sample_id", "split")


@register("resolved_split_lacking", with_("samples") + """ SELECT sample_id, CASE WHEN p <= a THEN 'train' WHEN p <= a + least(b, n - a) THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, round_even(n * CAST(0.7 AS DOUBLE), 0) AS a, round_even(n * CAST(0.1 AS DOUBLE), 0) AS b FROM
  (SELECT sample_id, row_number() OVER (PARTITION BY label ORDER BY md5(sample_id || ':42'), sample_id) AS p, count(*) OVER (PARTITION BY label) AS n FROM samples))""")
def resolved_split_lacking(spark: SparkSession, sf: str) -> DataFrame:
    s = P.samples(spark, sf)
    part = table(spark, sf, "labels").selectExpr("doc_id AS sample_id", "CASE toxic WHEN 1 THEN 'train' ELSE 'test' END AS split")
    return R.resolve_split(s, part).select("sample_id", "split")


@register("feature_records", with_("samples", "alerts") + """, a AS (SELECT sample_id, count(*) AS n, count(DISTINCT query_id) AS q FROM alerts GROUP BY 1), l AS (SELECT sample_id, unnest(generate_series(CAST(start_line AS BIGINT), CAST(end_line AS BIGINT))) AS x FROM alerts), u AS (SELECT sample_id, count(DISTINCT x) AS n FROM l GROUP BY 1)
  SELECT s.sample_id, CAST(coalesce(u.n, 0) AS INT) AS alert_lines, CAST(coalesce(a.n, 0) AS DOUBLE) AS alert_count, CAST(coalesce(a.q, 0) AS DOUBLE) AS unique_query_count, CAST(length(coalesce(code, '')) - length(replace(coalesce(code, ''), chr(10), '')) + 1 AS DOUBLE) AS function_line_count FROM samples s LEFT JOIN a USING (sample_id) LEFT JOIN u USING (sample_id)""")
def feature_records(spark: SparkSession, sf: str) -> DataFrame:
    s = P.samples(spark, sf).withColumn("span", N.span(F.lit("f.c"), F.col("code")))
    f = T3.build_features(s, P.alerts(spark, sf))
    return f.select("sample_id", F.size("alert_lines").alias("alert_lines"), *[F.element_at("static_features", F.lit(k)).alias(k) for k in ("alert_count", "unique_query_count", "function_line_count")])


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return P.samples(spark, sf).select("sample_id", F.col("code").alias("function_code"), N.span(F.lit("f.c"), F.col("code")).alias("span"), F.array().cast("array<int>").alias("trace_lines"), "language")


_PACKET_SQL = with_("ranked", "samples", "alerts") + """, a AS (SELECT sample_id, count(*) AS n FROM alerts GROUP BY 1), t AS (SELECT sample_id, count(DISTINCT x) AS n FROM (SELECT sample_id, unnest(trace_lines) AS x FROM alerts) GROUP BY 1)
  SELECT r.sample_id, r.rank, coalesce(s.language, 'c') AS language, coalesce(a.n, 0) AS alerts, coalesce(t.n, 0) AS traces, CAST(length(coalesce(code, '')) - length(replace(coalesce(code, ''), chr(10), '')) + 1 AS BIGINT) AS end_line, sha256(coalesce(code, '')) AS digest, CASE WHEN r.sample_id % 2 = 0 THEN r.rank END AS graph
  FROM ranked r JOIN samples s USING (sample_id) LEFT JOIN a USING (sample_id) LEFT JOIN t USING (sample_id) WHERE r.rank <= 100"""


@register("verification_packets", _PACKET_SQL)
def verification_packets(spark: SparkSession, sf: str) -> DataFrame:
    g = R.top_k(P.ranks(spark, sf), 100).where("sample_id % 2 = 0").selectExpr("sample_id", "concat('{\"place\": ', rank, '}') AS evidence")
    p, missed = T3.packets(_features(spark, sf), P.ranks(spark, sf), P.alerts(spark, sf), 100, g)
    s = F.from_json(F.element_at("context", F.lit("evidence_summary")), "static_alert_count long, trace_lines array<int>, function_span struct<end_line:long>, graph_summary struct<place:long>")
    out = p.withColumn("s", s).select("sample_id", "rank", "language", F.col("s.static_alert_count").alias("alerts"), F.size("s.trace_lines").cast("long").alias("traces"), F.col("s.function_span.end_line").alias("end_line"), F.sha2("function_code", 256).alias("digest"), F.col("s.graph_summary.place").alias("graph"))
    return out.join(missed.select("sample_id"), "sample_id", "left_anti")


@register("rendered_prompts", with_("ranked", "samples") + " SELECT r.sample_id, 'sample_id: ' || r.sample_id || chr(10) || 'language: ' || coalesce(language, 'c') || chr(10) || 'span: f.c 1-' || (length(coalesce(code, '')) - length(replace(coalesce(code, ''), chr(10), '')) + 1) AS head, true AS has_code, true AS asks, 50 AS n FROM ranked r JOIN samples USING (sample_id) WHERE rank <= 50")
def rendered_prompts(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "prompts")
    f = _features(spark, sf)
    n = T3.dry_run(f, P.ranks(spark, sf), P.alerts(spark, sf), path)
    r = records.read_jsonl(spark, path, "sample_id long, messages array<struct<role:string,content:string>>").drop("ord").where("messages[0].role = 'system' and messages[1].role = 'user'")
    p, code = F.col("messages")[1]["content"], F.coalesce("function_code", F.lit(""))
    return r.join(f, "sample_id").select("sample_id", F.substring_index(p, "\n\ncode:\n", 1).alias("head"), F.contains(p, F.concat(F.lit("\n\ncode:\n"), code, F.lit("\n\nevidence:\n{"))).alias("has_code"), F.endswith(p, F.lit("answer with:\n" + json.dumps(V.ANSWER))).alias("asks"), F.lit(n).alias("n"))


def _client():  # noqa: ANN202
    """A client that answers by the number in the prompt: at once, after one repair, never, with an error."""
    def call(messages: list[dict]) -> tuple[str, int, int]:
        text = messages[-1]["content"]
        n = int("".join(c for c in text.split("#")[1] if c.isdigit())) % 5 if "#" in text else 0
        if n == 4:
            raise OSError("no route")
        if n == 3 or (n == 2 and "invalid" not in text):
            return f"#{n}# no json", 7, 2
        return json.dumps({"verdict": ("vulnerable", "benign", "uncertain")[n], "confidence": 0.25 * n + 0.5, "vulnerable_lines": [n + 1]}), 7, 2

    return call


@register("client_verdicts", """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'vulnerable' WHEN 1 THEN 'benign' ELSE 'uncertain' END AS verdict, CAST(CASE event_id % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.75 WHEN 2 THEN 1.0 ELSE 0 END AS DOUBLE) AS confidence, event_id % 5 <> 4 AS success, CASE event_id % 5 WHEN 3 THEN 'parse failure' WHEN 4 THEN 'client error' END AS error, CASE WHEN event_id % 5 <> 4 THEN 7 END AS prompt_tokens FROM events""")
def client_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "events").selectExpr("event_id AS sample_id", "'s' AS system", "concat('look at #', event_id, '#') AS prompt")
    v = V.verify(p, _client, V.VerifierConfig(max_retries=2))
    return v.select(F.col("sample_id").cast("long").alias("id"), "verdict", "confidence", "success", F.substring_index("error", ":", 1).alias("error"), "prompt_tokens")


@register("evaluated_run", with_("scored") + f""", c AS ({_class_sql("SELECT label AS y, CASE WHEN " + "0.25 * static_score + 0.45 * rank_score + 0.30 * llm_score" + " >= 0.5 THEN 1 ELSE 0 END AS f FROM scored")}), r AS ({_rank_sql("SELECT label, rank FROM ranked", (1, 5))})
  SELECT 'num_samples' AS metric, CAST((SELECT count(*) FROM scored) AS DOUBLE) AS value UNION ALL SELECT 'classification.tp', tp FROM c UNION ALL SELECT 'classification.fn', fn FROM c UNION ALL SELECT 'classification.f1', f1 FROM c UNION ALL SELECT 'ranking.mrr', mrr FROM r UNION ALL SELECT 'ranking.ndcg_at_5', ndcg_at_5 FROM r""")
def evaluated_run(spark: SparkSession, sf: str) -> DataFrame:
    s = P.samples(spark, sf)
    found = T3.fuse(s, P.ranks(spark, sf), P.alerts(spark, sf), P.verdicts(spark, sf))
    m = sinks.flatten(T3.evaluate(s, found, P.ranks(spark, sf), ks=(1, 5)))
    keep = ("num_samples", "classification.tp", "classification.fn", "classification.f1", "ranking.mrr", "ranking.ndcg_at_5")
    return rounded(spark.createDataFrame([(k, float(m[k])) for k in keep], "metric string, value double"))


@register("matrix_cells", with_("scored") + f""", m AS ({_MATRIX}) SELECT m.method, m.k, m.tp, m.f1, (SELECT count(*) FROM scored) AS samples, CASE WHEN wl > 0 THEN (SELECT count(*) FROM scored WHERE rank <= m.k AND llm_score > 0) ELSE 0 END AS llm_verified_count, ws > 0 AS static_enabled, wr > 0 AS ranker_enabled, wl > 0 AND m.k > 0 AS llm_enabled
  FROM m JOIN (VALUES {', '.join(f"('{m}', {k}, {float(a)}, {float(b)}, {float(c)})" for m, w in X.METHODS.items() for k in (0, *KS) for a, b, c in [X.without_verifier(w) if k == 0 else w])}) c(method, k, ws, wr, wl) ON m.method = c.method AND m.k = c.k""")
def matrix_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = X.matrix_cells(_scored(spark, sf), (0, *KS), truth=A.line_unions(P.alerts(spark, sf)).select("sample_id", F.col("trace_lines").alias("vulnerable_lines")), findings=P.verdicts(spark, sf), cost_log=P.costs(spark, sf))
    return rounded(c.select("method", "k", "tp", "f1", "samples", "llm_verified_count", "static_enabled", "ranker_enabled", "llm_enabled"))


_AUC = """(SELECT (sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * CAST(count(*) FILTER (WHERE label <> 1) AS DOUBLE)) FROM (SELECT label, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS rk FROM scored))"""


@register("matrix_curves", with_("scored") + " SELECT 'ranker_only' AS method, round(" + _AUC.format(s="rank_score") + ", 6) AS roc_auc, r.mrr, r.recall_at_5 FROM (" + _rank_sql("SELECT label, rank FROM ranked", (5,)) + ") r UNION ALL SELECT 'static_only', round(" + _AUC.format(s="round(static_score, 9)") + ", 6), r.mrr, r.recall_at_5 FROM (" + _rank_sql("SELECT label, row_number() OVER (ORDER BY round(static_score, 9) DESC, sample_id) AS rank FROM scored", (5,)) + ") r")
def matrix_curves(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf).withColumn("static_score", F.round("static_score", 9))
    few = {k: X.METHODS[k] for k in ("ranker_only", "static_only")}
    return rounded(X.matrix_cells(s, (10,), few, at=(5,)).select("method", "roc_auc", "mrr", "recall_at_5"))


@register("three_runs", with_("scored") + f""", m AS ({_MATRIX}) SELECT a.method, a.k, b.f1 AS f1_first, c.f1 AS f1_second, a.f1 FROM m a LEFT JOIN m b ON b.k = 10 AND a.k = 50 AND a.method = b.method AND b.method <> 'full' LEFT JOIN m c ON c.k = 30 AND a.k = 50 AND a.method = c.method WHERE a.k = 50""")
def three_runs(spark: SparkSession, sf: str) -> DataFrame:
    m = rounded(X.matrix(_scored(spark, sf), KS))
    at = lambda k: m.where(F.col("k") == k).withColumn("k", F.lit(50))
    return X.three_runs(at(50), at(10).where("method <> 'full'"), at(30), ("f1",))


@register("best_cell", with_("scored") + f", m AS ({_MATRIX}) SELECT method, k, f1 FROM m WHERE k = 50 ORDER BY f1 DESC NULLS LAST, method LIMIT 1")
def best_cell(spark: SparkSession, sf: str) -> DataFrame:
    return X.best_row(rounded(X.matrix(_scored(spark, sf), (50,))).select("method", "k", "f1"), "f1", "method")


@register("verdict_distribution", with_("verdicts") + " SELECT predicted_cwe, count(*) FILTER (WHERE verdict = 'vulnerable') AS vulnerable, count(*) FILTER (WHERE verdict = 'benign') AS benign, count(*) FILTER (WHERE verdict = 'uncertain') AS uncertain FROM verdicts GROUP BY 1")
def verdict_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return E.verdict_distribution(P.verdicts(spark, sf), "predicted_cwe")


_KEYED = "SELECT CASE WHEN sample_id % 3 = 0 THEN '__ungrouped__' WHEN sample_id % 3 = 1 THEN 'None' ELSE coalesce(repo, 'None') END AS repo, s.label, row_number() OVER (PARTITION BY CASE WHEN sample_id % 3 = 0 THEN '__ungrouped__' WHEN sample_id % 3 = 1 THEN 'None' ELSE coalesce(repo, 'None') END ORDER BY rank_score DESC, sample_id) AS rank FROM ranks r JOIN (SELECT sample_id, repo, label FROM samples) s USING (sample_id)"


@register("keyed_ranking", with_("ranked", "samples") + " SELECT 'group' AS scope, repo AS grp, mrr, recall_at_5 FROM (" + _rank_sql(_KEYED, (5,), "repo") + ") UNION ALL SELECT 'overall', '', mrr, recall_at_5 FROM (" + _rank_sql("SELECT label, rank FROM ranked", (5,)) + ")")
def keyed_ranking(spark: SparkSession, sf: str) -> DataFrame:
    s = P.samples(spark, sf).selectExpr("sample_id", "CASE sample_id % 3 WHEN 0 THEN map('other', 'x') WHEN 1 THEN map('repo', CAST(null AS string)) ELSE map('repo', repo) END AS metadata")
    g = E.grouped_ranking(P.ranks(spark, sf).join(s, "sample_id"), "label", "rank_score", "sample_id", "repo", (5,), source="metadata")
    return rounded(g.where("scope <> 'macro'").select("scope", "grp", "mrr", "recall_at_5"))


@register("test_only_audit", with_("samples") + f""", sp AS {_SPLITS}, t AS (SELECT s.sample_id, s.label FROM samples s JOIN sp USING (sample_id) WHERE split = 'test')
  SELECT * FROM (VALUES ('split_filtered', 0), ('rank_gaps', 0), ('id_sets_differ', 0), ('train_or_valid_scored', 0), ('label_mismatch', 0)) t("check", failures) UNION ALL SELECT 'label_as_feature', count(*) FROM t WHERE sample_id % 2 = label UNION ALL SELECT 'one_class', CASE WHEN count(DISTINCT label) = 2 THEN 0 ELSE 1 END FROM t""")
def test_only_audit(spark: SparkSession, sf: str) -> DataFrame:
    m = R.random_split(P.samples(spark, sf)).select("sample_id", "label", "split")
    own = m.where("split = 'test'")
    f = own.selectExpr("sample_id", "label", "map('is_Label', CAST(sample_id % 2 AS string), 'n', CAST(label AS string)) AS static_features")
    return E.audit_test_only(own, m, f, R.only_split(P.ranks(spark, sf), m))


@register("release_checks", """SELECT 'rows_documents' AS "check", (SELECT count(*) FROM documents) >= 100 AS ok UNION ALL SELECT 'rows_labels', (SELECT count(*) FROM labels) >= 1000000000 UNION ALL SELECT 'verdict_distribution', true UNION ALL SELECT 'no_secrets', NOT EXISTS (SELECT 1 FROM documents WHERE regexp_matches(text, 'AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{36}|(?i:api[_-]?key)\\s*[:=]\\s*\\S{12,}|(?i:password)\\s*=\\s*["''][^"'']+["'']'))""")
def release_checks(spark: SparkSession, sf: str) -> DataFrame:
    d, v = table(spark, sf, "documents"), P.verdicts(spark, sf)
    return E.verify_release({"documents": (d, 100), "labels": (table(spark, sf, "labels"), 10**9)}, v, E.verdict_distribution(v, "predicted_cwe"), ("predicted_cwe",), d.select("text"))


@register("schema_readiness", with_("samples") + """ SELECT 'unique_ids' AS "check", count(*) = count(DISTINCT sample_id) AS ok FROM samples UNION ALL SELECT 'both_classes', count(DISTINCT label) = 2 FROM samples UNION ALL SELECT 'code_located', count(*) = count(*) FILTER (WHERE coalesce(code, '') <> '') FROM samples UNION ALL SELECT 'enough_rows', count(*) >= 20 FROM samples UNION ALL SELECT 'schema', count(*) FILTER (WHERE language IS NULL) = 0 FROM samples""")
def schema_readiness(spark: SparkSession, sf: str) -> DataFrame:
    s = P.samples(spark, sf).withColumns({"dataset": F.lit("d"), "file": F.lit("f"), "split": F.lit("train"), "span": N.span(F.lit("f"), F.col("code"))})
    return E.readiness(s, kind="sample")


@register("strict_topk", with_("ranked", "verdicts") + " SELECT r.rank, r.sample_id, v.verdict FROM ranked r JOIN verdicts v USING (sample_id) WHERE rank <= 30")
def strict_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.join_all(R.top_k(P.ranks(spark, sf), 30), P.verdicts(spark, sf).select("sample_id", "verdict")).select("rank", "sample_id", "verdict")


_CODE_METRICS = ("line_count", "char_count", "token_count", "dangerous_api_count", "pointer_operator_count", "array_access_count", "loop_count", "if_count", "return_count")


@register("saved_ranker", with_("samples") + f""", p AS (SELECT sample_id, row_number() OVER (PARTITION BY label ORDER BY md5(sample_id || ':42'), sample_id) AS p, count(*) OVER (PARTITION BY label) AS n FROM samples),
  m AS (SELECT {_METRICS} FROM (SELECT coalesce(code, '') AS c, regexp_extract_all(coalesce(code, ''), '{_NAME}') AS ids FROM samples JOIN p USING (sample_id) WHERE p <= round_even(n * CAST(0.7 AS DOUBLE), 0)))
  """ + " UNION ALL ".join(f"SELECT '{c}' AS name, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS deviation, true AS same FROM m" for c in _CODE_METRICS))
def saved_ranker(spark: SparkSession, sf: str) -> DataFrame:
    """A ranker that was saved and loaded: the deviations by which it scales the code metrics, and whether it scores as the one that was saved."""
    s, a, path = P.samples(spark, sf), P.alerts(spark, sf), shared_path(spark, "ranker")
    ranker, ranked, _ = T3.train_ranker(s, a, limit=500)
    ranker.save(spark, path)
    loaded = T3.Ranker.load(spark, path)
    again = loaded.score(K.numeric_rows(s, a), s)
    both = ranked.select("sample_id", F.col("rank_score").alias("a")).join(again.select("sample_id", F.col("rank_score").alias("b")), "sample_id")
    same = both.agg((F.bool_and(F.abs(F.col("a") - F.col("b")) < 1e-9) & (F.count("*") == s.count())).alias("same")).first()[0]
    return rounded(spark.createDataFrame([(n, loaded.deviations[n], same) for n in loaded.names if n in _CODE_METRICS], "name string, deviation double, same boolean"))


@register("ranker_importances", "SELECT 500 + 24 AS names, true AS falling")
def ranker_importances(spark: SparkSession, sf: str) -> DataFrame:
    found = T3.train_ranker(P.samples(spark, sf), P.alerts(spark, sf), limit=500)[0].importances()
    falling = all(abs(a[1]) >= abs(b[1]) for a, b in zip(found, found[1:], strict=False))
    return spark.createDataFrame([(len({n for n, _ in found}), falling)], "names int, falling boolean")


@register("config_files", """SELECT 'key' || c_custkey % 40 AS name, '"' || arg_max(c_name, CAST(c_nationkey % 5 AS BIGINT) * 1000000000 + c_custkey) || '"' AS value FROM customer GROUP BY 1""")
def config_files(spark: SparkSession, sf: str) -> DataFrame:
    """Five config files made of the customers, by nation; of a key in several files the last one's value counts."""
    folder = shared_path(spark, "config")
    last = table(spark, sf, "customer").groupBy(F.expr("c_nationkey % 5").alias("file"), F.expr("concat('key', c_custkey % 40)").alias("k")).agg(F.max_by("c_name", "c_custkey").alias("v"))
    for file, text in last.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v"))))).orderBy("file").collect():  # five files of 40 keys at most
        sinks.put_text(spark, f"{folder}/{file}.json", text)
    paths = [f"{folder}/{file}.json" for file in range(5)]
    merged = sinks.load_config(*paths, spark=spark)
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in merged.items()], "name string, value string")


@register("metric_files", with_("ranks") + ", m AS (" + _class_sql("SELECT label AS y, CASE WHEN rank_score >= 0.5 THEN 1 ELSE 0 END AS f FROM ranks") + """)
  SELECT 'summary.csv' AS file, 'classification.tp' AS metric, CAST(tp AS VARCHAR) AS value FROM m UNION ALL SELECT 'summary.csv', 'classification.fp', CAST(fp AS VARCHAR) FROM m UNION ALL SELECT 'summary.csv', 'cost', '' UNION ALL SELECT 'summary.md', 'classification.tp', CAST(tp AS VARCHAR) FROM m
  UNION ALL SELECT 'summary.md', 'classification.fp', CAST(fp AS VARCHAR) FROM m UNION ALL SELECT 'summary.md', 'cost', 'n/a' UNION ALL SELECT 'classification_metrics.json', 'tp', CAST(tp AS VARCHAR) FROM m UNION ALL SELECT 'classification_metrics.json', 'fp', CAST(fp AS VARCHAR) FROM m""")
def metric_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_path(spark, "files")
    r = P.ranks(spark, sf)
    m = E.classification(r, F.col("label"), F.col("rank_score")).select("tp", "fp").first().asDict()
    names = sinks.write_metrics({"classification": m, "cost": None}, folder, spark)
    assert names == ["classification_metrics.json", "metrics.json", "summary.csv", "summary.md"]
    lines = lambda n, skip: spark.read.text(f"{folder}/{n}").where(~F.col("value").rlike(skip) & (F.col("value") != "")).withColumn("file", F.lit(n))
    csv = lines("summary.csv", "^metric,").select("file", F.substring_index("value", ",", 1).alias("metric"), F.substring_index("value", ",", -1).alias("value"))
    part = lambda i: F.trim(F.get(F.split("value", "[|]"), F.lit(i)))
    md = lines("summary.md", r"^#|^\| metric|^\|---").select("file", part(1).alias("metric"), part(2).alias("value"))
    block = spark.read.text(f"{folder}/classification_metrics.json", wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("metric", "value"))
    return csv.union(md).union(block.select(F.lit("classification_metrics.json"), "metric", "value"))


@register("sample_graphs", with_("nodes", "edges") + """ SELECT CAST(graph_id AS VARCHAR) AS graph_id, 'node' AS kind, CAST(id AS VARCHAR) AS a FROM nodes WHERE graph_id IN (SELECT doc_id FROM labels) UNION ALL SELECT CAST(graph_id AS VARCHAR), 'edge', CAST(source AS VARCHAR) FROM edges WHERE graph_id IN (SELECT doc_id FROM labels)""")
def sample_graphs(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "graphs")
    graphs.write_graphs(P.nodes(spark, sf), P.edges(spark, sf), path)
    n, e = graphs.of_samples(table(spark, sf, "labels").selectExpr("doc_id AS sample_id"), *graphs.read_graph(spark, path))
    return n.select("graph_id", F.lit("node").alias("kind"), F.col("id").alias("a")).union(e.select("graph_id", F.lit("edge"), "source"))
