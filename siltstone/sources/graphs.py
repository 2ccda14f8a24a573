"""Program graph files (JSON, GraphML) and SARIF, as node, edge and alert tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.normalize import coerce_line
from siltstone.operators.common import cut
from siltstone.sources.ranges import json_pieces

# Attribute names of node fields in graph exports, the first present counts.
NODE_NAMES = {
    "type": ("type", "label", "TYPE"), "code": ("code", "CODE"), "file": ("file", "filename", "FILENAME", "FILE"),
    "line": ("line", "lineNumber", "LINE_NUMBER"), "function": ("function", "method", "METHOD_FULL_NAME", "name", "NAME"),
}
EDGE_NAMES = ("type", "label", "TYPE")


def _name(path: Column | None = None) -> Column:
    """A file's graph: its folder graph_id=..., as write_graphs names it, else its stem."""
    p = F.col("_metadata.file_path") if path is None else path
    return F.coalesce(F.nullif(F.regexp_extract(p, r"/graph_id=([^/]+)/[^/]*$", 1), F.lit("")), F.regexp_replace(F.regexp_extract(p, r"([^/]*)$", 1), r"\.[^.]*$", ""))


def _last(nodes: DataFrame) -> DataFrame:
    """One row a node id: the last values at the first place."""
    rest = [c for c in nodes.columns if c not in ("graph_id", "id", "ord")]
    return nodes.groupBy("graph_id", "id").agg(F.min("ord").alias("ord"), F.max_by(F.struct(*rest), "ord").alias("r")).select("graph_id", "id", "ord", "r.*")


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of simple JSON graphs; graph_id is the file's stem."""
    return _of_documents(spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(_name().alias("graph_id"), F.from_json("value", _GRAPH).alias("d")))


_GRAPH = "struct<nodes:array<struct<id:string,type:string,code:string,file:string,line:string,function:string,properties:string>>,edges:array<struct<source:string,target:string,type:string,properties:string>>>"


def _of_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed documents (graph_id, d)."""
    n = docs.select("graph_id", F.posexplode("d.nodes").alias("ord", "n"))
    nodes = n.select("graph_id", "n.id", "ord", "n.type", "n.code", "n.file", coerce_line(F.col("n.line")).alias("line"), "n.function", "n.properties")
    e = docs.select("graph_id", F.posexplode("d.edges").alias("ord", "e"))
    return _last(nodes), e.select("graph_id", "ord", "e.source", "e.target", "e.type", "e.properties")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML files with key declarations, each file's own; namespaces are ignored."""
    def x(tag: str, schema: str) -> DataFrame:
        r = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").option("nullValue", "\x00").option("recursiveFileLookup", "true").schema(schema).load(path)
        return r.select("*", F.col("_metadata.file_path").alias("p"))

    keys = x("key", "_id string, `_attr.name` string").where("_id is not null").select("p", F.col("_id").alias("k"), F.coalesce(F.col("`_attr.name`"), F.col("_id")).alias("name")).distinct()
    names = keys.groupBy(F.col("p").alias("n_p")).agg(F.map_from_entries(F.collect_list(F.struct("k", "name"))).alias("names"))  # a file's declarations
    data = "data array<struct<_VALUE:string,_key:string>>"

    def attrs(df: DataFrame) -> DataFrame:
        df = df.withColumn("ord", F.monotonically_increasing_id()).join(names, F.col("p") == F.col("n_p"), "left")
        pairs = F.filter(F.transform(F.coalesce("data", F.array().cast("array<struct<_VALUE:string,_key:string>>")), lambda d: F.struct(F.coalesce(F.try_element_at("names", d["_key"]), d["_key"]).alias("k"), F.trim(d["_VALUE"]).alias("v"))), lambda p: F.coalesce(p["v"], F.lit("")) != "")
        return df.withColumn("a", F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))))

    pick = lambda names_: F.coalesce(*[F.try_element_at("a", F.lit(n)) for n in names_])
    gid = _name(F.col("p")).alias("graph_id")
    used = [n for v in NODE_NAMES.values() for n in v]
    n = attrs(x("node", f"_id string, {data}").where("_id is not null"))
    nodes = n.select(gid, F.col("_id").alias("id"), "ord", *[(coerce_line(pick(v)) if k == "line" else pick(v)).alias(k) for k, v in NODE_NAMES.items()], F.to_json(F.map_filter("a", lambda k, _: ~k.isin(*used))).alias("properties"))
    e = attrs(x("edge", f"_source string, _target string, _label string, {data}").where("_source is not null and _target is not null"))
    edges = e.select(gid, "ord", F.col("_source").alias("source"), F.col("_target").alias("target"), F.coalesce(pick(EDGE_NAMES), "_label").alias("type"), F.to_json(F.map_filter("a", lambda k, _: ~k.isin(*EDGE_NAMES))).alias("properties"))
    return _last(nodes), edges


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """By extension: .graphml and .xml, else JSON."""
    return read_graphml(spark, path) if path.lower().endswith((".graphml", ".xml")) else read_graph_json(spark, path)


def of_samples(samples: DataFrame, nodes: DataFrame, edges: DataFrame, sample_id: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of the samples' graphs, whose ids are those of the samples; samples without a graph have none."""
    ids = samples.select(F.col(sample_id).cast("string").alias("_i")).distinct()
    own = lambda df: df.join(ids, F.col("graph_id").cast("string") == F.col("_i"), "left_semi")
    return own(nodes), own(edges)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, json): each graph as one JSON document, nodes and edges in order, properties kept if there are."""
    def packed(df: DataFrame, *cols: str) -> tuple[Column, DataFrame]:
        own = [*cols, *(["properties"] if "properties" in df.columns else [])]
        kind = df.select(F.array(F.struct(*own))).schema[0].dataType.simpleString()
        return F.array().cast(kind), df.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*own).alias("x")))), lambda r: r["x"]).alias("rows"))

    no_nodes, n = packed(nodes, "id", "type", "code", "file", "line", "function")
    no_edges, e = packed(edges, "source", "target", "type")
    both = n.withColumnRenamed("rows", "nodes").join(e.withColumnRenamed("rows", "edges"), "graph_id", "full")
    return both.select("graph_id", F.to_json(F.struct(F.coalesce("nodes", no_nodes).alias("nodes"), F.coalesce("edges", no_edges).alias("edges")), {"ignoreNullFields": "false"}).alias("json"))


def write_graphs(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A JSON document a graph, in folders graph_id=..., which read_graph_json understands. For few graphs; write_graph_lines packs many into a file."""
    docs = graph_json(nodes, edges)
    docs.select(F.col("json").alias("value"), "graph_id").repartition("graph_id").write.mode("overwrite").partitionBy("graph_id").text(folder)


def write_graph_lines(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """JSON lines {graph_id, graph}, many graphs a file and as many files as tasks."""
    graph_json(nodes, edges).select(F.col("graph_id").cast("string").alias("graph_id"), F.col("json").alias("graph")).write.mode("overwrite").option("compression", "gzip").json(folder)


def read_graph_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of what write_graph_lines wrote."""
    return _of_documents(spark.read.schema("graph_id string, graph string").json(folder).select("graph_id", F.from_json("graph", _GRAPH).alias("d")))


_REGION = "struct<startLine:int,endLine:int>"
_PLACE = f"struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:{_REGION}>>"
_RESULT = f"struct<ruleId:string,ruleIndex:int,level:string,message:struct<text:string>,locations:array<{_PLACE}>,codeFlows:array<struct<threadFlows:array<struct<locations:array<struct<location:{_PLACE}>>>>>>>"
_RULE = "struct<id:string,properties:struct<tags:array<string>,`problem.severity`:string>,defaultConfiguration:struct<level:string>>"
_TOOL = f"struct<driver:struct<name:string,rules:array<{_RULE}>>>"
#: Depths in a SARIF file: its runs' objects, and what their members hold.
_RUN, _HELD = 3, 4


def _results(spark: SparkSession, path: str) -> DataFrame:
    """(p, run, i, raw, rules): the results of SARIF files, read by byte ranges, with their runs' rules.

    A file is cut at the depth of the results; the shallow pieces between, a few a run, say which container the deep ones
    after them belong to, and how many runs have begun.
    """
    pieces = cut(json_pieces(spark, path, _HELD, _RUN))
    by = W.partitionBy("file").orderBy("ord")  # a file's shallow pieces
    shallow = pieces.where("not deep").select(
        F.col("file").alias("p"), (F.sum("opened").over(by) - 1).alias("run"), F.regexp_extract("text", r'"([^"]*)"\s*:\s*[\[{]\s*$', 1).alias("key"),
        F.col("ord").alias("start"), F.coalesce(F.lead("ord").over(by), F.lit((1 << 62)).cast("long")).alias("end"),
    )
    held = F.broadcast(shallow.where("key in ('results', 'tool')"))
    deep = pieces.where("deep and text <> ''").join(held, (F.col("file") == F.col("p")) & (F.col("ord") > F.col("start")) & (F.col("ord") < F.col("end")))
    tools = deep.where(F.col("key") == "tool").where(F.col("text").startswith('"driver"'))
    rules = tools.select(F.col("p").alias("r_p"), F.col("run").alias("r_run"), F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), _TOOL)["driver"]["rules"].alias("rules"))
    found = deep.where(F.col("key") == "results").select("p", "run", (F.col("ord") - F.col("start") - 1).alias("i"), F.get_json_object("text", "$").alias("raw"))
    return found.join(F.broadcast(rules), (F.col("p") == F.col("r_p")) & (F.col("run") == F.col("r_run")), "left").drop("r_p", "r_run")  # a row a run


def read_sarif(spark: SparkSession, path: str, sample_id: str = "unknown", tool: str = "codeql") -> DataFrame:
    """Alert records of SARIF files with ord. A rule index resolves by the rules table, the end defaults to the start, the
    severity is the level, weakness ids come from tags, trace lines from code flows; raw keeps the result."""
    rows = _results(spark, path)
    sizes = rows.groupBy("p", "run").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("p").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a file's runs
    first = sizes.select(F.col("p").alias("f_p"), F.col("run").alias("f_run"), before.alias("before"))
    rows = rows.join(F.broadcast(first), (F.col("p") == F.col("f_p")) & (F.col("run") == F.col("f_run"))).drop("f_p", "f_run")
    x = rows.withColumn("x", F.from_json("raw", _RESULT))
    rule_id = F.coalesce("x.ruleId", F.get("rules", F.col("x.ruleIndex"))["id"], F.lit("unknown"))
    x = x.withColumn("rule_id", rule_id).withColumn("rule", F.get(F.filter("rules", lambda r: r["id"] == F.col("rule_id")), F.lit(0)))
    place = F.get("x.locations", F.lit(0))["physicalLocation"]
    start = F.coalesce(place["region"]["startLine"], F.lit(1))
    tags = F.coalesce("rule.properties.tags", F.array().cast("array<string>"))
    cwe = F.array_distinct(F.transform(F.filter(tags, lambda t: F.lower(t).rlike(r"cwe[-/]?0*\d+$")), lambda t: F.concat(F.lit("CWE-"), F.regexp_extract(F.lower(t), r"cwe[-/]?0*(\d+)$", 1))))
    steps = F.flatten(F.flatten(F.transform("x.codeFlows", lambda c: F.transform(c["threadFlows"], lambda t: F.transform(t["locations"], lambda s: s["location"]["physicalLocation"]["region"]["startLine"])))))
    trace = F.filter(F.coalesce(F.array_distinct(steps), F.array().cast("array<int>")), lambda s: s >= 1)
    return x.select(
        F.lit(sample_id).alias("sample_id"), F.lit(tool).alias("tool"), F.col("rule_id").alias("query_id"), F.coalesce("x.message.text", F.lit("")).alias("message"), F.coalesce("x.level", "rule.defaultConfiguration.level").alias("severity"),
        F.coalesce(place["artifactLocation"]["uri"], F.lit("unknown")).alias("file"), start.alias("start_line"), F.greatest(start, F.coalesce(place["region"]["endLine"], start)).alias("end_line"), cwe.alias("cwe"), trace.alias("trace_lines"), "raw", (F.col("before") + F.col("i")).cast("long").alias("ord"),
    )
