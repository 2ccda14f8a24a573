"""Program graphs as tables: nodes (graph_id, id, ord, type, code, file, line, function) and edges (graph_id, ord, source, target, type)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.lines import to_relative
from siltstone.functions.normalize import paths_match
from siltstone.functions.text import SINK_TERMS, SOURCE_TERMS, contains_any
from siltstone.operators.common import cut

NO_LINE = 1_000_000_000


def both_ways(edges: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """(graph_id, id, other, type): edges in both directions, of the given types only."""
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    return e.select("graph_id", F.col("source").alias("id"), F.col("target").alias("other"), "type").union(e.select("graph_id", "target", "source", "type"))


def neighbors(edges: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    return both_ways(edges, types).select("graph_id", "id", "other").distinct()


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, id, others): sorted neighbours; dangling edges are left out, isolated nodes have none."""
    n = nodes.select("graph_id", "id")
    pairs = neighbors(edges).join(n, ["graph_id", "id"], "left_semi").join(n.withColumnRenamed("id", "other"), ["graph_id", "other"], "left_semi")
    got = pairs.groupBy("graph_id", "id").agg(F.array_sort(F.collect_set("other")).alias("others"))
    return n.join(got, ["graph_id", "id"], "left").withColumn("others", F.coalesce("others", F.expr("slice(array(id), 1, 0)")))


def induced(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the subgraph over kept (graph_id, id); nodes keep their order."""
    k = kept.select("graph_id", "id").distinct()
    e = edges.join(k.withColumnRenamed("id", "source"), ["graph_id", "source"], "left_semi").join(k.withColumnRenamed("id", "target"), ["graph_id", "target"], "left_semi")
    return nodes.join(k, ["graph_id", "id"], "left_semi"), e


def in_function(file: str, start: int, end: int, function: str | None = None) -> Column:
    """Nodes of a function: path matches, and the names agree (one may end with the other) or the line is in the span."""
    name = F.col("function").isNotNull() & ((F.col("function") == function) | F.endswith("function", F.lit(function)) | F.endswith(F.lit(function), "function")) if function else F.lit(False)
    return paths_match(F.col("file"), F.lit(file)) & F.coalesce(name | F.col("line").between(start, end), F.lit(False))


def slice_function(nodes: DataFrame, edges: DataFrame, file: str, start: int, end: int, function: str | None = None) -> tuple[DataFrame, DataFrame]:
    return induced(nodes, edges, nodes.where(in_function(file, start, end, function)))


def seeds(nodes: DataFrame, file: str, lines: Sequence[int]) -> DataFrame:
    return nodes.where(paths_match(F.col("file"), F.lit(file)) & F.col("line").isin(*lines)).select("graph_id", "id") if lines else nodes.select("graph_id", "id").where("false")


def distances(edges: DataFrame, start: DataFrame, k: int, types: Sequence[str] | None = None) -> DataFrame:
    """(graph_id, id, dist): distance from the nearest start node up to k; each step expands only what it reached first."""
    ways = neighbors(edges, types)
    seen = start.select("graph_id", "id").distinct().withColumn("dist", F.lit(0))
    front = seen
    for step in range(1, k + 1):
        nxt = front.join(ways, ["graph_id", "id"]).select("graph_id", F.col("other").alias("id")).distinct()
        front = nxt.join(seen.select("graph_id", "id"), ["graph_id", "id"], "left_anti").withColumn("dist", F.lit(step))
        seen = seen.union(front)
        if step % 3 == 0 and step < k:  # keep plans short
            seen = cut(seen)
            front = seen.where(F.col("dist") == step)
    return seen


def slice_around(nodes: DataFrame, edges: DataFrame, file: str, lines: Sequence[int], k: int = 2, types: Sequence[str] | None = None, max_nodes: int = 400) -> tuple[DataFrame, DataFrame]:
    """Subgraph within k steps of the lines; the type filter concerns the steps only. Over max_nodes the nearest stay."""
    near = distances(edges, seeds(nodes, file, lines), k, types)
    known = near.join(nodes.select("graph_id", "id", "line"), ["graph_id", "id"])
    order = W.partitionBy("graph_id").orderBy("dist", F.coalesce("line", F.lit(NO_LINE)), "id")
    return induced(nodes, edges, known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_nodes))


def feature_nodes(nodes: DataFrame, alert_lines: Column, trace_lines: Column, start: Column, end: Column) -> DataFrame:
    """Nodes with index (from 0, in order), relative line and four flags."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    code = F.coalesce("code", F.lit(""))
    flags = F.create_map(
        F.lit("is_alert_line"), flag(F.array_contains(alert_lines, F.col("line"))), F.lit("is_trace_line"), flag(F.array_contains(trace_lines, F.col("line"))),
        F.lit("is_source_like"), contains_any(code, SOURCE_TERMS).cast("double"), F.lit("is_sink_like"), contains_any(code, SINK_TERMS).cast("double"),
    )
    index = (F.row_number().over(W.partitionBy("graph_id").orderBy("ord")) - 1).alias("index")
    kind = F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("UNKNOWN"))
    return nodes.select("graph_id", F.col("id").alias("node_id"), index, kind.alias("node_type"), code.alias("code"), "line", to_relative(F.col("line"), start, end).alias("line_index"), flags.alias("static_flags"))


def feature_edges(indexed: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, ord, source, target, edge_type) by node index; dangling edges go."""
    i = indexed.select("graph_id", "node_id", "index")
    a, b = i.withColumnsRenamed({"node_id": "source", "index": "s"}), i.withColumnsRenamed({"node_id": "target", "index": "t"})
    e = edges.join(a, ["graph_id", "source"]).join(b, ["graph_id", "target"])
    return e.select("graph_id", "ord", F.col("s").alias("source"), F.col("t").alias("target"), F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("UNKNOWN")).alias("edge_type"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, graph_node_count, graph_edge_count, dangerous_api_count); dangling edges count."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("graph_node_count"), F.count_if(contains_any(F.coalesce("code", F.lit("")), SINK_TERMS)).alias("dangerous_api_count"))
    e = edges.groupBy("graph_id").agg(F.count("*").alias("graph_edge_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.join(e, "graph_id", "full").select("graph_id", zero("graph_node_count"), zero("graph_edge_count"), zero("dangerous_api_count"))


def collate(graphs: DataFrame, batch: str, order: str) -> DataFrame:
    """graphs (batch, order, n) with offset: nodes of the graphs before it in its batch, and its index there."""
    w = W.partitionBy(batch).orderBy(order)
    before = F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1))
    return graphs.withColumn("offset", F.coalesce(before, F.lit(0))).withColumn("batch_index", F.row_number().over(w) - 1)


def mean_pool(graphs: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """(graph_id, vector): mean of node vectors, zeros for graphs without nodes."""
    means = vectors.select("graph_id", F.posexplode("vector").alias("i", "x")).groupBy("graph_id", "i").agg(F.avg("x").alias("x"))
    got = means.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("vector"))
    return graphs.select("graph_id").join(got, "graph_id", "left").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), width)))
