"""Registered queries of the neural ranker and of its encoders, these with fixed weights and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import normalize as N
from siltstone.operators import neural as E
from siltstone.operators import relational as R
from siltstone.operators.common import shared_path
from siltstone.plans import proxies as P
from siltstone.plans import triage as T3
from siltstone.plans.proxies import table, with_
from siltstone.plans.queries import _TOKEN, crc_sql, register, rounded


def fixed(rows: int, cols: int, k: int) -> np.ndarray:
    """Weights by a rule, tenths from -0.9 to 0.9."""
    i, j = np.arange(rows)[:, None], np.arange(cols)[None, :]
    return ((i * 31 + j * 17 + k * 7) % 19 - 9) / 10


def _layer(inputs: int, heads: int, width: int, k: int, concat: bool) -> E.Attention:
    n = heads * width
    return E.Attention(fixed(inputs, n, k), fixed(1, n, k + 1)[0], fixed(inputs, n, k + 2), fixed(1, n, k + 3)[0], fixed(heads, width, k + 4), fixed(1, n if concat else width, k + 5)[0], concat)


LAYERS = [_layer(4, 2, 3, 1, True), _layer(6, 1, 3, 8, False)]


def _layer_sql(a: E.Attention, name: str, source: str, bent: bool) -> str:
    """Common table expressions of one layer over `source` (graph_id, id, x) and arcs (graph_id, source, target)."""
    heads, width = a.attention.shape
    line = lambda w, b: "[" + ", ".join(" + ".join([f"CAST({b[j]} AS DOUBLE)"] + [f"CAST({w[i, j]} AS DOUBLE) * x[{i + 1}]" for i in range(len(w))]) for j in range(len(b))) + "]"
    z = lambda h, k: f"(s.s[{h * width + k + 1}] + t.t[{h * width + k + 1}])"
    score = [" + ".join(f"CAST({a.attention[h, k]} AS DOUBLE) * CASE WHEN {z(h, k)} > 0 THEN {z(h, k)} ELSE CAST({a.slope} AS DOUBLE) * {z(h, k)} END" for k in range(width)) for h in range(heads)]
    mean = [[f"sum(exp(e{h} - m{h}) * s[{h * width + k + 1}]) / sum(exp(e{h} - m{h}))" for k in range(width)] for h in range(heads)]
    flat = [m for x in mean for m in x] if a.concat else ["(" + " + ".join(mean[h][k] for h in range(heads)) + f") / {heads}" for k in range(width)]
    out = [f"{m} + CAST({b} AS DOUBLE)" for m, b in zip(flat, a.bias, strict=True)]
    x = "list_transform(x, lambda v: CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END)" if bent else "x"
    return f"""
{name}_v AS (SELECT graph_id, id, {line(a.source, a.source_bias)} AS s, {line(a.target, a.target_bias)} AS t FROM {source}),
{name}_e AS (SELECT e.graph_id, e.target, s.s, {", ".join(f"{x} AS e{h}" for h, x in enumerate(score))} FROM (SELECT * FROM arcs WHERE source <> target UNION ALL SELECT graph_id, id, id FROM {source}) e
  JOIN {name}_v s ON s.graph_id = e.graph_id AND s.id = e.source JOIN {name}_v t ON t.graph_id = e.graph_id AND t.id = e.target),
{name}_m AS (SELECT graph_id, target, {", ".join(f"max(e{h}) AS m{h}" for h in range(heads))} FROM {name}_e GROUP BY ALL),
{name} AS (SELECT graph_id, id, {x} AS x FROM (SELECT graph_id, target AS id, [{", ".join(out)}] AS x FROM {name}_e JOIN {name}_m USING (graph_id, target) GROUP BY graph_id, target))"""


_NODES = "conv_id // 8 AS graph_id, conv_id * 100 + turn AS id, [turn / CAST(10 AS DOUBLE), least(length(coalesce(text, '')), 1000) / CAST(1000 AS DOUBLE), CAST(CASE WHEN role = 'user' THEN 1 ELSE 0 END AS DOUBLE), CAST(1 AS DOUBLE)] AS x"
_ARCS = """SELECT conv_id // 8 AS graph_id, conv_id * 100 + turn AS source, conv_id * 100 + turn + 1 AS target FROM conversations UNION ALL SELECT conv_id // 8, conv_id * 100 + turn, conv_id // 8 * 800 FROM conversations"""


@register("graph_encoder", f"WITH nodes AS (SELECT {_NODES} FROM conversations), arcs AS ({_ARCS}), {_layer_sql(LAYERS[0], 'one', 'nodes', True)}, {_layer_sql(LAYERS[1], 'two', 'one', False)} SELECT g.graph_id, "
          + ", ".join(f"coalesce(round(v{k}, 6), 0) AS v{k}" for k in range(3)) + " FROM (SELECT DISTINCT conv_id // 4 AS graph_id FROM conversations) g LEFT JOIN (SELECT graph_id, " + ", ".join(f"avg(x[{k + 1}]) AS v{k}" for k in range(3)) + " FROM two GROUP BY graph_id) USING (graph_id)")
def graph_encoder(spark: SparkSession, sf: str) -> DataFrame:
    """Two attention layers over graphs of eight conversations: each turn leads to the next, and all to the graph's first. Half of the asked graphs have no nodes."""
    c = table(spark, sf, "conversations")
    nodes = c.selectExpr("conv_id div 8 AS graph_id", "conv_id * 100 + turn AS id", "array(turn / 10D, least(length(coalesce(text, '')), 1000) / 1000D, CAST(role = 'user' AS double), 1D) AS x")
    nodes = nodes.withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(0.0))))
    arcs = c.selectExpr("conv_id div 8 AS graph_id", "conv_id * 100 + turn AS source", "conv_id * 100 + turn + 1 AS target").union(c.selectExpr("conv_id div 8", "conv_id * 100 + turn", "conv_id div 8 * 800"))
    got = E.encode_graphs(c.selectExpr("conv_id div 4 AS graph_id").distinct(), nodes, arcs, LAYERS)
    return rounded(got.select("graph_id", *[F.get("vector", F.lit(k)).alias(f"v{k}") for k in range(3)]))


@register("token_means", f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_TOKEN}')[:256]) AS w FROM documents), k AS (SELECT w, {crc_sql('w')} % 4096 AS slot FROM (SELECT DISTINCT w FROM t))
  SELECT doc_id, """ + ", ".join(f"coalesce(round(v{d}, 9), 0) AS v{d}" for d in range(4)) + " FROM documents LEFT JOIN (SELECT doc_id, " + ", ".join(f"avg((slot * {d + 3} % 97 - 48) / CAST(53 AS DOUBLE)) AS v{d}" for d in range(4)) + " FROM t JOIN k USING (w) GROUP BY doc_id) USING (doc_id)")
def token_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", E.slots(F.col("text")).alias("slots"))
    embedding = spark.range(4096).select(F.col("id").cast("int").alias("slot"), F.array(*[(F.col("id") * (d + 3) % 97 - 48) / F.lit(53.0) for d in range(4)]).alias("vector"))
    got = E.token_means(rows, embedding, 4, "doc_id")
    return rounded(got.select("doc_id", *[F.get("vector", F.lit(d)).alias(f"v{d}") for d in range(4)]), 9)


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Feature records of all samples; the graph of a sample is the conversation of its number."""
    s = P.samples(spark, sf).withColumn("span", N.span(F.lit("f.c"), F.col("code")))
    c = table(spark, sf, "conversations")
    nodes = c.selectExpr("conv_id AS graph_id", "turn AS id", "turn AS ord", "role AS type", "text AS code", "CAST(turn + 1 AS int) AS line")
    edges = c.selectExpr("conv_id AS graph_id", "turn AS ord", "turn AS source", "turn + 1 AS target", "'CFG' AS type")
    return T3.build_features(s, P.alerts(spark, sf), nodes, edges)


@register("neural_scores")
def neural_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all samples by the neural ranker, learnt on the train part of a stratified split."""
    f = R.stratified_split(features(spark, sf))
    path = shared_path(spark, "inputs")
    E.inputs(f, keep=("split",)).write.parquet(path)
    rows, run = spark.read.parquet(path), shared_path(spark, "neural")
    E.train(rows.where("split = 'train'"), run, plan=E.Plan(epochs=3))
    scores = E.score(rows, E.load(spark, run, E.Shape())).withColumnRenamed("sample_id", "i")
    return R.rank_rows(rows.select("sample_id", "label", "split").join(scores, F.col("sample_id") == F.col("i")).drop("i"))
