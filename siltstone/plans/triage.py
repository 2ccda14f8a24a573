"""The triage stages as functions of tables: manifest, features, ranker, verification, fusion and evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import code_lines
from siltstone.operators import alerts as A
from siltstone.operators import evaluation as E
from siltstone.operators import fusion as U
from siltstone.operators import graph as G
from siltstone.operators import ranker as K
from siltstone.operators import relational as R
from siltstone.operators import verify as V
from siltstone.operators.common import cut
from siltstone.schemas import validate
from siltstone.sources.records import load_dataset
from siltstone.sources.sinks import write_jsonl

_NONE = "array<int>"


def build_manifest(spark: SparkSession, path: str, dataset: str, *, dedup: str | None = "normalized", split: str | None = "random", time: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Sample records of a dataset file, checked, deduplicated and split. time: (sample_id, ts) for the split by time."""
    s = validate(load_dataset(spark, path, dataset), "sample", strict=True).where("valid").drop("valid", "reasons")
    if dedup:
        s = R.deduplicate(s, "code", "ord", dedup)
    if split == "random":
        return R.random_split(s, seed=seed)
    if split == "time":
        t = time if time is not None else spark.createDataFrame([], "sample_id string, ts double")
        return R.time_split(s.join(t, "sample_id", "left"), "ts").drop("ts")
    return s


def build_features(samples: DataFrame, alerts: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Feature records: lines, line sets, graph (nodes and edges with graph_id as sample_id) and the nine static features."""
    lines = A.line_unions(alerts)
    summary = A.static_summary(alerts)
    f = samples.join(lines, "sample_id", "left").join(summary, "sample_id", "left")
    for c in ("alert_lines", "trace_lines"):
        f = f.withColumn(c, F.coalesce(c, F.array().cast(_NONE)))
    if nodes is not None and edges is not None:
        n = nodes.join(f.select(F.col("sample_id").alias("graph_id"), "alert_lines", "trace_lines", F.col("span.start_line").alias("_s"), F.col("span.end_line").alias("_e")), "graph_id")
        own = G.feature_nodes(n, F.col("alert_lines"), F.col("trace_lines"), F.col("_s"), F.col("_e"))
        arcs = G.feature_edges(own, edges)
        na = _ordered(own)
        ea = arcs.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source", "target", "edge_type"))), lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), x["edge_type"].alias("edge_type"))).alias("edges"))
        g = G.summary(nodes, edges).join(na, "graph_id", "left").join(ea, "graph_id", "left").withColumnRenamed("graph_id", "sample_id")
        f = f.join(g, "sample_id", "left")
    else:
        f = f.withColumns({c: F.lit(0).cast("long") for c in ("graph_node_count", "graph_edge_count", "dangerous_api_count")})
    count = F.col("span.end_line") - F.col("span.start_line") + 1
    keys = ("alert_count", "trace_line_count", "unique_query_count", "has_codeql_alert", "max_severity_score", "graph_node_count", "graph_edge_count", "dangerous_api_count")
    static = F.create_map(*[x for k in keys for x in (F.lit(k), F.coalesce(F.col(k), F.lit(0)).cast("double"))], F.lit("function_line_count"), count.cast("double"))
    out = f.withColumns({"function_code": F.coalesce("code", F.lit("")), "code_lines": code_lines(F.col("code")), "static_features": static})
    return out.drop(*keys, "code")


def _ordered(own: DataFrame) -> DataFrame:
    """Nodes of each graph in order; maps cannot be compared, so the order comes from a sort by index alone."""
    pairs = F.collect_list(F.struct("index", "node_id", "node_type", "code", "line", "line_index", F.map_entries("static_flags").alias("flags")))
    node = lambda x: F.struct(x["node_id"].alias("node_id"), x["node_type"].alias("node_type"), x["code"].alias("code"), x["line"].alias("line"), x["line_index"].alias("line_index"), F.map_from_entries(x["flags"]).alias("static_flags"))
    return own.groupBy("graph_id").agg(F.transform(F.array_sort(pairs), node).alias("nodes"))


@dataclass
class Ranker:
    """A fitted ranker: the model, its number columns with their deviations, and the vocabulary (term, idf) of its terms."""

    model: Model
    names: list[str]
    deviations: dict[str, float]
    vocab: DataFrame

    def score(self, rows: DataFrame, samples: DataFrame, code: str = "code") -> DataFrame:
        """rows (numbers of the samples) with rank_score."""
        return K.predict(self.model, _ready(rows, K.cut_texts(samples, code=code), self.names, self.deviations, self.vocab)).drop("features")

    def importances(self) -> list[tuple[str, float]]:
        terms = [r[0] for r in self.vocab.select("term").orderBy("term").collect()]  # no longer than the vocabulary's limit
        return K.importances(self.model, [*terms, *self.names])

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
        kind = "random_forest" if hasattr(self.model, "featureImportances") else "logistic_regression"
        spark.createDataFrame([(i, n, self.deviations[n], kind) for i, n in enumerate(self.names)], "place int, name string, deviation double, model string").write.mode("overwrite").json(f"{path}/columns")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ranker:
        rows = spark.read.schema("place int, name string, deviation double, model string").json(f"{path}/columns").orderBy("place").collect()  # a row a column
        kind = RandomForestClassificationModel if rows and rows[0][3] == "random_forest" else LogisticRegressionModel
        return Ranker(kind.load(f"{path}/model"), [r[1] for r in rows], {r[1]: r[2] for r in rows}, spark.read.parquet(f"{path}/vocabulary"))


def _ready(rows: DataFrame, cuts: DataFrame, names: Sequence[str], deviations: dict[str, float], vocab: DataFrame) -> DataFrame:
    return K.assemble(K.scale(rows, deviations), names, K.term_vectors(cuts, vocab), vocab.count())


def train_ranker(samples: DataFrame, alerts: DataFrame, *, manifest: DataFrame | None = None, code: str = "code", threshold: float = 0.5, model: str = "logistic_regression", limit: int = 20_000, seed: int = 42, trees: int = 300) -> tuple[Ranker, DataFrame, DataFrame]:
    """(ranker, ranked rows, metrics by split) of terms and numbers, learnt on the train split: the manifest's if it is usable,
    else a stratified one. Vocabulary, idf and deviations come from the train split alone."""
    rows = K.numeric_rows(samples, alerts, code)
    rows = cut(R.resolve_split(rows, manifest) if manifest is not None else R.stratified_split(rows, seed=seed))
    names, train = list(K.NUMBERS), rows.where("split = 'train'")
    cuts = K.cut_texts(samples, train, code)
    vocab = cut(K.vocabulary_of(cuts, train.count(), limit).select("term", "idf"))
    deviations = K.scaler(train, names)
    ready = _ready(rows, cuts, names, deviations, vocab)
    ranker = Ranker(K.fit(ready.where("split = 'train'"), model=model, seed=seed, trees=trees), names, deviations, vocab)
    scored = K.predict(ranker.model, ready).select("sample_id", "label", "split", "rank_score")
    return ranker, R.rank_rows(scored), E.classification(scored, F.col("label"), F.col("rank_score"), threshold, "split")


def packets(features: DataFrame, ranks: DataFrame, alerts: DataFrame, k: int, graphs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(packets, missed): verification packets of the k best samples, with their rank, and the ids among these without features.

    graphs: (sample_id, evidence), the graph evidence as JSON text.
    """
    best = R.top_k(ranks, k).select("sample_id", "rank_score", "rank")
    f = best.join(features, "sample_id").join(A.grouped(alerts, "ord"), "sample_id", "left")
    if graphs is not None:
        f = f.join(graphs.select("sample_id", F.col("evidence").alias("graph_evidence")), "sample_id", "left")
    return V.packet(V.evidence_summary(f)), best.join(features, "sample_id", "left_anti").select("sample_id", "rank")


def dry_run(features: DataFrame, ranks: DataFrame, alerts: DataFrame, path: str, config: V.VerifierConfig | None = None, graphs: DataFrame | None = None) -> int:
    """Writes the messages of the best samples as JSON lines, by rank, without calling any client; returns their number."""
    c = config or V.VerifierConfig()
    found, _ = packets(features, ranks, alerts, c.top_k or max(1, ranks.count()), graphs)
    return write_jsonl(V.messages(V.prompt_of(found)).orderBy("rank").select("sample_id", "messages"), path)


def prompts_for(features: DataFrame, ranks: DataFrame, alerts: DataFrame, k: int) -> DataFrame:
    """Prompts of the k best samples that have features."""
    return V.prompt_of(packets(features, ranks, alerts, k)[0])


def fuse(features: DataFrame, ranks: DataFrame, alerts: DataFrame, verdicts: DataFrame, threshold: float = 0.5) -> DataFrame:
    return U.findings(U.fuse(U.join_signals(features, ranks, alerts, verdicts), threshold))


def evaluate(labels: DataFrame, findings: DataFrame, ranks: DataFrame, *, truth: DataFrame | None = None, cost_log: DataFrame | None = None, threshold: float = 0.5, ks: Sequence[int] = (1, 5, 10, 20)) -> dict[str, Any]:
    """Metric blocks as one nested dict; localisation and cost are None without their tables.

    A sample's score is its final confidence for the classification, its rank score or else that confidence for the ranking.
    """
    f = findings.select("sample_id", F.col("final_confidence").alias("_f"))
    j = labels.select("sample_id", "label").join(f, "sample_id", "left").join(ranks.select("sample_id", F.col("rank_score").alias("_r")), "sample_id", "left")
    j = j.select("sample_id", "label", F.coalesce("_f", F.lit(0.0)).alias("final"), F.coalesce("_r", "_f", F.lit(0.0)).alias("rank_score"))
    one = lambda df: df.first().asDict()  # noqa: E731  one row each
    return {
        "num_samples": j.count(),
        "classification": one(E.classification(j, F.col("label"), F.col("final"), threshold)) | one(E.aucs(j, F.col("label"), F.col("final"))),
        "ranking": one(E.ranking(R.rank_rows(j), "label", ks)),
        "localization": one(E.localization(truth, findings)) if truth is not None else None,
        "cost": one(E.costs(cost_log)) if cost_log is not None else None,
    }
