import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import ranker as K
from siltstone.operators import verify as V
from siltstone.plans import triage
from siltstone.schemas import ALERT
from siltstone.sources import sinks


def test_end_to_end(spark, tmp_path):
    bad = "void f{i}(char *p) {{\n  char b[8];\n  strcpy(b, p);\n}}"
    good = "int g{i}(int a) {{\n  return a + {i};\n}}"
    rows = [{"idx": i, "func": (bad if i % 3 == 0 else good).format(i=i), "target": int(i % 3 == 0), "file": f"src/f{i}.c"} for i in range(60)]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, [*rows, rows[0] | {"idx": 99}])))
    m = triage.build_manifest(spark, str(tmp_path / "d.jsonl"), "devign").cache()
    assert m.count() == 60 and set(r[0] for r in m.select("split").distinct().collect()) == {"train", "valid", "test"}
    alerts = spark.createDataFrame([(f"devign_{i}", "codeql", "cpp/x", "m", "error", f"f{i}.c", 3, 3, ["CWE-120"], [2], None, i) for i in range(0, 60, 3)], ALERT + ", ord int")
    nodes = spark.createDataFrame([("devign_0", "a", 0, "CALL", "strcpy(b, p)", "f0.c", 3, "f0"), ("devign_0", "b", 1, "ID", "p", "f0.c", 1, "f0")], "graph_id string, id string, ord int, type string, code string, file string, line int, function string")
    edges = spark.createDataFrame([("devign_0", 0, "a", "b", "DDG"), ("devign_0", 1, "a", "z", "DDG")], "graph_id string, ord int, source string, target string, type string")
    f = triage.build_features(m, alerts, nodes, edges).cache()
    x = f.where("sample_id = 'devign_0'").first()
    assert x["alert_lines"] == [3] and x["trace_lines"] == [2] and len(x["nodes"]) == 2 and [tuple(e) for e in x["edges"]] == [(0, 1, "DDG")] and x["static_features"]["graph_edge_count"] == 2.0 and x["static_features"]["dangerous_api_count"] == 1.0 and len(x["code_lines"]) == 4
    ranker, ranked, metrics = triage.train_ranker(m, alerts, manifest=m.select("sample_id", "split"))
    assert {r["split"]: r["f1"] for r in metrics.collect()}["train"] == 1.0
    ranker.save(spark, str(tmp_path / "ranker"))
    again = triage.Ranker.load(spark, str(tmp_path / "ranker"))
    assert again.names == ranker.names and again.importances() == ranker.importances() and any(n == "strcpy" for n, _ in again.importances())
    assert sinks.write_jsonl(m.select("sample_id"), str(tmp_path / "ids")) == 60  # before the model is sent to tasks again
    numbers = K.numeric_rows(m, alerts)
    first, second = ({r["sample_id"]: r["rank_score"] for r in x.collect()} for x in (again.score(numbers, m), ranked))
    assert all(abs(first[k] - second[k]) < 1e-12 for k in second)
    forest, _, byforest = triage.train_ranker(m, alerts, manifest=m.select("sample_id", "split"), model="random_forest", trees=20)
    forest.save(spark, str(tmp_path / "forest"))
    assert {r["split"]: r["f1"] for r in byforest.collect()}["train"] == 1.0 and triage.Ranker.load(spark, str(tmp_path / "forest")).score(numbers, m).count() == 60
    with pytest.raises(ValueError):
        triage.train_ranker(m, alerts, model="boosting")
    graphs = spark.createDataFrame([("devign_0", '{"sinks": [3]}')], "sample_id string, evidence string")
    packets, missed = triage.packets(f.where("sample_id <> 'devign_3'"), ranked, alerts, 20, graphs)
    assert packets.count() == 19 and [r[0] for r in missed.collect()] == ["devign_3"]
    one = packets.where("sample_id = 'devign_0'").first()
    summary = json.loads(one["context"]["evidence_summary"])
    assert summary["graph_summary"] == {"sinks": [3]} and summary["static_alert_count"] == 1 and summary["alert_summaries"][0]["severity"] == "error" and len(summary) == 11
    assert triage.dry_run(f, ranked, alerts, str(tmp_path / "dry"), V.VerifierConfig(top_k=5)) == 5
    dry = spark.read.json(str(tmp_path / "dry")).first()
    assert [m["role"] for m in dry["messages"]] == ["system", "user"]
    prompts = triage.prompts_for(f, ranked, alerts, 10)
    verdicts = V.mock_verdicts(prompts).withColumns({"patch_hint": F.lit(""), "ord": F.lit(0)})
    assert verdicts.count() == 10
    found = triage.fuse(f, ranked.withColumn("ord", F.lit(0)), alerts, verdicts).cache()
    truth = spark.createDataFrame([("devign_0", [3])], "sample_id string, vulnerable_lines array<int>")
    out = triage.evaluate(m, found, ranked, truth=truth)
    assert out["num_samples"] == 60 and out["ranking"]["mrr"] == 1.0 and out["classification"]["roc_auc"] == 1.0 and out["localization"]["top1_hit"] == 1.0 and out["cost"] is None
