import json
import random

from siltstone.schemas import SAMPLE
from siltstone.sources import graphs, records, sinks
from siltstone.streaming import stateless


def test_datasets(spark, tmp_path):
    rows = [{"idx": 1, "func": "int a;\nb", "target": 1, "cwe": ["CWE-1", " "]}, {"function": "x", "target": "no", "cwe": "CWE-2;CWE-3", "split": "dev"}]
    (tmp_path / "d.jsonl").write_text("\n\n".join(map(json.dumps, rows)))
    got = {r["label"]: r for r in records.load_dataset(spark, str(tmp_path / "d.jsonl"), "devign").collect()}
    assert got[1]["sample_id"] == "devign_1" and got[1]["cwe"] == ["CWE-1"] and got[1]["span"]["end_line"] == 2 and got[1]["file"] == "unknown"
    assert len(got[0]["sample_id"]) == len("devign_") + 16 and got[0]["cwe"] == ["CWE-2", "CWE-3"] and got[0]["split"] == "valid"
    (tmp_path / "b.csv").write_text('id,func_before,vulnerable,cwe,function_name\n7,"int f() {\n return ""x"";\n}",1,,f\n')
    b = records.load_dataset(spark, str(tmp_path / "b.csv"), "bigvul").first()
    assert b["sample_id"] == "bigvul_7" and b["code"] == 'int f() {\n return "x";\n}' and b["cwe"] == [] and b["function"] == "f"


def test_raw(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"func": "a b", "target": 1}, 5, {"func": " ", "target": 0}, {"func": "c", "idx": 0, "target": 0}], indent=2))
    good, bad = records.load_raw(spark, str(tmp_path / "a.json"), "devign")
    assert [r["sample_id"] for r in good.collect()] == ["devign_0"]
    assert {r["reason"] for r in bad.collect()} == {"empty_code", "duplicate_id"}
    (tmp_path / "v.jsonl").write_text('{"func": "a", "target": 1}\n{broken\n{"func": "b", "target": 0, "id": "q"}\n')
    good, bad = records.load_raw(spark, str(tmp_path / "v.jsonl"), "diversevul")
    assert good.count() == 2 and [r["reason"] for r in bad.collect()] == ["malformed"]


def test_graph_files(spark, tmp_path):
    doc = {"nodes": [{"id": 1, "type": "A", "line": "3"}, {"id": 2, "line": 0}, {"id": 1, "type": "B", "line": 4.0}], "edges": [{"source": 1, "target": 2, "type": "DDG"}]}
    (tmp_path / "s1.json").write_text(json.dumps(doc, indent=1))
    n, e = graphs.read_graph(spark, str(tmp_path / "s1.json"))
    assert [(r["graph_id"], r["id"], r["ord"], r["type"], r["line"]) for r in n.orderBy("ord").collect()] == [("s1", "1", 0, "B", 4), ("s1", "2", 1, None, None)]
    out = json.loads(graphs.graph_json(n, e).first()["json"])
    assert [x["id"] for x in out["nodes"]] == ["1", "2"] and out["edges"] == [{"source": "1", "target": "2", "type": "DDG", "properties": None}]
    graphs.write_graphs(n, e, str(tmp_path / "out"))
    again, _ = graphs.read_graph(spark, str(tmp_path / "out"))
    assert sorted((r["graph_id"], r["id"], r["line"]) for r in again.collect()) == [("s1", "1", 4), ("s1", "2", None)]
    graphs.write_graph_lines(n, e, str(tmp_path / "lines"))
    packed = graphs.read_graph_lines(spark, str(tmp_path / "lines"))
    assert [sorted(map(repr, x.collect())) for x in packed] == [sorted(map(repr, x.select(*y.columns).collect())) for x, y in zip((again, e), packed, strict=True)]
    xml = """<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="k0" for="node" attr.name="LINE_NUMBER"/><key id="k1" for="node" attr.name="CODE"/><key id="k2" for="edge" attr.name="label"/>
    <graph><node id="n1"><data key="k0">12</data><data key="k1">free(p)</data></node><node id="n2"><data key="k1">q</data></node><edge source="n1" target="n2"><data key="k2">CFG</data></edge><edge source="n2" target="n1" label="AST"/></graph></graphml>"""
    (tmp_path / "g.graphml").write_text(xml)
    n, e = graphs.read_graph(spark, str(tmp_path / "g.graphml"))
    assert {r["id"]: (r["line"], r["code"]) for r in n.collect()} == {"n1": (12, "free(p)"), "n2": (None, "q")}
    assert {r["type"] for r in e.collect()} == {"CFG", "AST"}


def test_sarif(spark, tmp_path):
    loc = lambda uri, **r: {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": r}}
    run = {"tool": {"driver": {"name": "x", "rules": [{"id": "r/a", "properties": {"tags": ["security", "external/cwe/cwe-119", "external/cwe/cwe-787"]}}, {"id": "r/b"}]}}}
    run["results"] = [
        {"ruleId": "r/a", "level": "error", "message": {"text": "m"}, "locations": [loc("n/s.c", startLine=145, endLine=146)], "codeFlows": [{"threadFlows": [{"locations": [{"location": loc("n/s.c", startLine=s)} for s in (132, 140, 145)]}]}]},
        {"ruleIndex": 1, "message": {"text": "o"}, "locations": [loc("a.c", startLine=12)]},
    ]
    (tmp_path / "x.sarif").write_text(json.dumps({"version": "2.1.0", "runs": [run]}, indent=2))
    a, b = graphs.read_sarif(spark, str(tmp_path / "x.sarif"), "s1").orderBy("ord").collect()
    assert (a["query_id"], a["severity"], a["cwe"], a["trace_lines"], a["end_line"], a["sample_id"]) == ("r/a", "error", ["CWE-119", "CWE-787"], [132, 140, 145], 146, "s1")
    assert (b["query_id"], b["cwe"], b["start_line"], b["end_line"], b["trace_lines"]) == ("r/b", [], 12, 12, []) and json.loads(a["raw"])["ruleId"] == "r/a"
    (tmp_path / "e.sarif").write_text('{"version": "2.1.0", "runs": []}')
    assert graphs.read_sarif(spark, str(tmp_path / "e.sarif")).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, None), ("é", None, 3)], "k string, x double, n int")
    assert sinks.write_jsonl(df, str(tmp_path / "o")) == 2 and sinks.write_jsonl(df, str(tmp_path / "o")) == 2
    back = spark.read.schema("k string, x double, n int").json(str(tmp_path / "o"))
    assert back.exceptAll(df).count() == 0
    sinks.write_csv(df, ["n", "x"], str(tmp_path / "c"))
    assert {tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {(None, "0.500000"), ("3", None)}
    files = sinks.write_metrics({"classification": {"f1": 0.5, "confusion": {"tp": 1}}, "cost": None}, str(tmp_path / "m"))
    assert "summary.csv" in files and "classification.confusion.tp,1" in (tmp_path / "m/summary.csv").read_text()


def test_stream_matches_batch(spark, tmp_path):
    rows = [(f"s{i}", "devign", "C", None, None, None, "f.c", None, ("f.c", 1, 2), i % 3, [], "train") for i in range(6)]
    df = spark.createDataFrame(rows, SAMPLE)
    df.write.json(str(tmp_path / "in"))
    q = stateless.accept(spark.readStream.schema(SAMPLE).json(str(tmp_path / "in")), "sample").writeStream.format("memory").queryName("accepted").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("accepted").count() == stateless.accept(df, "sample").count() == 4


def test_sarif_by_ranges(spark, tmp_path):
    """Several runs, rules after results, results without a tool, nested containers, and other members named like them."""
    rng = random.Random(4)
    result = lambda r, i: {"ruleIndex": i % 3, "message": {"text": f'r{r}, "{i}" ]}}'}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.c"}, "region": {"startLine": i + 1}}}], "x": [[{"y": [1, 2]}]]}
    rules = [{"id": f"q{i}", "properties": {"tags": [f"external/cwe/cwe-0{i}"]}} for i in range(3)]
    runs = []
    for r in range(4):
        tool = {"driver": {"name": "t", "rules": rules[: 3 - r % 2]}, "extensions": [{"results": [1]}]}
        members = [("tool", tool), ("results", [result(r, i) for i in range(rng.randint(0, 9) if r != 2 else 0)]), ("invocations", [{"ok": True}, {"results": []}]), ("id", "x, results")]
        rng.shuffle(members)
        runs.append(dict(members))
    del runs[3]["tool"]
    (tmp_path / "a.sarif").write_text(json.dumps({"$schema": "s", "runs": runs, "version": "2.1.0", "properties": {"tags": ["x"]}}, indent=1))
    want = [(r, x["message"]["text"], x["locations"][0]["physicalLocation"]["region"]["startLine"], (rules[: 3 - r % 2] + [{}] * 3)[x["ruleIndex"]].get("id", "unknown") if r < 3 else "unknown") for r, run in enumerate(runs) for x in run["results"]]
    assert len(want) > 8
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (300, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = graphs.read_sarif(spark, str(tmp_path / "a.sarif")).orderBy("ord").collect()
            assert [(r["message"], r["start_line"], r["query_id"]) for r in got] == [w[1:] for w in want]
            assert [r["ord"] for r in got] == list(range(len(want)))
            assert json.loads(got[0]["raw"]) == next(x for run in runs for x in run["results"])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
