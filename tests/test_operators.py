import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import alerts as A
from siltstone.operators import evaluation as E
from siltstone.operators import experiments as X
from siltstone.operators import fusion as U
from siltstone.operators import graph as G
from siltstone.operators import ranker as K
from siltstone.operators import relational as R
from siltstone.operators import verify as V
from siltstone.schemas import ALERT, validate
from siltstone.sources import sinks


def ids(df, c="id"):
    return {r[c] for r in df.select(c).collect()}


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([(1, "a /*x*/ b"), (2, "a b"), (3, None), (4, ""), (5, "A b")], "i long, c string")
    assert ids(R.deduplicate(df, "c", "i"), "i") == {1, 3, 5}
    assert ids(R.deduplicate(df, "c", "i", "exact"), "i") == {1, 2, 3, 5}
    with pytest.raises(ValueError):
        R.deduplicate(df, "c", "i", "other")


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_global_rank_does_not_depend_on_partitions(spark, partitions):
    df = spark.range(200).select("id", ((F.col("id") * 7919) % 13).alias("s"))
    got = [r["id"] for r in R.global_rank(df, F.col("s").desc(), F.col("id").asc(), partitions=partitions).orderBy("rank").collect()]
    assert got == sorted(range(200), key=lambda i: (-(i * 7919 % 13), i))


def test_splits(spark):
    df = spark.range(100).select(F.col("id").alias("sample_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    n = {r[0]: r[1] for r in R.random_split(df).groupBy("split").count().collect()}
    assert n == {"train": 70, "valid": 10, "test": 20}
    again = R.random_split(df.repartition(7)).select("sample_id", "split")
    assert again.exceptAll(R.random_split(df).select("sample_id", "split")).count() == 0
    t = R.time_split(spark.createDataFrame([(i, float(10 - i) if i else None) for i in range(10)], "sample_id long, t double"), "t")
    got = {r[0]: r[1] for r in t.select("sample_id", "split").collect()}
    assert got[9] == "train" and got[0] == "test"
    s = R.stratified_split(df).groupBy("label", "split").count().collect()
    assert {(r[0], r[1]): r[2] for r in s}[1, "train"] == 18
    assert R.resolve_split(df, R.random_split(df).select("sample_id", "split")).where("split = 'train'").count() == 70
    assert R.resolve_split(df, df.limit(5).select("sample_id", F.lit("x").alias("split"))).count() == 100


def test_subset_and_balance(spark):
    df = spark.range(100).select(F.col("id").alias("sample_id"), (F.col("id") < 30).cast("int").alias("label"), (F.col("id") / 100).alias("rank_score"))
    n = {r[0]: r[1] for r in R.stratified_subset(df, 10).groupBy("label").count().collect()}
    assert n == {1: 3, 0: 7}
    b = R.balanced_subset(df)
    assert b.count() == 60 and b.agg(F.max("rank")).first()[0] == 60
    assert R.allocate({0: 5, 1: 5}, 3) in ({0: 2, 1: 1}, {0: 1, 1: 2})


def test_top_k(spark):
    df = spark.createDataFrame([("b", 0.8), ("a", 0.8), ("c", None), ("d", 0.9)], "sample_id string, rank_score double")
    assert [r["sample_id"] for r in R.top_k(df, 3).orderBy("rank").collect()] == ["d", "a", "b"]
    with pytest.raises(ValueError):
        R.top_k(df, 0)


@pytest.fixture
def program(spark):
    nodes = spark.createDataFrame([("g", str(i), i, "T", "memcpy" if i == 3 else "x", "b.c" if i == 6 else "src/a.c", {1: 10, 2: 15, 3: 20, 4: 30, 5: 60, 6: 5}[i], "foo" if i < 5 else "bar") for i in range(1, 7)], "graph_id string, id string, ord int, type string, code string, file string, line int, function string")
    edges = spark.createDataFrame([("g", 0, "1", "2", "AST"), ("g", 1, "2", "3", "AST"), ("g", 2, "3", "4", "DDG"), ("g", 3, "3", "6", "CALL"), ("g", 4, "4", "5", "CFG"), ("g", 5, "3", "99", "DDG")], "graph_id string, ord int, source string, target string, type string")
    return nodes, edges


def test_slices(program):
    n, e = program
    assert ids(G.slice_function(n, e, "a.c", 1, 50)[0]) == {"1", "2", "3", "4"}
    assert ids(G.slice_function(n, e, "a.c", 1, 1, "foo")[0]) == {"1", "2", "3", "4"}
    assert ids(G.slice_around(n, e, "a.c", [20], 1)[0]) == {"2", "3", "4", "6"}
    assert ids(G.slice_around(n, e, "a.c", [20], 2)[0]) == {"1", "2", "3", "4", "5", "6"}
    assert ids(G.slice_around(n, e, "a.c", [20], 2, ["DDG"])[0]) == {"3", "4"}
    assert ids(G.slice_around(n, e, "a.c", [9999], 2)[0]) == set()


def test_cap_keeps_nearest(spark):
    n = spark.createDataFrame([("g", f"{i:02d}", i, "T", "", "a.c", i + 1, "f") for i in range(20)], "graph_id string, id string, ord int, type string, code string, file string, line int, function string")
    e = spark.createDataFrame([("g", i, f"{i:02d}", f"{i + 1:02d}", "CFG") for i in range(19)], "graph_id string, ord int, source string, target string, type string")
    assert ids(G.slice_around(n, e, "a.c", [1], 10, max_nodes=5)[0]) == {f"{i:02d}" for i in range(5)}


def test_feature_graph(program):
    n, e = program
    nodes = G.feature_nodes(n, F.array(F.lit(20)), F.array(F.lit(15)), F.lit(10), F.lit(40))
    by = {r["node_id"]: r for r in nodes.collect()}
    assert by["3"]["static_flags"]["is_alert_line"] == 1 and by["3"]["static_flags"]["is_sink_like"] == 1 and by["2"]["line_index"] == 6 and by["5"]["line_index"] is None
    assert G.feature_edges(nodes, e).count() == 5
    assert G.summary(n, e).first().asDict() == {"graph_id": "g", "graph_node_count": 6, "graph_edge_count": 6, "dangerous_api_count": 1}
    assert {r["id"]: r["others"] for r in G.adjacency(n, e).collect()}["3"] == ["2", "4", "6"]


def test_fusion_goldens(spark, tmp_path):
    f = spark.createDataFrame([("fz_001", []), ("fz_002", []), ("fz_003", []), ("fz_004", ["CWE-1"])], "sample_id string, cwe array<string>")
    r = spark.createDataFrame([("fz_001", 0.5, 0), ("fz_001", 0.92, 1), ("fz_002", 0.05, 2), ("fz_003", 0.71, 3), ("fz_004", 0.40, 4)], "sample_id string, rank_score double, ord int")
    a = spark.createDataFrame([("fz_001", "t", "q", "m", "error", "f.c", 12, 12, ["CWE-787"], [11], None, 0), ("fz_001", "t", "q", "m", "warning", "f.c", 13, 13, ["CWE-787"], [], None, 1), ("fz_003", "t", "q", "m", "error", "f.c", 4, 5, [], [2], None, 2), ("fz_004", "t", "q", "m", "note", "f.c", 3, 3, [], [3], None, 3)], ALERT + ", ord int")
    v = spark.createDataFrame([("fz_001", "vulnerable", 0.93, "CWE-787", [12, 13], "h", 0), ("fz_002", "benign", 0.88, "", [], "", 1), ("fz_003", "vulnerable", 0.81, "CWE-416", [], "", 2), ("fz_004", "uncertain", 0.60, "unknown", [], "", 3)], "sample_id string, verdict string, confidence double, predicted_cwe string, vulnerable_lines array<int>, patch_hint string, ord int")
    fused = U.fuse(U.join_signals(f, r, a, v))
    got = {x["sample_id"]: x for x in fused.collect()}
    want = {"fz_001": (0.83, 0.93, 0.9005, 1, "CWE-787"), "fz_002": (0.0, 0.12, 0.0585, 0, "unknown"), "fz_003": (0.55, 0.81, 0.7, 1, "CWE-416"), "fz_004": (0.31, 0.3, 0.3475, 0, "CWE-1")}
    for k, w in want.items():
        x = got[k]
        assert (round(x["static_score"], 9), round(x["llm_score"], 9), round(x["final_score"], 9), x["final_label"], x["predicted_cwe"]) == w
    assert got["fz_001"]["vulnerable_lines"] == [12, 13, 11] or got["fz_001"]["vulnerable_lines"][0] == 12
    found = U.findings(fused)
    kinds = [x["kind"] for x in json.loads(found.where("sample_id = 'fz_001'").first()["evidence"])]
    assert kinds == ["static_alert", "static_alert", "trace_lines", "llm_verdict", "rank_score", "fusion_scores", "line_scores"]
    assert sinks.write_report(*U.report(found), str(tmp_path / "r.json"), {"k": "v"}) == 4
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["total"] == 4 and report["vulnerable_count"] == 2 and report["metadata"] == {"k": "v"} and [x["sample_id"] for x in report["findings"]] == list(want)
    sinks.write_sarif(*U.sarif(found, f.withColumn("file", F.lit("a.c"))), str(tmp_path / "r.sarif"))
    sarif = json.loads((tmp_path / "r.sarif").read_text())
    assert [x["id"] for x in sarif["runs"][0]["tool"]["driver"]["rules"]] == ["CWE-787", "CWE-416"]
    lines = {x["sample_id"]: x["vulnerable_lines"] for x in U.best_lines(U.scored_lines(a, v)).collect()}
    assert lines == {k: x["vulnerable_lines"] for k, x in got.items() if x["vulnerable_lines"]}
    assert sarif["version"] == "2.1.0" and [x["ruleId"] for x in sarif["runs"][0]["results"]] == ["CWE-787", "CWE-416"]


def test_metrics(spark):
    rows = [("ev_001", 1, 0.9), ("ev_003", 1, 0.8), ("ev_005", 1, 0.4), ("ev_004", 0, 0.3), ("ev_002", 0, 0.1)]
    df = spark.createDataFrame(rows, "sample_id string, label int, rank_score double")
    m = E.classification(df, F.col("label"), F.col("rank_score")).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (2, 0, 2, 1) and round(m["mcc"], 4) == 0.6667 and m["precision"] == 1.0 and round(m["f1"], 4) == 0.8
    assert tuple(E.aucs(df, F.col("label"), F.col("rank_score")).first()) == (1.0, 1.0)
    r = E.ranking(R.rank_rows(df), "label", (1, 5)).first()
    assert (r["mrr"], round(r["recall_at_1"], 4), r["recall_at_5"], r["ndcg_at_5"]) == (1.0, 0.3333, 1.0, 1.0)
    one = spark.createDataFrame([("a", 1, 0.5)], df.schema)
    assert tuple(E.aucs(one, F.col("label"), F.col("rank_score")).first()) == (None, None)
    tie = spark.createDataFrame(list(zip("abcdef", [1, 0, 1, 0, 1, 0], [0.9, 0.8, 0.7, 0.7, 0.3, 0.1], strict=True)), df.schema)
    a = E.aucs(tie, F.col("label"), F.col("rank_score")).first()
    assert (round(a[1], 4), round(a[0], 4)) == (0.7, 0.6111)


def test_localisation_and_cost(spark):
    t = spark.createDataFrame([("a", [1, 2]), ("b", [5, 6]), ("c", [9])], "sample_id string, vulnerable_lines array<int>")
    f = spark.createDataFrame([("a", [1, 2]), ("b", [5]), ("c", [])], t.schema)
    m = E.localization(t, f).first()
    assert (m["mean_iou"], round(m["top1_hit"], 4), m["coverage"]) == (0.5, 0.6667, 1.0)
    log = spark.createDataFrame([(10, 5, None, 1.0, 0.1), (None, None, None, 3.0, None), (1, 1, 7, None, 0.2)], "prompt_tokens long, completion_tokens long, total_tokens long, latency_seconds double, api_cost_usd double")
    c = E.costs(log).first()
    assert (c["total_tokens"], c["avg_latency"], round(c["avg_cost"], 4), round(c["p95_latency"], 4)) == (22, 2.0, 0.1, 2.9)
    p = spark.range(1, 101).select(F.col("id").cast("double").alias("latency_seconds"), *[F.lit(1).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")], F.lit(0.0).alias("api_cost_usd"))
    assert round(E.costs(p).first()["p95_latency"], 2) == 95.05


def test_ablation_and_audits(spark):
    a = {r["config"]: r for r in E.ablation(spark.createDataFrame([("full", 0.5), ("x", 0.7), ("y", None)], "config string, f1 double"), "f1").collect()}
    assert a["x"]["rank"] == 1 and a["full"]["is_reference"] and round(a["x"]["delta"], 6) == 0.2 and a["y"]["delta"] is None
    m = spark.createDataFrame([("a", 1), ("b", 0)], "sample_id string, label int")
    r = spark.createDataFrame([("a", 0, 1.5, 1), ("a", 1, 0.5, 3)], "sample_id string, label int, rank_score double, rank int")
    got = {x["check"]: x["failures"] for x in E.audit_ranks(r, m).collect()}
    assert got == {"duplicate_ids": 1, "missing_ids": 1, "extra_ids": 0, "score_range": 1, "label_mismatch": 1, "rank_gaps": 1}
    assert X.without_verifier((0.25, 0.45, 0.3))[2] == 0 and X.without_verifier((0.0, 0.0, 1.0)) == (0.0, 0.0, 0.0)


def test_spans(spark):
    p = spark.createDataFrame([(1, "f", 30), (2, "f", 500), (3, "g", 5)], "pid int, k string, line int")
    s = spark.createDataFrame([("f", 1, 100, 0), ("f", 25, 40, 1), ("f", 26, 41, 2), ("g", 1, 9000, 3)], "k string, start_line int, end_line int, ord int")
    assert {r["pid"]: r["span_ord"] for r in A.in_spans(p, s, key="k", line="line", ids="pid", bin_size=16).collect()} == {1: 1, 2: None, 3: 3}


def test_wrap(spark):
    df = spark.createDataFrame([(i, "a\nb\nc" if i % 2 else "x\ny\n") for i in range(5)] + [(9, "one")], "sample_id int, c string")
    got = {r["sample_id"]: (r["batch_file"], r["start_line"], r["end_line"]) for r in A.wrap(df, F.col("c"), "sample_id", batch=2).collect()}
    assert got == {0: ("batch_000.c", 8, 9), 1: ("batch_000.c", 12, 14), 2: ("batch_001.c", 8, 9), 3: ("batch_001.c", 12, 14), 4: ("batch_002.c", 8, 9)}


def test_validation(spark):
    rows = [("s", "t", "q", "m", None, "f", 1, 2, [], [1], None), ("s", "t", "q", "m", None, "f", 3, 2, [], [0], None), ("s", None, "q", "m", None, "f", None, 2, [], None, None)]
    got = [(r["valid"], set(r["reasons"])) for r in validate(spark.createDataFrame(rows, ALERT), "alert").collect()]
    assert got[0] == (True, set()) and got[1] == (False, {"span_order", "trace_lines"}) and "missing_tool" in got[2][1]
    with pytest.raises(Exception, match="bad alert row"):
        validate(spark.createDataFrame(rows, ALERT), "alert", strict=True).collect()


def test_verifier(spark):
    def client():
        seen = {"n": 0}

        def call(messages):
            text = messages[-1]["content"]
            if "boom" in text:
                raise OSError("no route")
            if "bad" in text and seen["n"] < 1:
                seen["n"] += 1
                return "not json", 3, 1
            if "hopeless" in text or "maybe" in text:
                return '{"verdict": "maybe", "confidence": 0.5}', 3, 1
            return '```json\n{"verdict": "vulnerable", "confidence": 1.03, "vulnerable_lines": [2]}\n```', 3, 1

        return call

    p = spark.createDataFrame([("a", "s", "fine"), ("b", "s", "bad"), ("c", "s", "boom"), ("d", "s", "hopeless")], "sample_id string, system string, prompt string")
    got = {r["sample_id"]: r for r in V.verify(p, client, V.VerifierConfig(concurrency=1)).collect()}
    assert (got["a"]["verdict"], got["a"]["confidence"], got["a"]["success"]) == ("vulnerable", 1.0, True)
    assert got["b"]["verdict"] == "vulnerable" and got["c"]["success"] is False and got["c"]["verdict"] == "uncertain" and got["d"]["confidence"] == 0.0 and got["d"]["success"] is True


def test_chat_client():
    waits, calls = [], []

    def sender(*answers):
        left = list(answers)

        def send(url, headers, body, seconds):
            calls.append((url, headers["Authorization"], json.loads(body)))
            a = left.pop(0)
            if isinstance(a, Exception):
                raise a
            return a

        return send

    good = (200, json.dumps({"choices": [{"message": {"content": "{}"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}}).encode())
    config = V.VerifierConfig(model="m", temperature=0.5, max_tokens=9)
    make = lambda *a, **kw: V.chat_clients("http://x/", config, "s3cret", send=sender(*a), wait=waits.append, **kw)()
    assert make((429, b""), OSError("s3cret is down"), good)([{"role": "user", "content": "hi"}]) == ("{}", 3, 1)
    assert waits == [2.0, 4.0] and calls[0][0] == "http://x/chat/completions" and calls[0][1] == "Bearer s3cret"
    assert calls[0][2] == {"model": "m", "temperature": 0.5, "max_tokens": 9, "response_format": {"type": "json_object"}, "messages": [{"role": "user", "content": "hi"}]}
    with pytest.raises(V.ChatError, match="status 400"):
        make((400, b""))([])
    with pytest.raises(V.ChatError) as e:
        make(OSError("s3cret is down"), (503, b""), OSError("s3cret is down"))([])
    assert "s3cret" not in str(e.value) and "***" in str(e.value)
    for raw in (b"no json", b"{}", b'{"choices": []}', b"[]"):
        with pytest.raises(V.ChatError, match="malformed"):
            make((200, raw))([])
    with pytest.raises(V.ChatError, match="no key"):
        V.ChatClient("http://x", "m", key_name="NO_SUCH_KEY_NAME")


def test_only_the_best_are_sent(spark):
    p = spark.createDataFrame([(str(i), "s", "p", i) for i in range(1, 9)], "sample_id string, system string, prompt string, rank int")
    client = lambda: lambda messages: ('{"verdict": "benign", "confidence": 1}', 1, 1)
    assert sorted(r[0] for r in V.verify(p, client, V.VerifierConfig(top_k=3)).select("sample_id").collect()) == ["1", "2", "3"]
    assert V.verify(p, client, V.VerifierConfig(top_k=None)).count() == 8


def test_splits_keep_ids_together(spark):
    rows = [(i % 20, i % 2, i) for i in range(60)] + [(None, 0, 0)]
    d = spark.createDataFrame(rows, "sample_id int, label int, v int")
    for s in (R.random_split(d), R.time_split(d, "v")):
        assert s.count() == len(rows) and max(len({r["split"] for r in s.collect() if r["sample_id"] == i}) for i in (*range(20), None)) == 1
    assert R.stratified_split(d).count() == len(rows)
    with pytest.raises(Exception, match="no row for 3"):
        R.join_all(d.where("sample_id = 3"), d.where("sample_id = 4").select("sample_id", F.col("v").alias("w"))).collect()


def test_linear_ranker_is_at_its_optimum(spark):
    """Against Newton's method over the whole matrix, the intercept a penalised column of ones."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3)) * [1.0, 30.0, 0.0]
    y = (x[:, 0] + 0.5 * rng.normal(size=80) > 0.6).astype(int)
    df = spark.createDataFrame([(f"s{i}", int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "sample_id string, label int, a double, b double, c double")
    ones, w = np.column_stack([x, np.ones(80)]), 80 / (2 * np.where(y == 1, y.sum(), 80 - y.sum()))
    for c in (1.0, 0.1, 50.0):
        want = np.zeros(4)
        for _ in range(100):
            p = 1 / (1 + np.exp(-ones @ want))
            want -= np.linalg.solve(c * (ones.T * (w * p * (1 - p))) @ ones + np.eye(4), c * ones.T @ (w * (p - y)) + want)
        m = K.fit(K.assemble(df.repartition(3), ["a", "b", "c"]), c=c)
        assert np.allclose([*m.coefficients.toArray(), m.intercept], want, atol=1e-6) and abs(m.intercept) > 0.1
        scored = {r["sample_id"]: r["rank_score"] for r in K.predict(m, K.assemble(df, ["a", "b", "c"])).collect()}
        assert np.allclose([scored[f"s{i}"] for i in range(80)], 1 / (1 + np.exp(-ones @ want)), atol=1e-6)


def test_odd_numbers(spark):
    from siltstone.functions import normalize as N

    d = spark.createDataFrame([("1e12",), ("abc",), (None,), ("7.5",)], "x string")
    got = [tuple(r) for r in d.select(N.coerce_line(F.col("x")), N.number_or_zero(F.col("x")), N.percent(F.lit(None).cast("double"))).collect()]
    assert got == [(None, 1e12, "n/a"), (None, 0.0, "n/a"), (None, 0.0, "n/a"), (7, 7.5, "n/a")]


def test_schemas_parse(spark):
    from siltstone import schemas as C

    for kind in (C.SAMPLE, C.ALERT, C.VERDICT, C.FINDING, C.FEATURE, C.RANK, C.COST, C.PACKET):
        assert spark.createDataFrame([], kind).columns[0] == "sample_id"
