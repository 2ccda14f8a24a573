"""Operators that replace one-task steps: percentiles, running sums, suffix paths, containment joins and joined files."""

import json
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siltstone.functions.normalize import paths_match
from siltstone.operators import alerts as A
from siltstone.operators import evaluation as E
from siltstone.sources import sinks


def test_percentiles(spark):
    rng = np.random.default_rng(1)
    big = 1.7e308
    cases = [[5.0] * 9, rng.normal(size=999).tolist(), (10 ** rng.uniform(-300, 300, 200)).tolist() + [-big, big, 0.0, 1e-320, -1e-320], [1.0, float(np.nextafter(1, 2))] * 5 + [float("inf"), float("-inf")]]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(3)
        order = sorted(values)
        for share in (0.0, 0.47, 0.95):
            at = share * (len(order) - 1)
            a, b = order[int(at)], order[min(int(at) + (at > int(at)), len(order) - 1)]
            assert E.order_statistics(df, "x", share) == (a, b, at - int(at)), (values[:5], share)
    assert E.percentile(spark.createDataFrame([(3.0,), (1.0,), (2.0,), (8.0,)], "x double"), "x", 0.5) == 2.5
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    assert E.percentile(nan, "x", 0.5) == 2.0 and np.isnan(E.percentile(nan, "x", 1.0))
    assert E.percentile(nan.limit(0), "x", 0.5) is None
    assert E.costs(spark.createDataFrame([], "total_tokens long, prompt_tokens long, completion_tokens long, api_cost_usd double, latency_seconds double")).first()["p95_latency"] is None


def test_running_sums_over_levels(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 7)
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 9), rng.random()) for i in range(2000)]
    got = E.running_sums(spark.createDataFrame(rows, "s long, p long, n double").repartition(5), F.col("s").desc(), ["p", "n"])
    p, n = 0, 0.0
    for r in sorted(got.collect(), key=lambda r: -r["s"]):
        assert r["p_before"] == p and r["n_before"] == pytest.approx(n)
        p, n = p + r["p"], n + r["n"]


def test_alerts_meet_samples_by_suffix(spark):
    rng = random.Random(3)
    names = ["main.c", "src/main.c", "/a/src/main.c", "b\\src\\main.c", "lib/x.c", "x.c", "c", "ain.c", "src/", "/src//main.c", "//main.c"]
    samples = [(i, (rng.choice(names), s := rng.randint(1, 300), s + rng.randint(0, 80))) for i in range(60)]
    alerts = [(i, rng.choice(names) if i % 3 else "main.c", s := rng.randint(1, 300), s + rng.randint(-2, 9)) for i in range(200)] + [(999, None, 1, 2)]
    s = spark.createDataFrame(samples, "sample_id long, span struct<file:string,start_line:int,end_line:int>")
    a = spark.createDataFrame(alerts, "ord long, file string, start_line int, end_line int")
    pairs = a.crossJoin(s.withColumnRenamed("sample_id", "i")).where(paths_match(F.col("file"), F.col("span.file")) & (F.col("start_line") <= F.col("span.end_line")) & (F.col("end_line") >= F.col("span.start_line")))
    want = {r[0]: r[1] for r in pairs.groupBy("ord").agg(F.min_by("i", F.struct(F.col("span.end_line") - F.col("span.start_line"), "i"))).collect()}
    assert len(want) > 100
    for heavy in (5, 100_000):  # the paths that many alerts name are dealt to slices, or none is
        got = {r["ord"]: r["sample_id"] for r in A.map_to_samples(a, s, heavy=heavy).collect()}
        assert len(got) == len(alerts) and {k: v for k, v in got.items() if v is not None} == want


def test_containment_join_wants_unique_points(spark):
    spans = spark.createDataFrame([("k", 1, 9, 1), ("k", 2, 3, 2)], "k string, start_line int, end_line int, ord int")
    points = spark.createDataFrame([(1, "k", 2), (2, "k", 50), (3, None, 2)], "p int, k string, line int")
    assert {r["p"]: r["span_ord"] for r in A.in_spans(points, spans, key="k", line="line", ids="p").collect()} == {1: 2, 2: None, 3: None}
    with pytest.raises(PySparkException, match="p repeats"):
        A.in_spans(points.union(points.limit(1)), spans, key="k", line="line", ids="p").collect()


def test_joined_files(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), F.to_json(F.struct("id", F.concat(F.lit("é\n,"), "id").alias("t"))).alias("json")).repartition(7)
    path = str(tmp_path / "out.json")
    sinks.write_joined(rows, "id", "json", path, '{"n": 3, "rows": [', "]}")
    sinks.write_joined(rows, "id", "json", path, '{"n": 3, "rows": [', "]}")  # replaces
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    assert got == {"n": 3, "rows": [{"id": i, "t": f"é\n,{i}"} for i in range(1000)]}
    sinks.write_joined(rows.limit(0), "id", "json", path, "[", "]")
    with open(path) as f:
        assert json.load(f) == []
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["out.json"]


def test_secret_counts(spark):
    d = spark.createDataFrame([(1, f'token = "{"ab" * 20}"; token: \'{"0" * 32}\''), (2, "token = 'short'"), (3, None), (4, "AKIA" + "A" * 16 + " password = 'x'")], "i long, t string")
    got = {r["i"]: [tuple(m) for m in r["matches"]] for r in E.secret_counts(d, "t").collect()}
    assert got == {1: [(5, 2)], 4: [(1, 1), (4, 1)]}
