"""The neural ranker: gradients by differences, a step by hand, resumed runs, token means and attention."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from siltstone.operators import neural as N

SMALL = N.Shape(vocab=32, most_tokens=8, hidden=6, node=4, static=3, shards=4)
SCHEMA = "sample_id long, label int, slots array<int>, nodes array<array<double>>, static array<double>"


def rows(n=40, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        label = int(rng.random() < 0.4)
        slots = [int(s) for s in rng.integers(0, 16, rng.integers(0, 8)) + 16 * label * (rng.random() < 0.9)]
        nodes = rng.normal(size=(rng.integers(0, 5), 4)).round(3).tolist()
        out.append((i, label, slots or None, nodes if i % 7 else None, rng.normal(size=3).round(3).tolist()))
    return out


def as_rows(data, shape=SMALL):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return N.Rows(pa.table(dict(zip(names, map(list, zip(*data, strict=True)), strict=True))), shape)


def test_gradients_by_differences():
    x, w = as_rows(rows(9)), N.initial(SMALL, 3)
    rng = np.random.default_rng(5)
    keep = [(rng.random((n, 6)) >= 0.3) / 0.7 for n in (len(x.nodes), 9)]
    for k in (None, keep):
        _, g = N.gradients(w, x, k)
        whole = np.zeros_like(w["embedding"])
        whole[x.slots] = g["embedding"]
        for part, d in (g | {"embedding": whole}).items():
            for at in [tuple(rng.integers(0, s) for s in d.shape) for _ in range(6)]:
                near = []
                for e in (1e-6, -1e-6):
                    v = {p: a.copy() for p, a in w.items()}
                    v[part][at] += e
                    near.append(N.gradients(v, x, k)[0])
                assert (near[0] - near[1]) / 2e-6 == pytest.approx(d[at], abs=1e-5), (part, at)


def test_steps_equal_those_of_one_process(spark, tmp_path):
    data, p = rows(60), N.Plan(epochs=2, batch_rows=25, dropout=0.0, rate=0.05)
    df = spark.createDataFrame(data, SCHEMA)
    said = N.train(df, str(tmp_path / "run"), SMALL, p)
    batch = {r[0]: r[1] for r in df.select("sample_id", F.pmod(F.xxhash64("sample_id", F.lit(p.seed)), F.lit(2))).collect()}
    w = N.initial(SMALL, p.seed)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    want = []
    order = [b for e in range(2) for b in np.random.default_rng([p.seed, e]).permutation([0, 1])]
    for step, b in enumerate(order, 1):
        x = as_rows([r for r in data if batch[r[0]] == b])
        loss, g = N.gradients(w, x)
        whole = np.zeros_like(w["embedding"])
        whole[x.slots] = g["embedding"]
        n = len(x.label)
        want.append(loss / n)
        for k, v in (g | {"embedding": whole}).items():
            w[k], first[k], second[k] = N.adamw(p, step, w[k], first[k], second[k], v / n)
    got = N.load(spark, str(tmp_path / "run"), SMALL)
    assert said == pytest.approx(want, abs=1e-12)
    assert all(np.allclose(got[k], w[k], atol=1e-12) for k in w)
    one = {r["sample_id"]: r["rank_score"] for r in N.score(df, got, SMALL).collect()}
    logit, _ = N.forward(w, as_rows(data))
    assert [one[r[0]] for r in data] == pytest.approx((1 / (1 + np.exp(-logit))).tolist())
    shards = N._read(spark, str(tmp_path / "run"), len(order)).where("part = 'embedding'").select(F.octet_length("value")).collect()
    assert len(shards) == 4 and {r[0] for r in shards} == {32 // 4 * 6 * 8}


def test_a_stopped_run_goes_on_as_if_it_had_not(spark, tmp_path):
    df, p = spark.createDataFrame(rows(80), SCHEMA), N.Plan(epochs=4, batch_rows=40, rate=0.03)
    whole = N.train(df, str(tmp_path / "a"), SMALL, p)
    assert len(N.train(df, str(tmp_path / "b"), SMALL, p, stop_after=3)) == 3
    half = tmp_path / "b" / "version-00000004"  # a version that its writer did not complete
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"cut off")
    assert N.train(df, str(tmp_path / "b"), SMALL, p) == whole and len(whole) == 8
    a, b = N.load(spark, str(tmp_path / "a"), SMALL), N.load(spark, str(tmp_path / "b"), SMALL)
    assert all((a[k] == b[k]).all() for k in a)
    assert N.train(df, str(tmp_path / "b"), SMALL, p) == whole  # nothing is left to do
    assert np.mean(whole[-2:]) < np.mean(whole[:2])
    with pytest.raises(ValueError, match="no rows"):
        N.train(df.limit(0), str(tmp_path / "c"), SMALL, p)
    assert N.score(df.limit(0), a, SMALL).count() == 0


def test_steps_share_jobs_and_results_do_not_depend_on_tasks(spark, tmp_path, monkeypatch):
    df, sc = spark.createDataFrame(rows(90) + rows(3), SCHEMA), spark.sparkContext
    jobs, said = {}, {}
    for name, plan in {"few": N.Plan(epochs=1, batch_rows=30), "many": N.Plan(epochs=6, batch_rows=30), "short": N.Plan(epochs=6, batch_rows=30, span=5), "three": N.Plan(epochs=6, batch_rows=30)}.items():
        if name == "three":
            monkeypatch.setattr(SparkContext, "defaultParallelism", property(lambda self: 3))
        sc.setJobGroup(name, name)
        said[name] = N.train(df, str(tmp_path / name), SMALL, plan)
        jobs[name] = len(sc.statusTracker().getJobIdsForGroup(name))
    assert len(said["few"]) == 3 and len(said["many"]) == 18
    assert jobs["many"] == jobs["few"]
    assert said["many"] == said["short"] == said["three"] and said["many"][:3] == said["few"]
    got = [N.load(spark, str(tmp_path / n), SMALL) for n in ("many", "short", "three")]
    assert all((got[0][k] == g[k]).all() for g in got[1:] for k in g)


def test_slices_are_cut_alike_however_batches_are():
    step, piece = np.repeat([1, 1, 2, 4], [5, 300, 2, 129]), np.repeat([0, 3, 3, 1], [5, 300, 2, 129])
    table = pa.table({"step": step, "piece": piece, "v": np.arange(len(step))})
    want = [(1, 0, 5), (1, 3, 128), (1, 3, 128), (1, 3, 44), (2, 3, 2), (4, 1, 128), (4, 1, 1)]
    for most in (1, 7, 1000):
        got = list(N._slices(iter([*table.to_batches(max_chunksize=most), pa.RecordBatch.from_pylist([], table.schema)])))
        assert [(s, p, t.num_rows) for s, p, t in got] == want
        assert pa.concat_tables([t for *_, t in got]).column("v").to_pylist() == list(range(len(step)))
    assert list(N._slices(iter([]))) == []


def test_token_means(spark):
    shape = N.Shape(hidden=256)
    rng = np.random.default_rng(2)
    table = rng.normal(size=(shape.vocab, 256))
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "slot int, vector array<double>")
    codes = [(1, "int x = x + x; free(x)"), (2, ""), (3, None), (4, " ".join(f"t{i % 300}" for i in range(4000)))]
    df = spark.createDataFrame(codes, "sample_id long, code string").select("sample_id", N.slots(F.col("code")).alias("slots"))
    got = {r[0]: np.array(r[1]) for r in N.token_means(df, emb, 256).collect()}
    for r in df.collect():
        want = table[r["slots"]].mean(axis=0) if r["slots"] else np.zeros(256)
        assert np.allclose(got[r["sample_id"]], want, atol=1e-12)
    assert [len(r["slots"] or []) for r in df.orderBy("sample_id").collect()] == [11, 0, 0, 256]


def test_attention_against_loops(spark):
    rng = np.random.default_rng(4)
    layer = lambda i, h, d, concat: N.Attention(rng.normal(size=(i, h * d)), rng.normal(size=h * d), rng.normal(size=(i, h * d)), rng.normal(size=h * d), rng.normal(size=(h, d)), rng.normal(size=h * d if concat else d), concat)
    layers = [layer(5, 3, 4, True), layer(12, 2, 3, False)]
    nodes = [(g, i, rng.normal(size=5).tolist()) for g, n in ((1, 40), (2, 1), (3, 6)) for i in range(n)]
    edges = [(1, i, 0) for i in range(40)] + [(1, int(a), int(b)) for a, b in rng.integers(0, 40, (60, 2))] + [(1, 3, 0), (3, 0, 99), (3, 1, 2), (3, 2, 1), (9, 0, 1)]
    df = spark.createDataFrame(nodes, "graph_id long, id long, x array<double>")
    ed = spark.createDataFrame(edges, "graph_id long, source long, target long")
    graphs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "graph_id long")
    got = {r[0]: np.array(r[1]) for r in N.encode_graphs(graphs, df, ed, layers).collect()}
    x = {(g, i): np.array(v) for g, i, v in nodes}
    for k, a in enumerate(layers):
        h, d = a.attention.shape
        s = {n: (v @ a.source + a.source_bias).reshape(h, d) for n, v in x.items()}
        t = {n: (v @ a.target + a.target_bias).reshape(h, d) for n, v in x.items()}
        new = {}
        for n in x:
            into = [n] + [(g, u) for g, u, v in edges if (g, v) == n and u != v and (g, u) in x]
            e = np.array([((np.where((z := s[m] + t[n]) > 0, z, 0.2 * z)) * a.attention).sum(axis=1) for m in into])
            p = np.exp(e - e.max(axis=0))
            p /= p.sum(axis=0)
            out = sum(p[j][:, None] * s[m] for j, m in enumerate(into))
            new[n] = (out.ravel() if a.concat else out.mean(axis=0)) + a.bias
        x = new if k else {n: np.where(v > 0, v, np.expm1(v)) for n, v in new.items()}
    for g in (1, 2, 3):
        assert np.allclose(got[g], np.mean([v for n, v in x.items() if n[0] == g], axis=0), atol=1e-10)
    assert not got[4].any()
