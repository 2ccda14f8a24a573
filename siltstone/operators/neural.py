"""A neural ranker over three channels (hashed tokens, graph nodes, static features), trained by synchronous minibatches.

Model: the mean of the embeddings of a sample's first tokens, a two-layer perceptron of its nodes with their mean, and its
static vector are each brought to the hidden width, joined, fused by two layers and scored by two more; the loss is the
cross-entropy of the logit.

Training is a chain of Spark jobs, each of which takes some steps (Plan.span) in one barrier stage, as a job a step would spend
most of its time on being started. The rows of these steps are shuffled to the stage's tasks by the piece of their batch and
sorted by step, so a task streams them and holds one piece at a time. In a step, every task sums the gradients of its pieces
and sends each other task the stretch of them that this one owns; the owner adds the pieces in their order, moves its stretch
of the parameters by AdamW, whose moments it alone holds, and sends it to the others. Tasks talk over sockets, as Spark's own
barrier takes a second. Neither rows nor gradients pass the driver; between jobs it reads the state, whose size is the
model's, to send it to the tasks. The tasks of a barrier stage start together: Spark refuses it if dynamic allocation is on.

Every job leaves a version of the state, a table in the folder of the run. A run that ended early, or lost its driver, goes on
from the last complete version and ends in the same parameters, as batches, their pieces and order, dropout and the order of
sums follow the seed and the rows, not the number of tasks or of jobs. A job whose task is lost starts again as a whole.

The attention encoder is a DataFrame plan: scores of edges, their greatest by destination, and the mean of the sources' values
by these weights, both aggregated with partial sums, so a hub is no single group.

Defined cases: samples without tokens, without nodes or with null arrays have zeros in that channel; graphs without nodes have
zeros; repeated ids are rows of their own; an empty table cannot be learnt from (ValueError) and scores to no rows.
"""

from __future__ import annotations

import hmac
import secrets
import socket
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import crc_bucket, tokens
from siltstone.functions.vectors import node_vector, static_vector
from siltstone.operators.common import shared_path

Weights = dict[str, np.ndarray]
STATE = "part string, shard int, step int, value binary, first binary, second binary, losses array<double>"
#: Rows of a step of the forward pass.
SLICE = 128


@dataclass(frozen=True)
class Shape:
    """Sizes of the model. Fixed values of the defaults: 4096 slots, 256 tokens, hidden width 256, 37 node and 9 static numbers."""

    vocab: int = 4096
    most_tokens: int = 256
    hidden: int = 256
    node: int = 37
    static: int = 9
    shards: int = 16

    def parts(self) -> dict[str, tuple[int, int]]:
        """Rows and columns of each part; a bias is a row."""
        h = self.hidden
        dense = {"token": (h, h), "node1": (self.node, h), "node2": (h, h), "static": (self.static, h), "fuse1": (3 * h, h), "fuse2": (h, h), "head1": (h, h), "head2": (h, 1)}
        return {"embedding": (self.vocab, h)} | {f"{k}.w": v for k, v in dense.items()} | {f"{k}.b": (1, v[1]) for k, v in dense.items()}

    def bounds(self, part: str) -> list[tuple[int, int, int]]:
        """(shard, first row, end row) of a part; only the embedding has several."""
        n = self.parts()[part][0]
        k = min(self.shards, n) if part == "embedding" else 1
        return [(i, n * i // k, n * (i + 1) // k) for i in range(k)]


def initial(shape: Shape, seed: int = 42) -> Weights:
    """Embeddings from a normal distribution, layers uniform within the inverse root of their inputs, by the seed."""
    out: Weights = {}
    for i, (part, size) in enumerate(shape.parts().items()):
        rng = np.random.default_rng([seed, i])
        inputs = shape.parts()[part[:-1] + "w"][0] if part != "embedding" else 0
        out[part] = rng.standard_normal(size) if part == "embedding" else rng.uniform(-1, 1, size) / np.sqrt(inputs)
    return out


# -- inputs ------------------------------------------------------------------------------------------------------------


def slots(code: Column, vocab: int = 4096, most: int = 256) -> Column:
    """The hash slots of the first tokens of a text."""
    return F.transform(F.slice(tokens(code), 1, most), lambda t: crc_bucket(t, vocab))


def inputs(features: DataFrame, shape: Shape | None = None, *, label: str = "label", code: str = "function_code", keep: tuple[str, ...] = ()) -> DataFrame:
    """(sample_id, label, slots, nodes, static) and the columns of keep, of feature records; the nodes of a record are capped where its graph was sliced."""
    s = shape or Shape()
    none = F.array().cast("array<array<double>>")
    own = F.transform("nodes", lambda n: node_vector(n["node_type"], n["code"], n["line_index"], n["static_flags"])) if "nodes" in features.columns else none
    return features.select("sample_id", F.col(label).cast("int").alias("label"), slots(F.col(code), s.vocab, s.most_tokens).alias("slots"), F.coalesce(own, none).alias("nodes"), static_vector(F.col("static_features")).alias("static"), *keep)


def token_means(rows: DataFrame, embedding: DataFrame, width: int, sample_id: str = "sample_id") -> DataFrame:
    """(sample_id, vector): means of the embeddings (slot, vector) of a sample's slots, zeros without any, as a join and an aggregate.

    Slots are counted in their row first, so a slot that repeats in a sample is one row.
    """
    ordered = rows.select(sample_id, F.sort_array("slots").alias("s")).withColumn("d", F.array_distinct("s"))
    ordered = ordered.withColumn("at", F.transform("d", lambda x: F.array_position("s", x)))
    n = lambda i: (F.coalesce(F.get("at", i + 1), F.size("s") + 1) - F.get("at", i)).cast("double")
    each = F.transform("d", lambda x, i: F.struct(x.alias("own"), n(i).alias("n")))
    met = ordered.select(sample_id, F.inline(each)).join(embedding.select("slot", array_to_vector("vector").alias("v")), F.col("own") == F.col("slot"))
    means = met.groupBy(F.col(sample_id).alias("_i")).agg(vector_to_array(Summarizer.mean(F.col("v"), F.col("n"))).alias("vector"))
    return rows.select(sample_id).distinct().join(means, F.col(sample_id) == F.col("_i"), "left").select(sample_id, F.coalesce("vector", F.array_repeat(F.lit(0.0), width)).alias("vector"))


# -- attention over edges ----------------------------------------------------------------------------------------------


def _dense(c: Column, w: np.ndarray, b: np.ndarray) -> Column:
    @F.pandas_udf("array<double>")  # type: ignore[call-overload]
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_numpy()) @ w + b) if len(x) else [], dtype=object)

    return run(c)


@dataclass(frozen=True)
class Attention:
    """A layer: values of sources and of destinations (inputs x heads * width), attention (heads x width), bias of the result."""

    source: np.ndarray
    source_bias: np.ndarray
    target: np.ndarray
    target_bias: np.ndarray
    attention: np.ndarray
    bias: np.ndarray
    concat: bool = True
    slope: float = 0.2


def attend(nodes: DataFrame, edges: DataFrame, layer: Attention) -> DataFrame:
    """(graph_id, id, x) after one layer: x of nodes (graph_id, id, x) and of edges (graph_id, source, target).

    Every node also has an edge from itself, given ones are replaced; dangling edges go; equal edges count each.
    """
    heads, width = layer.attention.shape
    spark = nodes.sparkSession
    values, edge_table = (shared_path(spark, n) for n in ("values", "edges"))
    n = nodes.select("graph_id", "id", _dense(F.col("x"), layer.source, layer.source_bias).alias("s"), _dense(F.col("x"), layer.target, layer.target_bias).alias("t"))
    n.write.parquet(values)
    n = spark.read.schema(n.schema).parquet(values)
    own = edges.where("source <> target").select("graph_id", "source", "target").union(n.select("graph_id", "id", "id"))
    s = n.select(F.col("graph_id").alias("sg"), F.col("id").alias("si"), "s")
    t = n.select(F.col("graph_id").alias("tg"), F.col("id").alias("ti"), "t")
    of_source, of_target = (F.col("graph_id") == F.col("sg")) & (F.col("source") == F.col("si")), (F.col("graph_id") == F.col("tg")) & (F.col("target") == F.col("ti"))
    both = own.join(s, of_source).join(t, of_target)

    def score(h: int) -> Column:
        a = F.array(*[F.lit(float(v)) for v in layer.attention[h]])
        z = F.zip_with(F.slice("s", h * width + 1, width), F.slice("t", h * width + 1, width), lambda x, y: x + y)
        bent = F.transform(z, lambda v: F.when(v > 0, v).otherwise(v * layer.slope))
        return F.aggregate(F.zip_with(a, bent, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)

    names = [f"e{h}" for h in range(heads)]
    e = both.select("graph_id", "source", "target", *[score(h).alias(names[h]) for h in range(heads)])
    e.write.parquet(edge_table)
    e = spark.read.schema(e.schema).parquet(edge_table)
    top = e.groupBy(F.col("graph_id").alias("mg"), F.col("target").alias("mi")).agg(*[F.max(c).alias(f"m{c}") for c in names])
    met = e.join(top, (F.col("graph_id") == F.col("mg")) & (F.col("target") == F.col("mi"))).join(s, of_source)
    means = [vector_to_array(Summarizer.mean(array_to_vector(F.slice("s", h * width + 1, width)), F.exp(F.col(c) - F.col(f"m{c}")))).alias(f"o{h}") for h, c in enumerate(names)]
    got = met.groupBy("graph_id", F.col("target").alias("id")).agg(*means)
    out = [F.col(f"o{h}") for h in range(heads)]
    joined = F.concat(*out)
    if not layer.concat:
        joined = out[0]
        for o in out[1:]:
            joined = F.zip_with(joined, o, lambda x, y: x + y)
        joined = F.transform(joined, lambda v: v / float(heads))
    bias = F.array(*[F.lit(float(v)) for v in layer.bias])
    return got.select("graph_id", "id", F.zip_with(joined, bias, lambda x, y: x + y).alias("x"))


def encode_graphs(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, layers: list[Attention]) -> DataFrame:
    """(graph_id, vector): the layers with an exponential unit between them, then the mean of each graph's nodes, zeros without nodes."""
    for i, layer in enumerate(layers):
        nodes = attend(nodes, edges, layer)
        if i + 1 < len(layers):
            nodes = nodes.withColumn("x", F.transform("x", lambda v: F.when(v > 0, v).otherwise(F.expm1(v))))
    last = layers[-1]
    width = last.attention.size if last.concat else last.attention.shape[1]
    got = nodes.groupBy(F.col("graph_id").alias("_g")).agg(vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("vector"))
    return graphs.select("graph_id").join(got, F.col("graph_id") == F.col("_g"), "left").select("graph_id", F.coalesce("vector", F.array_repeat(F.lit(0.0), width)).alias("vector"))


# -- forward and backward over some rows -------------------------------------------------------------------------------


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths of lists, 0 of null, and their values one after the other."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False), c.flatten()


class Rows:
    """Rows as arrays: the share of each touched slot in a sample, its nodes one after the other, static numbers, labels."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, shape: Shape):
        (sizes, slots), (n_nodes, nodes), (n_static, static) = (_lists(batch.column(c)) for c in ("slots", "nodes", "static"))
        n, flat = len(sizes), slots.to_numpy(zero_copy_only=False).astype(np.int64)
        self.slots, place = np.unique(flat, return_inverse=True)
        k = len(self.slots)
        self.share = np.bincount(np.repeat(np.arange(n), sizes) * k + place, minlength=n * k).reshape(n, k) / np.maximum(sizes, 1)[:, None]
        self.node_of = np.repeat(np.arange(n), n_nodes)
        self.nodes = _lists(nodes)[1].to_numpy(zero_copy_only=False).reshape(-1, shape.node)
        self.n_nodes = np.maximum(n_nodes, 1).astype(float)[:, None]
        self.static = np.zeros((n, shape.static))
        self.static[n_static > 0] = static.to_numpy(zero_copy_only=False).reshape(-1, shape.static)
        self.label = np.array(batch.column("label").to_pylist(), float) if "label" in batch.schema.names else None


def forward(w: Weights, x: Rows, keep: list[np.ndarray] | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Logits, and what the way back needs. keep: dropout factors of the nodes' and of the head's hidden units."""
    k = {"bag": x.share @ w["embedding"][x.slots]}
    k["node"] = np.maximum(x.nodes @ w["node1.w"] + w["node1.b"], 0) * (keep[0] if keep else 1.0)
    pooled = np.zeros((len(x.static), w["node2.w"].shape[1]))
    np.add.at(pooled, x.node_of, k["node"] @ w["node2.w"] + w["node2.b"])
    k["joined"] = np.concatenate([k["bag"] @ w["token.w"] + w["token.b"], pooled / x.n_nodes, x.static @ w["static.w"] + w["static.b"]], axis=1)
    k["fused"] = np.maximum(k["joined"] @ w["fuse1.w"] + w["fuse1.b"], 0)
    k["whole"] = k["fused"] @ w["fuse2.w"] + w["fuse2.b"]
    k["head"] = np.maximum(k["whole"] @ w["head1.w"] + w["head1.b"], 0) * (keep[1] if keep else 1.0)
    return (k["head"] @ w["head2.w"] + w["head2.b"])[:, 0], k


def gradients(w: Weights, x: Rows, keep: list[np.ndarray] | None = None) -> tuple[float, Weights]:
    """Sum of the rows' losses and of their gradients; that of the embedding has a row for each of x.slots."""
    logit, k = forward(w, x, keep)
    loss = float(np.sum(np.logaddexp(0, logit) - x.label * logit))
    g: Weights = {}

    def back(layer: str, given: np.ndarray, d: np.ndarray) -> np.ndarray:
        g[f"{layer}.w"], g[f"{layer}.b"] = given.T @ d, d.sum(axis=0, keepdims=True)
        return d @ w[f"{layer}.w"].T

    d = back("head2", k["head"], (1 / (1 + np.exp(-logit)) - x.label)[:, None])
    d = back("head1", k["whole"], d * (k["head"] > 0) * (keep[1] if keep else 1.0))
    d = back("fuse2", k["fused"], d)
    d = back("fuse1", k["joined"], d * (k["fused"] > 0))
    h = w["token.w"].shape[1]
    bag = back("token", k["bag"], d[:, :h])
    g["embedding"] = x.share.T @ bag
    each = back("node2", k["node"], (d[:, h : 2 * h] / x.n_nodes)[x.node_of])
    back("node1", x.nodes, each * (k["node"] > 0) * (keep[0] if keep else 1.0))
    back("static", x.static, d[:, 2 * h :])
    return loss, g


# -- training ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """How to train. Fixed values of the defaults: learning rate 0.001, decay 0.01, moments 0.9 and 0.999, dropout 0.1.

    files: pieces of a batch, and the most tasks of a step. span: the most steps of a job, which leaves a version of the state.
    """

    epochs: int = 2
    batch_rows: int = 1024
    rate: float = 1e-3
    decay: float = 0.01
    first: float = 0.9
    second: float = 0.999
    dropout: float = 0.1
    seed: int = 42
    files: int = 8
    span: int = 128


def adamw(p: Plan, step: int, value: np.ndarray, first: np.ndarray, second: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next value and moments; step counts from 1."""
    first, second = p.first * first + (1 - p.first) * g, p.second * second + (1 - p.second) * g * g
    move = (first / (1 - p.first**step)) / (np.sqrt(second / (1 - p.second**step)) + 1e-8)
    return value * (1 - p.rate * p.decay) - p.rate * move, first, second


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _version(folder: str, step: int) -> str:
    return f"{folder}/version-{step:08d}"


def latest(spark: SparkSession, folder: str) -> int | None:
    """The last complete version in a run's folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    found = [int(n.removeprefix("version-")) for n in names if n.startswith("version-") and _exists(spark, f"{folder}/{n}/_SUCCESS")]
    return max(found, default=None)


def _read(spark: SparkSession, folder: str, step: int) -> DataFrame:
    return spark.read.schema(STATE).parquet(_version(folder, step))


def _states(spark: SparkSession, folder: str, step: int, shape: Shape, *columns: str) -> dict[str, Weights]:
    """Columns of a version by part; their size is the model's."""
    rows = sorted(_read(spark, folder, step).select("part", "shard", *columns).collect())
    return {c: {part: np.concatenate([np.frombuffer(r[c], float) for r in rows if r["part"] == part]).reshape(size) for part, size in shape.parts().items()} for c in columns}


def load(spark: SparkSession, folder: str, shape: Shape) -> Weights:
    """The parameters of the last complete version; their size is the model's."""
    step = latest(spark, folder)
    if step is None:
        raise ValueError(f"no complete version in {folder}")
    return _states(spark, folder, step, shape, "value")["value"]


def losses(spark: SparkSession, folder: str) -> list[float]:
    """Mean loss of each step so far."""
    return list(_read(spark, folder, latest(spark, folder) or 0).where("part = 'head2.b'").first()["losses"])


def _stretches(shape: Shape, tasks: int) -> list[list[tuple[str, int, int, int]]]:
    """Of each task the (part, shard, first, end) that it owns in the parameters laid end to end: stretches of like length."""
    at, units = 0, []
    for part, (_, width) in shape.parts().items():
        for shard, a, e in shape.bounds(part):
            units.append((part, shard, at, at + (e - a) * width))
            at += (e - a) * width
    out: list[list[tuple[str, int, int, int]]] = [[] for _ in range(tasks)]
    for u in units:
        out[(u[2] + u[3]) * tasks // (2 * at)].append(u)
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """(step, piece, up to SLICE rows) of rows sorted by both, cut alike however the batches are."""
    key, held, n = (0, 0), [], 0
    for b in (b for b in batches if b.num_rows):
        step, piece = b.column("step").to_numpy(), b.column("piece").to_numpy()
        for a, e in pairwise([0, *(np.flatnonzero((np.diff(step) != 0) | (np.diff(piece) != 0)) + 1).tolist(), b.num_rows]):
            if held and key != (step[a], piece[a]):
                yield *key, pa.Table.from_batches(held)
                held, n = [], 0
            key = (int(step[a]), int(piece[a]))
            while a < e:
                few = min(e - a, SLICE - n)
                held.append(b.slice(a, few))
                a, n = a + few, n + few
                if n == SLICE:
                    yield *key, pa.Table.from_batches(held)
                    held, n = [], 0
    if held:
        yield *key, pa.Table.from_batches(held)


def _lines(key: bytes) -> dict[int, socket.socket]:
    """Connections to the other tasks of the barrier stage; who connects must know the key."""

    def take(s: socket.socket, n: int) -> bytes:
        got = b""
        while len(got) < n and (more := s.recv(n - len(got))):
            got += more
        return got

    c = BarrierTaskContext.get()
    me, hosts = c.partitionId(), [t.address.rsplit(":", 1)[0] for t in c.getTaskInfos()]
    out: dict[int, socket.socket] = {}
    with socket.create_server(("", 0), backlog=len(hosts)) as server:
        ports = c.allGather(str(server.getsockname()[1]))
        for i in range(me):
            out[i] = socket.create_connection((hosts[i], int(ports[i])))
            out[i].sendall(key + me.to_bytes(4, "little"))
        while len(out) < len(hosts) - 1:
            s, _ = server.accept()
            said = take(s, len(key) + 4)
            if hmac.compare_digest(said[:-4], key):
                out[int.from_bytes(said[-4:], "little")] = s
            else:
                s.close()
    for s in out.values():
        s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return out


def _swap(lines: dict[int, socket.socket], me: int, give: Callable[[int], np.ndarray], into: Callable[[int], np.ndarray]) -> None:
    """Gives every other task an array and fills one from it, in pairs, of which the lower task speaks first, so none waits for a full buffer."""
    for r in range(1, 1 << len(lines).bit_length()):
        if (other := me ^ r) in lines:
            for sends in (me < other, me > other):
                if sends:
                    lines[other].sendall(np.ascontiguousarray(give(other)).data.cast("B"))
                elif (buffer := into(other)).size:
                    view, at = buffer.data.cast("B"), 0
                    while at < len(view):
                        if not (n := lines[other].recv_into(view[at:])):
                            raise ConnectionError(f"task {other} has ended")
                        at += n


def _steps(state: object, shape: Shape, p: Plan, first: int, last: int, tasks: int, key: bytes) -> object:
    """The tasks of steps first to last: each leaves the next version of what it owns. state: a broadcast of values, both moments and losses."""
    size = sum(a * b for a, b in shape.parts().values())
    owned = _stretches(shape, tasks)
    ends = [0, *[u[-1][3] if u else 0 for u in owned]]
    ends = np.maximum.accumulate(ends).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = BarrierTaskContext.get().partitionId()
        lines = _lines(key)
        whole = state.value  # type: ignore[attr-defined]
        flat, at, w = np.concatenate([x.ravel() for x in whole["value"].values()]), 0, {}
        for part, (rows, width) in shape.parts().items():
            w[part] = flat[at : at + rows * width].reshape(rows, width)
            at += rows * width
        lo, hi = ends[me], ends[me + 1]
        one, two = (np.concatenate([x.ravel() for x in whole[c].values()])[lo:hi] for c in ("first", "second"))
        losses_, pieces = list(whole["losses"]), [range(t, p.files, tasks) for t in range(tasks)]
        few = _slices(batches)
        ahead = next(few, None)
        for step in range(first, last + 1):
            # a row a piece: gradients, and at the end the sum of the losses and the number of rows
            own = np.zeros((len(pieces[me]), size + 2))
            for k, piece in enumerate(pieces[me]):
                rng, at, g = np.random.default_rng([p.seed, step, piece]), 0, {}
                for part, (rows, width) in shape.parts().items():
                    g[part] = own[k, at : at + rows * width].reshape(rows, width)
                    at += rows * width
                while ahead is not None and ahead[:2] == (step, piece):
                    x = Rows(ahead[2], shape)
                    keep = [(rng.random((n, shape.hidden)) >= p.dropout) / (1 - p.dropout) for n in (len(x.nodes), len(x.static))] if p.dropout else None
                    loss, more = gradients(w, x, keep)
                    for part, v in more.items():
                        g[part][x.slots if part == "embedding" else slice(None)] += v
                    own[k, size:] += loss, len(x.label)
                    ahead = next(few, None)
            stretch = lambda t: np.concatenate([own[:, ends[t] : ends[t + 1]], own[:, size:]], axis=1)  # noqa: B023, E731
            got = {t: stretch(t) if t == me else np.empty((len(pieces[t]), hi - lo + 2)) for t in range(tasks)}
            _swap(lines, me, stretch, lambda t: got[t])  # noqa: B023
            total = np.zeros(hi - lo + 2)
            for piece in range(p.files):
                total += got[piece % tasks][piece // tasks]
            *_, loss, n = total
            losses_.append(float(loss / n))
            flat[lo:hi], one, two = adamw(p, step, flat[lo:hi], one, two, total[:-2] / n)
            _swap(lines, me, lambda t: flat[lo:hi], lambda t: flat[ends[t] : ends[t + 1]])
        if ahead is not None:
            raise RuntimeError(f"rows of step {ahead[0]}, piece {ahead[1]} are not in their place")
        for s in lines.values():
            s.close()
        for part, shard, a, e in owned[me]:
            values = [x.tobytes() for x in (flat[a:e], one[a - lo : e - lo], two[a - lo : e - lo])]
            said = losses_ if part == "head2.b" else []
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([shard], pa.int32()), pa.array([last], pa.int32()), *[pa.array([x], pa.binary()) for x in values], pa.array([said], pa.list_(pa.float64()))], names=["part", "shard", "step", "value", "first", "second", "losses"])

    return run


def train(rows: DataFrame, folder: str, shape: Shape | None = None, plan: Plan | None = None, *, stop_after: int | None = None) -> list[float]:
    """Trains on rows (sample_id, label, slots, nodes, static), going on where the folder's last complete version ends; mean losses of all steps.

    stop_after ends the run after so many steps in all. The folder must be one that the driver and all executors share.
    """
    shape, p, spark = shape or Shape(), plan or Plan(), rows.sparkSession
    table = f"{folder}/rows"
    if not _exists(spark, f"{table}/_SUCCESS"):
        n = rows.count()
        if not n:
            raise ValueError("there are no rows to learn from")
        k = max(1, round(n / p.batch_rows))
        dealt = rows.select("sample_id", "label", "slots", "nodes", "static", F.pmod(F.xxhash64("sample_id", F.lit(p.seed)), F.lit(k)).alias("batch"))
        dealt.repartition("batch").sortWithinPartitions("batch", "sample_id").write.mode("overwrite").partitionBy("batch").parquet(table)
    staged = spark.read.parquet(table)
    sizes = {r[0]: r[1] for r in staged.groupBy("batch").count().collect()}  # a row a batch
    step = latest(spark, folder)
    if step is None:
        w, step = initial(shape, p.seed), 0
        zero = lambda x: np.zeros_like(x).tobytes()
        state = [(k, s, 0, w[k][a:e].tobytes(), zero(w[k][a:e]), zero(w[k][a:e]), []) for k in shape.parts() for s, a, e in shape.bounds(k)]
        spark.createDataFrame(state, STATE).write.mode("overwrite").parquet(_version(folder, 0))
    order = [b for e in range(p.epochs) for b in np.random.default_rng([p.seed, e]).permutation(sorted(sizes)).tolist()]
    sc, before, stop = spark.sparkContext, None, min(len(order), stop_after if stop_after is not None else len(order))
    tasks = max(1, min(p.files, sc.defaultParallelism // int(sc.getConf().get("spark.task.cpus", "1"))))
    while step < stop:
        last = min(step + p.span, stop)
        some = spark.createDataFrame([(s + 1, order[s]) for s in range(step, last)], "step int, b int")
        piece = F.pmod(F.xxhash64("sample_id"), F.lit(p.files)).cast("int")
        own = staged.where(F.col("batch").isin(order[step:last])).join(F.broadcast(some), F.col("batch") == F.col("b"))  # a row a step
        own = own.select("step", piece.alias("piece"), "sample_id", "label", "slots", "nodes", "static", F.xxhash64("label", "slots", "nodes", "static").alias("tie"))
        own = own.repartitionById(tasks, F.col("piece") % tasks).sortWithinPartitions("step", "piece", "sample_id", "tie")
        whole = sc.broadcast(_states(spark, folder, step, shape, "value", "first", "second") | {"losses": losses(spark, folder)})
        own.mapInArrow(_steps(whole, shape, p, step + 1, last, tasks, secrets.token_bytes(32)), STATE, barrier=True).write.mode("overwrite").parquet(_version(folder, last))  # type: ignore[arg-type]
        whole.destroy()
        if before is not None:  # the last two stay
            _delete(spark, _version(folder, before))
        before, step = step, last
    return losses(spark, folder)


def score(rows: DataFrame, w: Weights, shape: Shape | None = None) -> DataFrame:
    """(sample_id, rank_score): the probability of label 1."""
    shape = shape or Shape()
    kind = rows.select("sample_id").schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                few = b.slice(at, SLICE)
                logit, _ = forward(w, Rows(few, shape))
                yield pa.RecordBatch.from_arrays([few.column("sample_id"), pa.array(1 / (1 + np.exp(-logit)))], ["sample_id", "rank_score"])

    return rows.select("sample_id", "slots", "nodes", "static").mapInArrow(run, f"sample_id {kind.dataType.simpleString()}, rank_score double")
