"""L2 logistic regression by Newton methods whose sums go over rows.

Minimised is |w|^2 / 2 + c * sum of weighted losses, the intercept being one more weight: that of a column of ones, penalised
like the others. Rows are packed once into blocks of some ENTRIES entries, which tasks take one at a time. Of up to NEWTON
columns a step takes one pass that sums loss, gradient and Hessian. Of up to DENSE columns the Hessian is summed once, as
the metric of a quasi-Newton method (L-BFGS) each step of which is a pass over the entries alone, and again only after
AGAIN steps: its products cost the square of the columns a row. Tasks send a Hessian in strips of its upper triangle, which
are added by strip, and the driver holds the sum. Of more columns a trust-region method takes a pass for each of its
conjugate-gradient steps, in which every task sums its blocks, and the sums meet in slices of the tasks; the driver holds
vectors as long as the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.common import shared_path

#: Most rows of a block, and most entries, unless one row has more.
BLOCK, ENTRIES = 4096, 1 << 16
#: Most columns of which the Hessian is summed at each step, and at all. Columns of a strip of it; rows that are made dense at once.
NEWTON, DENSE, STRIP, ROWS = 256, 2560, 256, 2048
#: Steps and their gradients that L-BFGS keeps, and steps after which the Hessian is summed again. Bytes of sums that the driver takes as they are.
KEPT, AGAIN, DIRECT = 12, 12, 32 << 20
_BLOCKS = ("n", "length", "index", "value", "sign", "weight")
_SCHEMA = "n long, " + ", ".join(f"{c} binary" for c in _BLOCKS[1:])


def _packed(rows: DataFrame) -> DataFrame:
    """Staged blocks of rows (features, y, w): the rows' lengths, column and value of each entry, the labels as signs, the rows' weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(b.column(0).value_lengths().to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                end = np.searchsorted(ends, (ends[at - 1] if at else 0) + ENTRIES, "right")
                few = b.slice(at, max(1, min(int(end) - at, BLOCK)))
                at += few.num_rows
                index, value = few.column(0), few.column(1)
                out = (
                    index.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32), index.flatten().to_numpy(zero_copy_only=False).astype(np.int32), value.flatten().to_numpy(zero_copy_only=False).astype(float),
                    np.where(few.column(2).to_numpy(zero_copy_only=False) == 1, 1.0, -1.0), few.column(3).to_numpy(zero_copy_only=False).astype(float),
                )
                yield pa.RecordBatch.from_arrays([pa.array([few.num_rows], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in out]], list(_BLOCKS))

    path = shared_path(rows.sparkSession, "blocks")
    rows.mapInArrow(run, _SCHEMA).write.parquet(path)
    return rows.sparkSession.read.schema(_SCHEMA).parquet(path)


class _Block:
    def __init__(self, r: dict, size: int):
        self.n, self.size = r["n"], size
        self.of, self.index = np.repeat(np.arange(self.n), np.frombuffer(r["length"], np.int32)), np.frombuffer(r["index"], np.int32)
        self.value, self.sign, self.weight = (np.frombuffer(r[c], float) for c in ("value", "sign", "weight"))

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, self.value * v[self.index], minlength=self.n) + v[-1]

    def back(self, z: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.index, self.value * z[self.of], minlength=self.size), z.sum())


def _each(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[_Block]:
    """Blocks one at a time, not copied."""
    for b in batches:
        for i in range(b.num_rows):
            yield _Block({"n": b.column("n")[i].as_py()} | {c: b.column(c)[i].as_buffer() for c in _BLOCKS[1:]}, size)


class _Square:
    """Adds the products of all pairs of columns, rows weighted by d >= 0, the intercept's column of ones the last."""

    def __init__(self, size: int):
        self.total, self.rows, self.n = np.zeros((size + 1, size + 1)), np.zeros((ROWS, size + 1)), 0

    def add(self, b: _Block, d: np.ndarray) -> None:
        root, at = np.sqrt(d), 0
        while at < b.n:
            k = min(b.n - at, ROWS - self.n)
            a, e = np.searchsorted(b.of, [at, at + k])
            np.add.at(self.rows.reshape(-1), (b.of[a:e] - at + self.n) * (b.size + 1) + b.index[a:e], b.value[a:e] * root[b.of[a:e]])
            self.rows[self.n : self.n + k, -1] += root[at : at + k]
            self.n, at = self.n + k, at + k
            if self.n == ROWS:
                self.sum()

    def sum(self) -> np.ndarray:
        x = self.rows[: self.n]
        self.total += x.T @ x
        x[:], self.n = 0.0, 0
        return self.total


def _sum(blocks: DataFrame, size: int, f: Callable[[_Block], np.ndarray]) -> np.ndarray:
    """The sum of f over all blocks: of each task, then of slices of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in _each(batches, size):
            own = f(b)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "total"])

    def more(t: pa.Table) -> pa.Table:
        rows = sorted(t.select(["task", "total"]).to_pylist(), key=lambda r: r["task"])
        return pa.table({"task": pa.array([rows[0]["task"]], pa.int32()), "total": pa.array([sum(np.frombuffer(r["total"], float) for r in rows).tobytes()], pa.binary())})

    kind = "task int, total binary"
    sent = blocks.mapInArrow(run, kind)
    n = blocks.rdd.getNumPartitions()
    if n > 32 and n * 8 * size > DIRECT:
        sent = sent.groupBy(F.pmod("task", F.lit(int(n**0.5))).alias("slice")).applyInArrow(more, kind)
    got = sorted(sent.collect())
    return np.sum([np.frombuffer(r[1], float) for r in got], axis=0)


def _squares(blocks: DataFrame, size: int, f: Callable[[_Block], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all blocks: of the first that f gives, and of the products of columns with the second as rows' weights.

    Tasks are no more than twice the cores, so that what they send does not grow with the rows.
    """
    n = size + 1
    kind = "strip int, task int, total binary"

    def strips(total: np.ndarray, square: np.ndarray) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, x in [(-1, total), *((i, square[at : at + STRIP, at:]) for i, at in enumerate(range(0, n, STRIP)))]:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())], ["strip", "task", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = None, _Square(size)
        for b in _each(batches, size):
            own, d = f(b)
            total = own if total is None else total + own
            square.add(b, d)
        if total is not None:
            yield from strips(total, square.sum())

    def more(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("task").to_numpy())
        out = sum(np.frombuffer(t.column("total")[int(i)].as_buffer(), float) for i in order)
        return pa.table({"strip": t.column("strip")[:1], "task": t.column("task")[:1], "total": pa.array([out.tobytes()], pa.binary())})

    few = blocks.coalesce(max(1, 2 * blocks.sparkSession.sparkContext.defaultParallelism))
    got = {r[0]: np.frombuffer(r[1], float) for r in few.mapInArrow(run, kind).groupBy("strip").applyInArrow(more, kind).select("strip", "total").collect()}
    square = np.zeros((n, n))
    for i, at in enumerate(range(0, n, STRIP)):
        square[at : at + STRIP, at:] = got[i].reshape(-1, n - at)
    upper = np.triu(square)
    return got[-1], upper + np.triu(upper, 1).T


def _quasi(at: Callable, fall: Callable, w: np.ndarray, c: float, steps: int, tol: float) -> np.ndarray:
    """The w of least loss by L-BFGS in the metric of the Hessian. at(w): loss, gradient, Hessian without penalty; fall(w): the first two."""
    loss, g, hessian = at(w)
    metric, moves = np.linalg.inv(c * hessian + np.eye(len(w))), []
    first = max(float(np.linalg.norm(g)), 1e-300)
    for k in range(1, steps + 1):
        if np.linalg.norm(g) <= tol * first:
            break
        if k % AGAIN == 0:
            loss, g, hessian = at(w)
            metric, moves = np.linalg.inv(c * hessian + np.eye(len(w))), []
        d, alphas = -g, []
        for s, y in reversed(moves):
            alphas.append((s @ d) / (s @ y))
            d = d - alphas[-1] * y
        d = metric @ d
        if moves:
            s, y = moves[-1]
            d = d * ((s @ y) / (y @ metric @ y))
        for (s, y), alpha in zip(moves, reversed(alphas), strict=True):
            d = d + (alpha - (y @ d) / (s @ y)) * s
        slope, step = float(g @ d), 1.0
        while True:
            then, g_then = fall(w + step * d)
            ahead = float(g_then @ d)
            # the loss falls, or as far as doubles show it does not rise while the slope flattens
            if then <= loss + 1e-4 * step * slope or (then <= loss + 1e-12 * abs(loss) and abs(ahead) <= -0.9 * slope):
                break
            if step < 1e-6:
                return w
            step *= min(max(slope / (slope - ahead), 0.1), 0.5) if ahead > 0 else 0.5
        s, y = step * d, g_then - g
        if s @ y > 0:
            moves = [*moves, (s, y)][-KEPT:]
        w, loss, g = w + s, then, g_then
    return w


def logistic(rows: DataFrame, size: int, c: float = 1.0, steps: int = 100, tol: float = 1e-8) -> np.ndarray:
    """Weights of the columns and, last, of the intercept. rows: features (index, value arrays), y (0 or 1), w; size: number of columns."""
    blocks = _packed(rows.select("index", "value", "y", "w"))

    dense = size <= DENSE
    quasi = NEWTON < size <= DENSE

    def losses(b: _Block, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and, last, loss; and the rows' curvatures."""
        z = b.sign * b.times(w)
        p = 1 / (1 + np.exp(np.clip(z, -700, 700)))
        return np.append(b.back(-b.weight * b.sign * p), (b.weight * np.logaddexp(0, -z)).sum()), b.weight * p * (1 - p)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray | None]:
        """Loss, gradient, and the sum of the Hessian if it is small."""
        s, h = _squares(blocks, size, lambda b: losses(b, w)) if dense else (_sum(blocks, size, lambda b: losses(b, w)[0]), None)
        return c * float(s[-1]) + float(w @ w) / 2, c * s[:-1] + w, h

    def curve(w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The Hessian times v."""
        if hessian is not None:
            return c * (hessian @ v) + v

        def f(b: _Block) -> np.ndarray:
            p = 1 / (1 + np.exp(-np.clip(b.times(w), -700, 700)))
            return b.back(b.weight * p * (1 - p) * b.times(v))

        return c * _sum(blocks, size, f) + v

    if quasi:

        def fall(w: np.ndarray) -> tuple[float, np.ndarray]:
            s = _sum(few, size, lambda b: losses(b, w)[0])
            return c * float(s[-1]) + float(w @ w) / 2, c * s[:-1] + w

        few = blocks.coalesce(max(1, 2 * blocks.sparkSession.sparkContext.defaultParallelism))
        return _quasi(at, fall, np.zeros(size + 1), c, 10 * steps, tol / 100)
    w = np.zeros(size + 1)
    loss, g, hessian = at(w)
    radius, first = float(np.linalg.norm(g)), float(np.linalg.norm(g))
    for _ in range(steps):
        if np.linalg.norm(g) <= tol * max(first, 1e-300):
            break
        # conjugate gradients within the trust region
        s, r, d = np.zeros_like(w), -g, -g
        edge = False
        while np.linalg.norm(r) > (1e-4 if dense else 0.1) * np.linalg.norm(g) and not edge:
            h = curve(w, d)
            step = (r @ r) / (d @ h)
            if np.linalg.norm(s + step * d) > radius:
                a, b2, c2 = d @ d, s @ d, s @ s - radius * radius
                step, edge = (-b2 + np.sqrt(b2 * b2 - a * c2)) / a, True
            s, new = s + step * d, r - step * h
            d, r = new + (new @ new) / (r @ r) * d, new
        expected = float(s @ (r - g)) / 2  # the fall that the quadratic model expects
        then, g_then, h_then = at(w + s)
        share = (loss - then) / expected if expected > 0 else 0.0
        size_s = float(np.linalg.norm(s))
        radius = max(2 * radius, size_s) if share > 0.75 and edge else radius if share > 0.25 else 0.25 * size_s
        if share > 1e-4:
            w, loss, g, hessian = w + s, then, g_then, h_then
        elif expected <= 1e-14 * abs(loss):  # no fall is left that doubles can show
            break
    return w
