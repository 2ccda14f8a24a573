"""Embedding near-duplicates by a robust-pruned flat graph, built on overlapping cluster shards and searched as a whole.

1. Exact copies are folded into one vector with a count; vectors become unit vectors in double precision.
2. Cells are cut by k-means pivots, each from a bounded sample of its cell, until none is larger than two shards. A vector
   joins the cells of its `overlap` nearest pivots (its copies, in deeper cuts, only the nearest); the nearest is its home.
3. In each shard, every vector's nearest candidates (from block products; a shard is small) are robustly pruned: one goes if
   a kept one is `alpha` times nearer to it. Lists are made mutual. The lists of all shards are united into one
   adjacency table: a vector's neighbours in any of its shards.
4. The united graph is searched, home by home. A query enters at the home's medoid (and then at its own node, if the greedy
   search has not come by it) and expands what is within the range and some slack, so it walks through whole
   neighbourhoods. Neighbours that live elsewhere and can be in range, by the angles of the edges walked, are sent as a visit
   to their home, round by round until no visit is left. Links to the vectors of a home are counted there, after their
   similarity is computed in double precision; a query that comes again brings the bits of what it has seen, so no link
   counts twice, and none is below `reach`.
5. A bounded set of probes is compared with all vectors. If the recall of their links is under `least`, vectors join more
   shards and the search is done again; the recall measured is a column of the result.

Only counts and a spanning forest of each visit's links leave a task, so a large group of near copies costs no more edges than
it has vectors, though a comparison for each of its links.

Samples: pivots learn from at most `sample` vectors of a cell, recall is measured with at most `probes` vectors, both by a
hash of the id. All vectors are indexed and all are queries.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do rows with
a null id and vectors of different lengths with each other; components of any size keep their direction, as they are
scaled before squares are taken; repeated vectors link with each other; ids are taken as unique, repeated rows of one id
keep a row each; ties between pivots go to the first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import small, stage
from siltstone.llm.graph import components

DEGREE, CANDIDATES, ALPHA, BLOCK, SURE = 24, 40, 1.2, 256, 3
#: Children of a cell at most, rows of a cell that are dealt in one task, and cuts below each other.
FAN, DEAL, DEPTH = 1024, 1 << 17, 8
SLACK = 0.08


def _unit(v: list | None) -> np.ndarray | None:
    """The unit vector, null if there is none."""
    if not v or None in v:
        return None
    x = np.array(v, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top if top > 1e-300 else x * 1e300 / (top * 1e300)
    return x / np.sqrt((x * x).sum())


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vec, key = [], []
        for v in b.column(1).to_pylist():
            u = _unit(v)
            vec.append(None if u is None else u.tobytes())
            key.append(None if u is None else hashlib.md5(np.array(v, np.float64).tobytes()).digest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vec, pa.binary()), pa.array(key, pa.binary())], ["vec_id", "vec", "key"])


def _matrix(column: pa.ChunkedArray | list) -> np.ndarray:
    vec = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(vec), np.float64).reshape(len(vec), -1)


def pivots(unit: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of spherical k-means, started from vectors spread over the sample."""
    centre = unit[np.linspace(0, len(unit) - 1, min(k, len(unit))).astype(int)].copy()
    for _ in range(rounds):
        near = (unit @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, unit)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centre)
    return centre


class Graph:
    """Robust-pruned adjacency lists over the rows of x, unit vectors: edges holds row numbers, -1 for none."""

    def __init__(self, x: np.ndarray):
        self.x = x
        n = len(x)
        c = min(CANDIDATES, n - 1)
        lists: list[np.ndarray] = []
        for at in range(0, n, BLOCK):
            s = x[at : at + BLOCK] @ x.T
            s[np.arange(len(s)), at + np.arange(len(s))] = -2
            near = np.argpartition(-s, c - 1, axis=1)[:, :c] if c else np.zeros((len(s), 0), int)
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
            for part in range(0, len(s), 64):
                lists += self._prune(near[part : part + 64], np.take_along_axis(s, near, 1)[part : part + 64])
        source = np.repeat(np.arange(n), [len(v) for v in lists])
        target = np.concatenate(lists) if lists else np.zeros(0, int)
        a, b = np.concatenate([source, target]), np.concatenate([target, source])
        key = np.unique(a * n + b)
        a, b = key // n, key % n
        order = np.lexsort((-np.einsum("ij,ij->i", x[a], x[b]), a))
        a, b = a[order], b[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        # long lists are cut, but each vector stays in the lists of the nearest it has kept, so that it can be reached
        own = np.concatenate([v[:SURE] * n + i for i, v in enumerate(lists)]) if lists else np.zeros(0, int)
        keep = (rank < 3 * DEGREE) | np.isin(a * n + b, own)
        self.a, self.b = a[keep], b[keep]

    def _prune(self, near: np.ndarray, sim: np.ndarray) -> list[np.ndarray]:
        """Robust pruning of sorted candidate lists."""
        v = self.x[near]
        between = 1 - np.einsum("bid,bjd->bij", v, v)
        dist, alive, kept = 1 - sim, np.ones(near.shape, bool), np.zeros(near.shape, bool)
        for i in range(near.shape[1]):
            take = alive[:, i] & (kept.sum(axis=1) < DEGREE)
            kept[:, i] = take
            alive &= ~(take[:, None] & (ALPHA * between[:, i, :] <= dist))
        return [row[k] for row, k in zip(near, kept, strict=True)]


def search(x: np.ndarray, edges: np.ndarray, q: np.ndarray, enter: list[np.ndarray], reach: float, own: np.ndarray | None = None, before: np.ndarray | None = None, effort: int = 8, width: int = 4) -> np.ndarray:
    """Similarities (query, row of x) of what a range-expanding greedy search has seen, -2 elsewhere, -3 for what it saw before.

    enter: rows that each query begins with. own: each query's own row, where a query begins anew that has not come by it.
    """
    n, rows = len(x), np.arange(len(q))
    sim = np.full((len(q), n), -2.0) if before is None else np.where(before, -3.0, -2.0)
    todo = np.full((len(q), n), -2.0)  # similarity of what is seen but not expanded

    def see(r: np.ndarray, k: np.ndarray) -> None:
        flat = np.unique(r * n + k)
        r, k = flat // n, flat % n
        new = sim[r, k] == -2
        r, k = r[new], k[new]
        sim[r, k] = todo[r, k] = np.einsum("ij,ij->i", q[r], x[k])

    def walk(live: np.ndarray) -> None:
        spent, w = np.zeros(len(q), int), min(width, n)
        while len(live):
            best = np.argpartition(-todo[live], w - 1, axis=1)[:, :w]
            value = np.take_along_axis(todo[live], best, 1)
            go = (value > -2) & ((value >= reach - SLACK) | (spent[live] < effort)[:, None])
            active = go.any(axis=1)
            live, best, go = live[active], best[active], go[active]
            spent[live] += go.sum(axis=1)
            i, j = np.nonzero(go)
            r, k = live[i], best[i, j]
            todo[r, k] = -2
            e = edges[k]
            r, k = np.repeat(r, e.shape[1]), e.ravel()
            see(r[k >= 0], k[k >= 0])

    see(np.repeat(rows, [len(e) for e in enter]), np.concatenate(enter))
    walk(rows)
    if own is not None and len(lost := np.flatnonzero(sim[rows, own] == -2)):
        see(lost, own[lost])
        walk(lost)
    return sim


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable row of every row."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def _cut(vectors: DataFrame, sample: int, per_shard: int, overlap: int) -> DataFrame:
    """(rep, m, vec, cell, home): the vectors dealt to cells of at most some 2 per_shard vectors, staged."""

    def learn(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        k = max(2, min(FAN, -(-t.column("n")[0].as_py() * overlap // per_shard)))
        return pa.table({"cell": t.column("cell").slice(0, 1), "pivots": pa.array([pivots(_matrix(t.column("vec")), k).tobytes()], pa.binary())})

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(["rep", "m", "vec", "cell", "home"])
        x, cell = _matrix(left.column("vec")), left.column("cell")[0].as_py()
        centre = np.frombuffer(right.column("pivots")[0].as_py(), np.float64).reshape(-1, x.shape[1])
        take, child = [], []
        home = np.array(left.column("home").to_pylist(), bool)
        for at in range(0, len(x), 4096):
            near = np.argsort(-(x[at : at + 4096] @ centre.T), axis=1, kind="stable")[:, :overlap]
            used = home[at : at + 4096, None] | (np.arange(near.shape[1]) == 0)
            r, c = np.nonzero(used)
            take.append(r + at)
            child.append(np.stack([near[r, c], c]))
        i, (j, rank) = np.concatenate(take), np.concatenate(child, axis=1)
        path = [int.from_bytes(hashlib.blake2b(b"%d/%d" % (cell, k), digest_size=8).digest(), "big", signed=True) for k in range(len(centre))]
        part = left.select(["rep", "m", "vec"]).take(pa.array(i))
        return part.append_column("cell", pa.array([path[k] for k in j.tolist()], pa.int64())).append_column("home", pa.array(home[i] & (rank == 0)))

    todo = vectors.select("rep", "m", "vec", F.octet_length("vec").cast("long").alias("cell"), F.lit(True).alias("home"))
    done, made = [], "rep long, m long, vec binary, cell long, home boolean"
    for _ in range(DEPTH):
        size = stage(todo.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * per_shard)).withColumnRenamed("cell", "big")
        if size.isEmpty():
            break
        big = todo.join(small(size), F.col("cell") == F.col("big"), "left")
        done.append(big.where("big is null").select("rep", "m", "vec", "cell", "home"))
        big = big.where("big is not null")
        r = F.pmod(F.xxhash64("rep"), F.lit(1 << 40)) / float(1 << 40)
        some = big.where(r * F.col("n") <= sample).select("cell", "n", "rep", "vec")
        centres = stage(some.groupBy("cell").applyInArrow(learn, "cell long, pivots binary"))
        salts = F.ceil(F.col("n") / DEAL).cast("int")
        salted = big.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(7)), salts).cast("int")).select("rep", "m", "vec", "cell", "home", "salt")
        spread = centres.join(small(size), F.col("cell") == F.col("big")).select("cell", "pivots", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        todo = stage(salted.groupBy("cell", "salt").cogroup(spread.groupBy("cell", "salt")).applyInArrow(deal, made))
    for d in done:
        todo = todo.union(d)
    return stage(todo.repartition("cell"))


def _build(t: pa.Table) -> pa.Table:
    """The edges (a, b, sim) of a shard, and its home's medoid as an edge (a, a)."""
    t = t.sort_by("rep")
    rep, x = t.column("rep").to_numpy(), _matrix(t.column("vec"))
    g = Graph(x)
    sim = np.einsum("ij,ij->i", x[g.a], x[g.b])
    own = np.flatnonzero(np.array(t.column("home").to_pylist(), bool))
    middle = own[[int((x[own] @ x[own].mean(axis=0)).argmax())]] if len(own) else own
    return pa.table({"a": np.concatenate([rep[g.a], rep[middle]]), "b": np.concatenate([rep[g.b], rep[middle]]), "sim": np.concatenate([sim, np.ones(len(middle))])})


_FOUND = "kind int, a long, b long, n long, vec binary, enter array<long>"


def _visit(reach: float, first: bool) -> Callable[..., pa.Table]:
    """Search of a home: of all of its own vectors (first), or of visits (q, vec, enter) from elsewhere.

    Gives links of a query (kind 0: a, n), forest edges (1: a, b), visits to other homes (2: a, home b, vec, enter), and what a
    query has seen of this home, as bits (3: a, home b, vec).
    """

    def run(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
        kinds: list[list] = [[], [], [], [], [], []]

        def add(kind: int, a: list, b: list | None = None, n: list | None = None, vec: list | None = None, enter: list | None = None) -> None:
            for out, x in zip(kinds, ([kind] * len(a), a, b, n, vec, enter), strict=True):
                out += x if x is not None else [None] * len(a)

        left = left.sort_by("rep")
        rep, m = left.column("rep").to_numpy(), left.column("m").to_numpy()
        if len(rep) and (right is None or right.num_rows):
            x, home = _matrix(left.column("vec")), left.column("home")[0].as_py()
            near = left.column("near").combine_chunks()
            count = np.diff(near.offsets.to_numpy())
            of = np.repeat(np.arange(len(rep)), count)
            flat = near.flatten()
            to, to_home, edge = (flat.field(k).to_numpy() for k in ("b", "home", "sim"))
            inside = to_home == home
            i, j = of[inside], np.searchsorted(rep, to[inside])
            self_edge = i == j
            medoid = i[self_edge]
            i, j = i[~self_edge], j[~self_edge]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            edges = np.full((len(rep), int(rank.max(initial=0)) + 1), -1)
            edges[i, rank] = j
            out_of, out_to, out_home, out_angle = of[~inside], to[~inside], to_home[~inside], np.arccos(np.clip(edge[~inside], -1, 1))
            begin = np.searchsorted(out_of, np.arange(len(rep) + 1))
            if right is None:
                q, ids = x, rep
                enter = [medoid if len(medoid) else np.array([0])] * len(q)
            else:
                right = right.sort_by("a")
                q, ids = _matrix(right.column("vec")), right.column("a").to_numpy()
                enter = [np.unique(np.searchsorted(rep, e)) for e in right.column("enter").to_pylist()]
                known = right.column("seen").to_pylist()
            widest = np.arccos(reach - SLACK)
            link_q, link_x = [], []
            for at in range(0, len(q), BLOCK):
                part = q[at : at + BLOCK]
                own, before = (np.arange(at, at + len(part)) if right is None else None), None
                if right is not None:
                    before = np.zeros((len(part), len(rep)), bool)
                    for r, bits in enumerate(known[at : at + BLOCK]):
                        if bits is not None:
                            before[r] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(rep)).astype(bool)
                sim = search(x, edges, part, enter[at : at + BLOCK], reach, own, before)
                seen = sim != -2
                fresh = np.flatnonzero((sim > -2).any(axis=1))
                add(3, ids[at + fresh].tolist(), [home] * len(fresh), vec=[np.packbits(s).tobytes() for s in seen[fresh]])
                if own is not None:
                    sim[np.arange(len(part)), own] = 1.0
                hit = sim >= reach
                if own is not None:
                    hit[np.arange(len(part)), own] = False
                r, k = np.nonzero(hit)
                add(0, ids[at : at + len(part)].tolist(), n=(hit @ m).tolist())
                link_q.append(r + at)
                link_x.append(k)
                # neighbours elsewhere that can be in range, seen from a vector in range
                r, k = np.nonzero(sim >= reach - SLACK)
                size = begin[k + 1] - begin[k]
                spot = np.repeat(begin[k], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                angle = np.repeat(np.arccos(np.clip(sim[r, k], -1, 1)), size)
                can = np.abs(out_angle[spot] - angle) <= widest
                asks: dict[tuple[int, int], set[int]] = {}
                for who, where, what in zip(np.repeat(r, size)[can].tolist(), out_home[spot[can]].tolist(), out_to[spot[can]].tolist(), strict=True):
                    asks.setdefault((who, where), set()).add(what)
                add(2, [int(ids[at + who]) for who, _ in asks], [h for _, h in asks], vec=[part[who].tobytes() for who, _ in asks], enter=[sorted(e) for e in asks.values()])
            lq, lx = np.concatenate(link_q), np.concatenate(link_x)
            if right is None:
                name, root = rep, _forest(len(rep), lq, lx)
            else:
                name, root = np.concatenate([rep, ids]), _forest(len(rep) + len(ids), lx, lq + len(rep))
            tied = np.flatnonzero(root != np.arange(len(root)))
            add(1, name[tied].tolist(), name[root[tied]].tolist())
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, t) for c, t in zip(kinds, types, strict=True)], names=["kind", "a", "b", "n", "vec", "enter"])

    return (lambda t: run(t)) if first else run


def _link(reps: DataFrame, reach: float, sample: int, per_shard: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(links (a, n), forest (a, b)) of the search."""
    dealt = _cut(reps, sample, per_shard, overlap)
    built = stage(dealt.groupBy("cell").applyInArrow(_build, "a long, b long, sim double"))
    homes = dealt.where("home").select(F.col("rep").alias("h_rep"), F.col("cell").alias("home"))
    united = built.groupBy("a", "b").agg(F.max("sim").alias("sim")).join(homes, F.col("b") == F.col("h_rep"))
    lists = united.groupBy("a").agg(F.collect_list(F.struct("b", "home", "sim")).alias("near"))  # some 3 DEGREE a shard at most
    nodes = dealt.where("home").select("rep", "m", "vec", F.col("cell").alias("home")).join(lists, F.col("rep") == F.col("a"), "left")
    none = F.array().cast("array<struct<b:long,home:long,sim:double>>")
    nodes = stage(nodes.select("rep", "m", "vec", "home", F.coalesce("near", none).alias("near")).repartition("home"))
    found = stage(nodes.groupBy("home").applyInArrow(_visit(reach, True), _FOUND))
    links, forest = found.where("kind = 0"), found.where("kind = 1")
    seen = stage(found.where("kind = 3").select(F.col("a").alias("s_a"), F.col("b").alias("s_b"), F.col("vec").alias("seen")))
    while True:
        asks = found.where("kind = 2").groupBy("a", "b").agg(F.first("vec").alias("vec"), F.array_distinct(F.flatten(F.collect_list("enter"))).alias("enter"))
        asks = asks.join(seen, (F.col("a") == F.col("s_a")) & (F.col("b") == F.col("s_b")), "left")
        asks = stage(asks.select("a", "vec", "enter", "seen", F.col("b").alias("home")))
        if asks.isEmpty():
            return links.groupBy("a").agg(F.sum("n").alias("n")), forest.select("a", "b")
        there = nodes.join(small(stage(asks.select(F.col("home").alias("asked")).distinct())), F.col("home") == F.col("asked"), "left_semi")
        found = stage(there.groupBy("home").cogroup(asks.groupBy("home")).applyInArrow(_visit(reach, False), _FOUND))
        links, forest = links.union(found.where("kind = 0")), forest.union(found.where("kind = 1"))
        new = found.where("kind = 3").select(F.col("a").alias("s_a"), F.col("b").alias("s_b"), F.col("vec").alias("seen"))
        seen = stage(seen.join(new, ["s_a", "s_b"], "left_anti").union(new))


def _true_links(reps: DataFrame, queries: list, reach: float) -> DataFrame:
    """(a, n): the links of the queries (rep, vec) with all vectors, compared in blocks."""
    by: dict[int, list] = {}
    for rep, vec in queries:
        by.setdefault(len(vec) // 8, []).append((rep, bytes(vec)))
    blocks = {d: (np.array([r for r, _ in v]), _matrix([x for _, x in v])) for d, v in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros(len(ids), np.int64) for d, (ids, _) in blocks.items()}
        for b in batches:
            m, vec, rep = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy()
            size = np.array([len(v) // 8 for v in vec])
            for d, (ids, q) in blocks.items():
                own = np.flatnonzero(size == d)
                for at in range(0, len(own), 2048):
                    who = own[at : at + 2048]
                    near = _matrix([vec[i] for i in who]) @ q.T >= reach
                    total[d] += m[who] @ (near & (rep[who][:, None] != ids))
        for d, (ids, _) in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[d], pa.int64())], ["a", "n"])

    return reps.select("m", "vec", "rep").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def group(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", reach: float = 0.9, sample: int = 8192, per_shard: int = 1500, overlap: int = 3, probes: int = 1024, least: float = 0.98, tries: int = 3, floor: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of every row; recall: share of the probes' true links that were found.

    A vector joins `overlap` shards; as long as the recall is under `least`, twice as many, in up to `tries` searches. A recall
    below `floor` after these is an error, not a result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = stage(rows.mapInArrow(_keys, "vec_id long, vec binary, key binary"))
    good = rows.where("key is not null and vec_id is not null")
    reps = stage(good.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("vec").alias("vec")))
    asked = reps.orderBy(F.xxhash64("rep"), "rep").limit(probes).select("rep", "vec").collect()
    truth = stage(_true_links(reps, asked, reach).withColumnsRenamed({"a": "t_a", "n": "true"}))
    while True:
        links, forest = _link(reps, reach, sample, per_shard, overlap)
        links, tries = stage(links), tries - 1
        both = truth.join(links, F.col("t_a") == F.col("a"), "left").agg(F.sum(F.least("true", F.coalesce("n", F.lit(0)))), F.sum("true")).first()
        recall = float(both[0]) / float(both[1]) if both[1] else 1.0
        if recall >= least or not tries:
            break
        overlap *= 2
    if recall < floor:
        raise RuntimeError(f"the search found {recall:.3f} of the probes' links, {floor} are wanted: raise overlap or tries")
    roots = components(forest)
    label = reps.select("key", "rep", "m").join(links, F.col("rep") == F.col("a"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    label = stage(label.select(F.col("key").alias("l_key"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("root", "rep").alias("root")))
    out = rows.join(label, (F.col("key") == F.col("l_key")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(recall).alias("recall"))


def audit(vectors: DataFrame, found: DataFrame, *, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", reach: float = 0.9) -> float:
    """Recall of the links of the vectors whose id is divisible by `every` (a query set, brought to the driver), against all vectors,
    as found / true counts."""
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = d.mapInArrow(_keys, "vec_id long, vec binary, key binary").where("vec_id is not null and vec is not null").select("vec_id", "vec")
    queries = rows.where(F.col("vec_id") % every == 0).collect()
    if not queries:
        return 1.0
    truth = _true_links(rows.select(F.col("vec_id").alias("rep"), "vec", F.lit(1).cast("long").alias("m")), [tuple(r) for r in queries], reach).withColumnRenamed("a", "id")
    both = truth.join(found, truth.id == found.vec_id).agg(F.sum(F.least("n", "n_links")), F.sum("n")).first()
    return 1.0 if not both[1] else float(both[0]) / float(both[1])


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept, CAST(1 AS DOUBLE) AS recall FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""
