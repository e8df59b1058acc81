"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is drawn and cut into parts of equal size
with as few neighbours apart as can be; a small network learns to tell a
vector's part. All vectors are stored in their most probable part; a query goes
to several most probable parts and is reranked there against every stored
vector by its exact inner product in double precision. How many parts it takes
is measured: the fewest that reach the wanted recall on held-out queries of the
sample. Parts fuller than a block are worked off in blocks, queries likewise, so
that no task holds a whole part.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows without an id or of another than the commonest dimension. Of rows
that share an id one counts. A query's own row is no candidate; equal scores go
by id. Fewer candidates than asked for give fewer rows; an empty table gives
none. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, named

#: Vectors of the sample on which partitions are learned, at most.
SAMPLE = 8_192
#: Rows of a part, about, and of a block.
PART_ROWS = 4_096
#: Sample vectors a part must have at least.
LEAST = 64
#: Neighbours of a vector in the graph.
DEGREE = 10
#: Cells are searched in this many tasks at most; a task then has several.
MAX_TASKS = 50_000
#: Recall wanted on held-out queries of the sample.
RECALL = 0.96


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The ``degree`` nearest of each vector, a row a vector, in blocks."""
    degree = min(degree, len(x) - 1)
    out = np.empty((len(x), degree), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at:at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at:at + 1024] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """Cut the graph into parts of equal size: halve along the widest direction, then move
    vertices to the part of most of their neighbours while there is room."""
    label = np.zeros(len(x), np.int64)

    def halve(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            label[rows] = first
            return
        y = x[rows] - x[rows].mean(0)
        order = np.argsort(y @ np.linalg.eigh(y.T @ y)[1][:, -1], kind="stable")
        cut = len(rows) * (n // 2) // n
        halve(rows[order[:cut]], first, n // 2)
        halve(rows[order[cut:]], first + n // 2, n - n // 2)

    halve(np.arange(len(x)), 0, parts)
    room = int(np.ceil(slack * len(x) / parts))
    a = np.concatenate([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()])
    b = np.concatenate([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])
    for _ in range(rounds):
        ties = np.zeros((len(x), parts))
        np.add.at(ties, (a, label[b]), 1)
        gain = ties.max(1) - ties[np.arange(len(x)), label]
        size, moved = np.bincount(label, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable"):
            to = int(ties[v].argmax())
            if gain[v] <= 0:
                break
            if size[to] < room and to != label[v]:
                size[label[v]] -= 1
                size[to] += 1
                label[v] = to
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """A network with one hidden layer that gives the probabilities of a vector's parts."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @staticmethod
    def train(x: np.ndarray, goal: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 3) -> Router:
        rnd = np.random.default_rng(seed)
        scale = 1 / max(1e-12, np.sqrt((x * x).mean()))
        r = Router(scale, rnd.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
                   rnd.normal(0, np.sqrt(1 / hidden), (hidden, goal.shape[1])), np.zeros(goal.shape[1]))
        z = x * scale
        weights = [r.w1, r.b1, r.w2, r.b2]
        m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            for rows in np.array_split(rnd.permutation(len(z)), max(1, len(z) // 256)):
                h = np.maximum(z[rows] @ r.w1 + r.b1, 0)
                d = (softmax(h @ r.w2 + r.b2) - goal[rows]) / len(rows)
                dh = (d @ r.w2.T) * (h > 0)
                t += 1
                for i, g in enumerate((z[rows].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):      # Adam
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    weights[i] -= 2e-3 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
        return r

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, the most probable first."""
        h = np.maximum((x * self.scale) @ self.w1 + self.b1, 0)
        return np.argsort(-(h @ self.w2 + self.b2), axis=1, kind="stable")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, parts: int, k: int, recall: float = RECALL) -> Router:
    """Learn the partition of a sample, and how many parts a query must try."""
    n = len(x)
    held = np.arange(0, n, 16) if n >= 512 else np.arange(0)
    inside = np.setdiff1d(np.arange(n), held)
    own = x[inside]
    parts = max(1, min(parts, len(own) // LEAST))
    if parts == 1:
        d = x.shape[1] if x.size else 1
        return Router(1.0, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(own, DEGREE)
    label = balanced_parts(own, graph, parts)
    goal = np.zeros((len(own), parts))
    goal[np.arange(len(own)), label] += graph.shape[1] / 2
    np.add.at(goal, (np.repeat(np.arange(len(own)), graph.shape[1]), label[graph.ravel()]), 1)
    router = Router.train(own, goal / goal.sum(1, keepdims=True))
    router.probes = parts
    if len(held):
        stored, tried = router.ranked(own)[:, 0], router.ranked(x[held])
        near = np.argsort(-(x[held] @ own.T), axis=1, kind="stable")[:, :k]
        place = (tried[:, None, :] == stored[near][:, :, None]).argmax(2)       # at which try each is found
        found = np.cumsum(np.bincount(place.ravel(), minlength=parts)) / place.size
        router.probes = int(np.argmax(found >= recall)) + 1
    return router


def top(queries: np.ndarray, query_ids: np.ndarray, stored: np.ndarray, stored_ids: np.ndarray, k: int):
    """The ``k`` largest inner products of each query, ties to the smaller id, as ``(ids, scores)``.
    A matrix product picks candidates; their scores are then summed in one order, so equal vectors tie."""
    for at in range(0, len(queries), 256):
        s = queries[at:at + 256] @ stored.T
        s[query_ids[at:at + 256, None] == stored_ids[None, :]] = -np.inf
        kth = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
        for i, row in enumerate(s):
            q = queries[at + i]
            margin = 1e-9 * (1 + np.abs(kth[i])) if np.isfinite(kth[i]) else 0.0
            some = np.nonzero((row >= kth[i] - margin) & np.isfinite(row))[0]
            exact = (q * stored[some]).sum(1)
            order = np.lexsort((stored_ids[some], -exact))[:k]
            yield query_ids[at + i], stored_ids[some][order], exact[order]


NEAR = pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())]))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of the rows that take part."""
    rows = df.select(named(id_col).cast("long").alias("id"), named(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def nearest(df: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            recall: float = RECALL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products found for each
    row whose id is divisible by ``query_every``, against all rows."""
    spark, stages = df.sparkSession, Stages(df.sparkSession, "nearest")
    rows = stages.table(usable(df, id_col, vector_col), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d, n = sizes if sizes else (1, 0)
    rows = rows.where(F.size("v") == d)
    some = rows.orderBy(F.xxhash64("id")).limit(SAMPLE) if n > SAMPLE else rows
    sample = np.array([r["v"] for r in some.sort("id").collect()], float).reshape(-1, d)    # bounded by SAMPLE
    router = spark.sparkContext.broadcast(fit(sample, int(np.ceil(n / PART_ROWS)), k, recall))

    def deal(batches):
        r = router.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            ranked = r.ranked(x)
            asks = np.nonzero(ids % query_every == 0)[0]
            row = np.concatenate([np.arange(len(ids)), np.repeat(asks, r.probes)])
            part = np.concatenate([ranked[:, 0], ranked[asks, :r.probes].ravel()])
            ask = np.arange(len(row)) >= len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), batch.column(1).take(pa.array(row)),
                                              pa.array(part, pa.int64()), pa.array(ask)], names=["id", "v", "part", "asks"])

    dealt = stages.table(rows.mapInArrow(deal, "id long, v array<double>, part long, asks boolean"), "dealt")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / PART_ROWS)).cast("int")
    full = dealt.groupBy("part").agg(blocks(F.count_if(~F.col("asks"))).alias("homes"), blocks(F.count_if("asks")).alias("askers"))
    sized = dealt.join(F.broadcast(full), "part")                     # a row a part, fewer than the sample has rows
    block = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = sized.where("not asks").select("part", "id", "v", "asks", block("homes").alias("i"), each("askers").alias("j"))
    asking = sized.where("asks").select("part", "id", "v", "asks", each("homes").alias("i"), block("askers").alias("j"))

    def search(key, cell):
        cell = cell.combine_chunks()
        asks = cell.column("asks").to_numpy()
        ids = cell.column("id").to_numpy()
        x = cell.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)
        if asks.all() or not asks.any():
            found = []
        else:
            found = list(top(x[asks], ids[asks], x[~asks], ids[~asks], k))
        return pa.table({"query_id": pa.array([q for q, _, _ in found], pa.int64()),
                         "near": pa.array([[{"far": -s, "vec_id": i} for i, s in zip(a.tolist(), b.tolist())]
                                           for _, a, b in found], NEAR)})

    # by cells, not by bytes: a cell is few bytes and much work
    n_cells = full.agg(F.sum(F.col("homes") * F.col("askers"))).first()[0] or 1
    cells = stored.unionAll(asking.select(*stored.columns)).repartition(min(int(n_cells), MAX_TASKS), "part", "i", "j")
    found = cells.groupBy("part", "i", "j").applyInArrow(
        search, "query_id long, near array<struct<far:double,vec_id:long>>")
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return best.select("query_id", F.posexplode("near").alias("at", "n")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.far")).alias("score"))
