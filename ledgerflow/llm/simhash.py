"""SimHash near-duplicates, found through vantage-point trees.

Fingerprints: one bit per hash bit, set where more than half of a text's
shingles have it. Equal fingerprints are one point. A vantage-point tree, built
from a bounded sample, deals the points out to shards: a node's points within
the median distance of its vantage point go inside, the others outside. A point
is stored in its home shard, and wherever the triangle bound says that points
within the maximum distance may lie across a boundary, it also queries the
shards there; of two points that part at a node only the inner one asks. In a
shard, points are held in the order of their distance to a vantage point of its
own, and a query compares only the ring that the triangle bound leaves. So every
pair within the distance is found, and none is missed. A shard links its pairs
into trees at once; the trees meet in a distributed union-find.

Texts without words have fingerprint zero, which links like any other; null
texts count as empty. Repeated rows are separate rows of one component; a null
id is never the smallest unless all are null. An empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, id_text, map_batches, named
from .components import components

#: Points of the sample from which the tree is built, at most.
SAMPLE = 32_768
#: Points stored in a shard, about. Larger shards compare more, smaller ones are asked by more
#: points of other shards (each level of the tree sends about a quarter of its points across).
SHARD = 32_768
#: A shard with more points than this is worked off in blocks of this size.
BLOCK = 65_536
#: Sample points a leaf must have at least.
LEAST = 16
#: Cells are compared in this many tasks at most; a task then has several.
MAX_TASKS = 50_000
SHINGLE_CHUNK = 65_536


def fingerprint(raw: bytes, shingle: int, seed: int) -> int:
    """Signed 64-bit SimHash of a text's UTF-8 bytes."""
    words = raw.lower().split()                           # on bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    text = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.diff(ends, prepend=0))[:len(words) - size + 1].tolist()
    ends = (ends - 1)[size - 1:].tolist()
    n, bits, hashed = len(starts), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLE_CHUNK):
        h = np.array([hashed(text[a:b], seed) for a, b in
                      zip(starts[at:at + SHINGLE_CHUNK], ends[at:at + SHINGLE_CHUNK])], "<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row."""
    rows = id_text(df, id_col, text_col).select("id", F.col("text").cast("binary").alias("raw"))
    return map_batches(rows, lambda b: {"id": b.column(0), "fp": [fingerprint(t.as_py(), shingle, seed)
                                                                  for t in b.column(1)]},
                       "id long, fp long", ["id", "fp"], [pa.int64(), pa.int64()])


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Tree:
    """A vantage-point tree as arrays; node k has its inner child at ``inner[k]`` and its
    outer one at ``outer[k]``; a negative child is shard ``~child``."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 7):
        self.vantage, self.radius, self.inner, self.outer, self.shards = [], [], [], [], 0
        rnd = np.random.default_rng(seed)
        self.root = self._grow(np.sort(sample), depth, rnd)
        self.vantage, self.radius = np.array(self.vantage, "u8"), np.array(self.radius, "i8")
        self.inner, self.outer = np.array(self.inner, "i8"), np.array(self.outer, "i8")

    def _leaf(self) -> int:
        self.shards += 1
        return ~(self.shards - 1)

    def _grow(self, points: np.ndarray, depth: int, rnd) -> int:
        if depth == 0 or len(points) < 2 * LEAST:
            return self._leaf()
        picks = points[rnd.integers(0, len(points), 8)]
        far = [distance(points, p) for p in picks]
        best = max(range(len(picks)), key=lambda i: far[i].std())     # the widest spread leaves the least at the border
        radius = int(np.median(far[best]))
        inside = far[best] <= radius
        if inside.all() or not inside.any():
            return self._leaf()
        k = len(self.vantage)
        self.vantage.append(picks[best])
        self.radius.append(radius)
        self.inner.append(0)
        self.outer.append(0)
        self.inner[k] = self._grow(points[inside], depth - 1, rnd)
        self.outer[k] = self._grow(points[~inside], depth - 1, rnd)
        return k

    def route(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, shard, asks)``: the home shard of every point, and the shards it asks."""
        row, node = np.arange(len(points)), np.full(len(points), self.root)
        asks, done = np.zeros(len(points), bool), []
        while len(row):
            leaf = node < 0
            done.append((row[leaf], ~node[leaf], asks[leaf]))
            row, node, asks = row[~leaf], node[~leaf], asks[~leaf]
            if not len(row):
                break
            d, r = distance(points[row], self.vantage[node]), self.radius[node]
            inside = d <= r
            stays = (row, np.where(inside, self.inner[node], self.outer[node]), asks)
            over = (inside & (d > r - reach)) | (asks & ~inside & (d <= r + reach))
            other = (row[over], np.where(inside, self.outer[node], self.inner[node])[over],
                     np.ones(int(over.sum()), bool))
            row, node, asks = (np.concatenate(x) for x in zip(stays, other))
        return tuple(np.concatenate(x) for x in zip(*done))


def forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Union the pairs ``(a, b)`` of positions into ``label``, whose entries lead to a smaller position or themselves."""
    while len(a):
        ra, rb = label[a], label[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def near_pairs(stored: np.ndarray, asking: np.ndarray | None, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Trees (as links of fingerprints) over the pairs within ``reach`` of stored points, or
    of asking and stored points."""
    own = asking is None
    asking = stored if own else asking
    points = stored if own else np.concatenate([stored, asking])
    if not len(stored) or not len(asking):
        return points[:0], points[:0]
    vantage = stored[0]
    ds, dq = distance(stored, vantage), distance(asking, vantage)
    so, qo = np.argsort(ds, kind="stable"), np.argsort(dq, kind="stable")
    s, ds, q, dq = stored[so], ds[so], asking[qo], dq[qo]
    label = np.arange(len(points))
    at, shift = 0, 0 if own else len(stored)
    while at < len(q):
        end = min(at + 128, len(q))
        lo = np.searchsorted(ds, dq[at] - reach)
        hi = np.searchsorted(ds, dq[end - 1] + reach, "right")
        i, j = np.nonzero(np.bitwise_count(q[at:end, None] ^ s[None, lo:hi]) <= reach)
        forest(qo[i + at] + shift, so[j + lo], label)
        at = end
    linked = np.nonzero(label != np.arange(len(points)))[0]
    return points[linked], points[label[linked]]


def near_links(points: DataFrame, reach: int, stages: Stages) -> DataFrame:
    """Links ``(a, b)`` that join exactly the points ``fp`` (distinct longs) within ``reach`` bits, directly or by others."""
    n = points.count()
    some = points.orderBy(F.xxhash64("fp")).limit(SAMPLE) if n > SAMPLE else points
    sample = np.array([r.fp for r in some.collect()], "i8").view("u8")       # bounded by SAMPLE
    depth = max(0, int(np.ceil(np.log2(max(1, n / SHARD)))))
    tree = points.sparkSession.sparkContext.broadcast(Tree(sample, depth))

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            row, shard, asks = tree.value.route(fp.view("u8"), reach)
            yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(shard, pa.int64()), pa.array(asks)],
                                             names=["fp", "shard", "asks"])

    dealt = stages.table(points.mapInArrow(deal, "fp long, shard long, asks boolean"), "dealt")
    # a full shard is worked off in blocks: a row a shard, no more than the sample has points
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK)).cast("int")
    full = dealt.groupBy("shard").agg(blocks(F.count_if(~F.col("asks"))).alias("homes"),
                                      blocks(F.count_if("asks") / 4).alias("askers"))
    rows = dealt.join(F.broadcast(full), "shard")
    home, other = F.pmod(F.xxhash64("fp"), "homes").cast("int"), F.pmod(F.xxhash64("fp"), "askers").cast("int")
    stored, asking = rows.where("not asks"), rows.where("asks")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias("x")
    cell = lambda ask, i, j, side: [F.lit(ask).alias("ask_cell"), i.cast("int").alias("i"), j.cast("int").alias("j"),
                                    side.cast("int").alias("side")]
    x, mine = F.col("x"), F.col("mine")
    within = stored.select("shard", "fp", "asks", home.alias("mine"), upto("homes")).select(
        "shard", "fp", "asks", *cell(False, F.least(mine, x), F.greatest(mine, x), mine > x))
    asked = stored.select("shard", "fp", "asks", home.alias("mine"), upto("askers")).select(
        "shard", "fp", "asks", *cell(True, mine, x, F.lit(0)))
    ask = asking.select("shard", "fp", "asks", other.alias("mine"), upto("homes")).select(
        "shard", "fp", "asks", *cell(True, x, mine, F.lit(0)))

    def link(key, part):
        fp = part.column("fp").to_numpy().view("u8")
        if part.column("ask_cell")[0].as_py():
            asks = part.column("asks").to_numpy()
            a, b = near_pairs(fp[~asks], fp[asks], reach)
        else:
            side = part.column("side").to_numpy()
            a, b = near_pairs(fp[side == 0], fp[side == 1] if side.any() else None, reach)
        return pa.table({"a": a.view("i8"), "b": b.view("i8")})

    key = ["shard", "ask_cell", "i", "j"]
    # by cells, not by bytes: a cell is few bytes and much work
    n_cells = full.agg(F.sum(F.col("homes") * (F.col("homes") + 1) / 2 + F.col("homes") * F.col("askers"))).first()[0] or 1
    cells = within.unionAll(asked).unionAll(ask).repartition(min(int(n_cells), MAX_TASKS), *key)
    return stages.table(cells.groupBy(*key).applyInArrow(link, "a long, b long"), "pairs")


def near_duplicates(df: DataFrame, shingle: int = 3, reach: int = 3, seed: int = 42, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row: fingerprints within ``reach`` bits
    link, and ``component_id`` is the smallest id that links lead to."""
    stages = Stages(df.sparkSession, "simhash")
    docs = stages.table(fingerprints(df, shingle, seed, id_col, text_col), "fingerprints")
    points = stages.table(docs.groupBy("fp").agg(F.min("id").alias("least")), "points")
    roots = components(near_links(points.select("fp"), reach, stages), stages)
    placed = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stages.table(placed.join(lowest, "root").select("fp", "component_id"), "classes")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return docs.join(classes, "fp").select(F.col("id").alias(id_col), shown, "component_id")


def keep_one(df: DataFrame, shingle: int = 3, reach: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``df``: the one with the least id, nulls last, of several texts with
    that id the one with the least hash, and of repeated rows the least as JSON. Rows are known by
    their id and the 64-bit hash of their text, so rows that share an id only are told apart."""
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    keyed = df.select(named(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"),
                      F.struct(*map(named, df.columns)).alias("row"))
    groups = near_duplicates(keyed, shingle, reach, id_col="key").select("key", F.col("component_id").alias("root")).distinct()
    rows = keyed.groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    named_first = F.struct(F.col("id").isNull().alias("nameless"), "id", "key")
    stays = rows.select("id", "key").join(groups, "key").groupBy("root").agg(F.min(named_first).alias("stays")) \
        .select(F.col("stays.id").alias("stays_id"), F.col("stays.key").alias("stays_key"))
    one = rows.join(stays, F.col("id").eqNullSafe(F.col("stays_id")) & (F.col("key") == F.col("stays_key")))
    return one.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
