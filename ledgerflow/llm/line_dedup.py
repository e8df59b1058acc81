"""Fuzzy line deduplication across documents.

Lines (parts of a text between line feeds that have a word) are alike when the
sets of their character shingles have a Jaccard similarity of ``SIMILAR`` or
more. MinHash signatures of the shingles are cut into bands; lines that share a
band are candidates, candidates are checked by the exact similarity of their
shingle sets, and a distributed union-find joins the links that hold. Of each
component one line stays: the first by document id and line number.

Every candidate pair is checked, known to be in one component already, or proved
unlike: at first a band's lines are checked against its least line. Where that
leaves a band in several components, the pairs across them are checked: all of
them in a band of ``SMALL`` lines at most (so a line has few), in one of ``MIDDLE``
those that bitmaps of the shingle sets leave, in a larger one those that an exact
prefix filter leaves too: shingles are ordered by rarity, and of
two lines that are alike some shingle is among the first ninth of the smaller
line's and the first fifth of the larger one's, with enough shingles left behind
it in both. A pair meets at the first shingle it shares. So the pairs of a large
group of near copies that only share its usual shingles do not arise. A bitmap
of each shingle set (the parity of the shingles that fall on a bit) bounds how
much two sets have in common from above; pairs that it proves unlike are not
compared by their texts.

A band's members are found without sending every line of a band on: a batch of
texts keeps the members that meet in it, and sends one of each band on. Lines
that share no band and come once (most, in usual texts) take no part in what
follows: two bit tables of fixed size tell which lines may.

Null texts have no lines; texts of any length are processed whole. Rows that
share an id and a text count as one document, rows that share an id only as
several; rows without an id take part, after all others. An empty table gives
an empty table. Blank lines stay where they are. Extra columns, whatever their
names, are kept by ``without_lines`` and ignored otherwise.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Stages, named
from .components import components

SHINGLE = 5                          # characters
SIMILAR = 0.8
BANDS, ROWS = 18, 6                  # a pair at 0.8 shares a band with probability 0.996, at 0.3 with 0.013
BINS = BANDS * ROWS
EMPTY = np.uint32(0xFFFFFFFF)
BLANK = "\x20\t\n\v\f\r"             # what a word has none of
WIDE = re.compile("[^\0-\u0fff]")    # characters of more than twelve bits
NODE_SEED = 42                       # Spark's xxhash64 of a string has this seed
#: Characters whose shingles are hashed at a time; the arrays of a chunk fit a processor's cache.
CHUNK = 1 << 17
#: Lines of a band whose pairs are taken as they are.
SMALL = 32
#: Lines of a band whose bitmaps are compared by one worker, with a row a line; still larger bands go through the
#: prefix filter, which takes a row for each of a line's rarest shingles.
MIDDLE = 1024
#: Lines of a band that are compared with all others at a time.
ABREAST = 64
#: Entries of the table that tells how rare a shingle is (by hash; it only orders the shingles).
RARITY = 1 << 18
#: A row of the prefix filter carries the shingles before its own, up to this many; a pair that
#: first meets later meets more than once.
BEFORE = 64
#: Longs of the bitmap of a shingle set.
LONGS = 8
BITS = [f"b{i}" for i in range(LONGS)]
#: Rows of the prefix filter in an Arrow batch, about.
ROWS_OUT = 20_000
#: Bits of the table of lines that share a band or come more than once. Lines that it rules out
#: are alone for certain; those that it lets through are looked up exactly.
SEEN = 1 << 26
#: Rows of bands that are told to be shared in a batch already, held before repeats are dropped.
HELD = 1 << 20

MEMBER = ["key", "node", "low", "n"]
NO_ROWS = (np.empty(0, np.uint64), np.empty(0, np.uint64))
TOLD = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()),
                     T.StructField("kept_in", T.ArrayType(T.LongType()))])

_rnd = np.random.default_rng(20)
MULTIPLIERS = _rnd.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
# where an empty bin looks for a filled one: first at random, then round about
DETOURS = np.concatenate([_rnd.integers(0, BINS, (16, BINS)),
                          (np.arange(BINS)[None, :] + np.arange(1, BINS)[:, None]) % BINS])


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash, in place."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(33)
    return h


def signatures(lines: list[str]) -> np.ndarray:
    """One-permutation MinHash signatures (a row a line): a shingle's hash picks a bin and
    gives its value, a bin keeps its least value, an empty bin borrows one."""
    sig = np.full((len(lines), BINS), EMPTY, np.uint32)
    for at, end in chunks(lines):
        _least(lines[at:end], sig[at:end].reshape(-1))
    row, col = np.nonzero(sig == EMPTY)
    filled = sig != EMPTY
    for detour in DETOURS:
        if not len(row):
            break
        source = detour[col]
        found = filled[row, source]
        sig[row[found], col[found]] = sig[row[found], source[found]]
        row, col = row[~found], col[~found]
    return sig


def chunks(lines: list[str]):
    """Ranges of lines of about ``CHUNK`` characters; a longer line is one alone."""
    at = 0
    while at < len(lines):
        end, chars = at, 0
        while end < len(lines) and (end == at or chars + len(lines[end]) <= CHUNK):
            chars += len(lines[end]) + SHINGLE
            end += 1
        yield at, end
        at = end


def characters(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all lines, each line followed by ``SHINGLE - 1`` zeros (and zeros at the end); where lines
    start; and how many shingles each has. A short line is one shingle, padded."""
    pad = "\0" * (SHINGLE - 1)
    codes = np.frombuffer((pad.join(lines) + pad + pad).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.cumsum(sizes + SHINGLE - 1) - sizes - SHINGLE + 1
    return codes, starts, np.maximum(1, sizes - SHINGLE + 1)


def hashed(places: list[np.ndarray]) -> np.ndarray:
    """Hashes of shingles, from the arrays of their first to last characters."""
    h = places[0] * MULTIPLIERS[0]
    for k in range(1, SHINGLE):
        h += places[k] * MULTIPLIERS[k]
    return mixed(h)


def windows(codes: np.ndarray) -> list[np.ndarray]:
    """The first to last characters of the shingles at all places."""
    n = len(codes) - SHINGLE + 1
    return [codes[k:k + n] for k in range(SHINGLE)]


def between(starts: np.ndarray, shingles: np.ndarray, n: int) -> np.ndarray:
    """The places, of ``n``, where no line's shingle starts."""
    ends = np.append(starts[1:], n)
    gaps = ends - starts - shingles
    return np.arange(gaps.sum()) + np.repeat(ends - np.cumsum(gaps), gaps)


def _least(lines: list[str], sig: np.ndarray) -> None:
    codes, starts, shingles = characters(lines)
    h = hashed(windows(codes))
    h[between(starts, shingles, len(h))] = EMPTY         # less than nothing: changes no bin
    value = h.astype(np.uint32)
    h >>= np.uint64(32)
    h *= np.uint64(BINS)
    h >>= np.uint64(32)
    bins = h.view(np.int64)
    bins += np.repeat(np.arange(len(lines)) * BINS, np.diff(starts, append=len(h)))
    np.minimum.at(sig, bins, value)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = (key ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    key = mixed(key) & ~np.uint64(1)
    key[:, 0] |= np.uint64(1)                            # the last bit tells the first band
    return key


def shared(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sort by key and node, drop repeats; also tells which rows have a key with several nodes, and which came
    repeatedly."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    tied = np.zeros(len(keys), bool)
    tied[1:] = keys[1:] == keys[:-1]
    tied[:-1] |= tied[1:]
    tied = np.flatnonzero(tied)
    nodes[tied] = nodes[tied][np.lexsort((nodes[tied], keys[tied]))]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    again = np.diff(np.flatnonzero(np.append(new, True))) > 1
    keys, nodes = keys[new], nodes[new]
    same = keys[1:] == keys[:-1]
    several = np.zeros(len(keys), bool)
    several[1:] |= same
    several[:-1] |= same
    return keys, nodes, several, again


def lines_of(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip(BLANK)]


def node_hashes(lines: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x.encode(), NODE_SEED) for x in lines), np.uint64, len(lines))


def band_members(docs: DataFrame) -> DataFrame:
    """``(key, node, low, n)``: the lines (by content hash) of every band that several lines share, once each, with the
    band's least line and its number of lines. Rows without a key tell lines that share no band but come more than once."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sign(batches):
        for batch in batches:
            lines = Counter(x for t in batch.column(0).to_pylist() if t for x in lines_of(t))
            if not lines:
                continue
            often = np.fromiter(lines.values(), np.int64, len(lines)) > 1
            lines = list(lines)
            line_nodes, line_keys = node_hashes(lines), band_keys(signatures(lines))
            keys, nodes, several, _ = shared(line_keys.ravel(), np.repeat(line_nodes, BANDS))
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            yield packed(keys[first], nodes[first], width, False)
            if several.any():
                yield packed(keys[several], nodes[several], width, True)
            if often.any():
                order = np.argsort(line_keys[often, 0])
                yield packed(line_keys[often, 0][order], line_nodes[often][order], width, None)

    def meet(batches):
        rows = {False: [NO_ROWS], True: [NO_ROWS], None: [NO_ROWS]}
        n_met, room = 0, HELD
        for batch in batches:
            for met, k, n in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                rows[met].append((np.frombuffer(k.as_buffer(), np.uint64).copy(), np.frombuffer(n.as_buffer(), np.uint64).copy()))
                n_met += len(rows[met][-1][0]) if met else 0
                if n_met > room:
                    rows[True] = [shared(*concatenated(rows[True]))[:2]]
                    n_met = len(rows[True][0][0])
                    room = max(HELD, 2 * n_met)
        keys, nodes, several, again = shared(*concatenated(rows[False] + rows[True]))
        # a line of several batches that shares no band came from each of them with its first band
        alone = np.unique(np.concatenate([concatenated(rows[None])[1], nodes[again & ~several & (keys & np.uint64(1) > 0)]]))
        keys, nodes = keys[several], nodes[several]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        n = np.diff(starts, append=len(keys))
        low = np.minimum.reduceat(nodes.view("i8"), starts) if len(keys) else nodes.view("i8")
        yield from sliced([pa.array(keys.view("i8")), pa.array(nodes.view("i8")), pa.array(np.repeat(low, n)),
                           pa.array(np.repeat(n, n))], MEMBER)
        none = pa.nulls(len(alone), pa.int64())
        yield from sliced([none, pa.array(alone.view("i8")), none, none], MEMBER)

    signed = docs.select("text").mapInArrow(sign, "part int, met boolean, keys binary, nodes binary")
    return signed.repartition(width, "part").mapInArrow(meet, ", ".join(f"{c} long" for c in MEMBER))


def concatenated(rows: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*rows)]


def sliced(columns: list[pa.Array], names: list[str], rows: int = 100_000):
    batch = pa.RecordBatch.from_arrays(columns, names=names)
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def packed(keys: np.ndarray, nodes: np.ndarray, width: int, met: bool | None) -> pa.RecordBatch:
    """A row for each part of the keys' range that has keys, which are in order."""
    part = ((keys >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int32)
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    cut = lambda a: [a[i:j].tobytes() for i, j in zip(edges, edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), pa.array([met] * (len(edges) - 1), pa.bool_()),
                                       pa.array(cut(keys), pa.binary()), pa.array(cut(nodes), pa.binary())],
                                      names=["part", "met", "keys", "nodes"])


def shingle_set(line: str) -> set[str]:
    return {line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def shingle_codes(line: str) -> np.ndarray | None:
    """The shingle set as sorted numbers of twelve bits a character; None if a character has more."""
    codes = np.frombuffer((line + "\0" * (SHINGLE - len(line))).encode("utf-32-le", "surrogatepass"), "<u4")
    if codes.max() >= 1 << 12:
        return None
    codes = codes.astype(np.uint64)
    n = len(codes) - SHINGLE + 1
    packed = codes[:n].copy()
    for k in range(1, SHINGLE):
        packed = packed << np.uint64(12) | codes[k:k + n]
    packed.sort()
    return packed[np.concatenate([[True], packed[1:] != packed[:-1]])]


def shingle_codes_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_codes`` of lines whose characters have twelve bits, one after the other, and how many each line has."""
    codes, starts, shingles = characters(lines)
    places = windows(codes)
    packed = places[0].copy()
    for k in range(1, SHINGLE):
        packed <<= np.uint64(12)
        packed |= places[k]
    new = np.ones(len(packed), bool)
    for at, end in zip(starts.tolist(), (starts + shingles).tolist()):
        packed[at:end].sort()
    new[1:] = packed[1:] != packed[:-1]
    new[starts] = True
    new[between(starts, shingles, len(packed))] = False
    return packed[new], np.add.reduceat(new, starts, dtype=np.int64)


def plain(line: str) -> bool:
    """Whether all characters have twelve bits."""
    return line.isascii() or not WIDE.search(line)


def enough(both: int, a: int, b: int) -> bool:
    return both >= SIMILAR * (a + b - both)


class Comparer:
    """Exact similarity of pairs of lines; remembers a bounded amount of shingle sets."""

    def __init__(self, room: int = 4_000_000):
        self.known, self.room, self.used = {}, room, 0

    def codes(self, node: int, line: str) -> np.ndarray | None:
        if node not in self.known:
            if self.used > self.room:
                self.known, self.used = {}, 0
            self.known[node] = shingle_codes(line)
            self.used += len(line)
        return self.known[node]

    def learn(self, lines: dict[int, str]) -> None:
        """Take in the lines of some nodes at once."""
        if self.used > self.room:
            self.known, self.used = {}, 0
        new = [n for n, line in lines.items() if n not in self.known and plain(line)]
        for at, end in chunks([lines[n] for n in new]):
            codes, sizes = shingle_codes_of([lines[n] for n in new[at:end]])
            self.known.update(zip(new[at:end], np.split(codes, np.cumsum(sizes)[:-1])))
            self.used += len(codes)

    def similar(self, a: int, b: int, x: str, y: str) -> bool:
        p, q = self.codes(a, x), self.codes(b, y)
        if p is None or q is None:
            p, q = shingle_set(x), shingle_set(y)
            return enough(len(p & q), len(p), len(q))
        small, large = (p, q) if len(p) <= len(q) else (q, p)
        if len(small) < SIMILAR * len(large):
            return False
        both = np.concatenate([small, large])
        both.sort()
        return enough(int(np.count_nonzero(both[1:] == both[:-1])), len(p), len(q))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The parity, on each bit, of the shingles that fall on it, as longs."""
    falls = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % (64 * LONGS), minlength=64 * LONGS)
    return np.packbits((falls & 1).astype(np.uint8), bitorder="little").view("<i8")


def measured(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the lines' shingle sets, and their bitmaps (a row a line)."""
    sizes, maps = np.zeros(len(lines), np.int64), np.zeros((len(lines), LONGS), np.int64)
    usual = [i for i, line in enumerate(lines) if plain(line)]
    for at, end in chunks([lines[i] for i in usual]):
        some = usual[at:end]
        codes, n = shingle_codes_of([lines[i] for i in some])
        h = hashed([codes >> np.uint64(12 * k) & np.uint64((1 << 12) - 1) for k in reversed(range(SHINGLE))])
        falls = (h >> np.uint64(32)).astype(np.int64) % (64 * LONGS) + np.repeat(np.arange(len(some)) * (64 * LONGS), n)
        falls = np.bincount(falls, minlength=len(some) * 64 * LONGS)
        sizes[some] = n
        maps[some] = np.packbits((falls & 1).astype(np.uint8), bitorder="little").view("<i8").reshape(-1, LONGS)
    for i in set(range(len(lines))).difference(usual):
        sizes[i], maps[i] = len(shingle_set(lines[i])), bitmap(shingle_hashes(lines[i]))
    return sizes, maps


def maybe_alike(x: str, y: str, bits: str = "") -> str:
    """SQL that is true of ``(size, b0, ...)`` of lines ``x`` and ``y`` unless they are unlike for certain: each
    shingle in one line only changes one bit at most. ``bits`` names a struct that has the bitmap."""
    within = f"{bits}." if bits else ""
    apart = " + ".join(f"bit_count({x}.{within}{b} ^ {y}.{within}{b})" for b in BITS)
    return (f"least({x}.size, {y}.size) >= {SIMILAR}D * greatest({x}.size, {y}.size)"
            f" and {apart} <= {(1 - SIMILAR) / (1 + SIMILAR)}D * ({x}.size + {y}.size) + 1e-6D")


def with_sizes(texts: DataFrame) -> DataFrame:
    """``(node, line, size, b0, ...)``: size and bitmap of the shingle set."""
    def measure(batches):
        for batch in batches:
            sizes, maps = measured(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), *map(pa.array, np.ascontiguousarray(maps.T))],
                                             names=["node", "line", "size", *BITS])

    return texts.select("node", "line").mapInArrow(measure, "node long, line string, size long, "
                                                   + ", ".join(f"{b} long" for b in BITS))


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose lines are alike."""
    sized = texts.select("node", "size", *BITS)
    likely = (pairs.join(sized.select(F.col("node").alias("a"), F.struct("size", *BITS).alias("x")), "a")
              .join(sized.select(F.col("node").alias("b"), F.struct("size", *BITS).alias("y")), "b")
              .where(maybe_alike("x", "y")).select("a", "b"))
    one = texts.select(F.col("node").alias("a"), F.col("line").alias("line_a"))
    other = texts.select(F.col("node").alias("b"), F.col("line").alias("line_b"))
    rows = likely.join(one, "a").join(other, "b").select("a", "b", "line_a", "line_b")

    def check(batches):
        comparer = Comparer()
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 500):
                rows = list(zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)))
                if sum(len(x) + len(y) for _, _, x, y in rows) <= 8 * CHUNK:      # else one by one
                    comparer.learn({n: line for a, b, x, y in rows for n, line in ((a, x), (b, y))})
                out += [(a, b) for a, b, x, y in rows if comparer.similar(a, b, x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()),
                                              pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def shingle_hashes(line: str) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    codes = np.frombuffer((line + "\0" * (SHINGLE - len(line))).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return np.unique(hashed(windows(codes)))


def rarity(lines: DataFrame) -> np.ndarray:
    """How often the shingles of each entry of the table occur in ``lines(line)``."""
    def count(batches):
        table = np.zeros(RARITY, np.int64)
        for batch in batches:
            for line in batch.column(0).to_pylist():
                np.add.at(table, (shingle_hashes(line) % np.uint64(RARITY)).astype(np.int64), 1)
        entry = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(table[entry])], names=["entry", "n"])

    rows = lines.select("line").mapInArrow(count, "entry long, n long").groupBy("entry").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(RARITY, np.int64)                    # bounded by RARITY
    table[rows.column("entry").to_numpy()] = rows.column("n").to_numpy()
    return table


def least_shared(size: int, share: float) -> int:
    return int(np.ceil(size * share - 1e-6))


PREFIX = ("token long, node long, root long, size long, at long, own boolean, before array<long>, bands array<long>, "
          + ", ".join(f"{b} long" for b in BITS))


@lru_cache(256)
def earlier(lo: int, hi: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """How many places before each of ``lo..hi`` are told (all, or none from ``room`` on), and which."""
    sizes = np.arange(lo, hi)
    sizes[sizes >= room] = 0
    return sizes, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def prefixes(lines: DataFrame, rare) -> DataFrame:
    """A row for each of a line's rarest shingles, as many as a line that is alike must share one of."""
    def longs(parts):
        return pa.array(np.concatenate(parts).view("i8"))

    def lists(sizes, values):
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), longs(values))

    def emit(rows):
        tokens, node, root, size, at, own, told, before, bands, bits = zip(*rows)
        n = [len(x) for x in tokens]
        fill = lambda a: pa.array(np.repeat(np.array(a, np.int64), n))
        return pa.RecordBatch.from_arrays(
            [longs(tokens), fill(node), fill(root), fill(size), pa.array(np.concatenate(at)), pa.array(np.concatenate(own)),
             lists(told, before), lists([np.full(k, len(x)) for k, x in zip(n, bands)],
                                        [np.tile(x, k) for k, x in zip(n, bands)]), *map(fill, zip(*bits))],
            names=["token", "node", "root", "size", "at", "own", "before", "bands", *BITS])

    def spread(batches):
        rows, n_rows = [], 0
        for batch in batches:
            for node, line, root, size, bands, *bits in zip(*(c.to_pylist() for c in batch.columns)):
                h = shingle_hashes(line)
                h = h[np.lexsort((h, rare.value[(h % np.uint64(RARITY)).astype(np.int64)]))]
                h = h[:size - least_shared(size, SIMILAR) + 1]
                first = size - least_shared(size, 2 * SIMILAR / (1 + SIMILAR)) + 1
                for lo in range(0, len(h), ROWS_OUT):
                    hi = min(lo + ROWS_OUT, len(h))
                    at, (told, places) = np.arange(lo, hi), earlier(lo, hi, BEFORE)
                    rows.append((h[lo:hi], node, root, size, at, at < first, told, h[places],
                                 np.array(bands, np.int64), bits))
                    n_rows += hi - lo
                    if n_rows >= ROWS_OUT:
                        yield emit(rows)
                        rows, n_rows = [], 0
        if rows:
            yield emit(rows)

    return lines.select("node", "line", "root", "size", "bands", *BITS).mapInArrow(spread, PREFIX)


def maybe_pairs(nodes: np.ndarray, roots: np.ndarray, sizes: np.ndarray, maps: np.ndarray):
    """Pairs ``a, b`` of nodes with different roots that ``maybe_alike`` doesn't rule out, ``ABREAST`` lines at a time."""
    order = np.argsort(sizes, kind="stable")
    nodes, roots, sizes, maps = nodes[order], roots[order], sizes[order], maps[order].view(np.uint64)
    for at in range(0, len(nodes), ABREAST):
        end = min(at + ABREAST, len(nodes))
        last = np.searchsorted(SIMILAR * sizes, sizes[end - 1], side="right")      # larger lines are too large for all of these
        some, rest = slice(at, end), slice(at, last)
        apart = np.zeros((end - at, last - at), np.uint16)
        for x, y in zip(maps[some].T, maps[rest].T):
            apart += np.bitwise_count(x[:, None] ^ y[None, :])
        both = sizes[some, None] + sizes[None, rest]
        i, j = np.nonzero((roots[some, None] != roots[None, rest]) & (sizes[some, None] >= SIMILAR * sizes[None, rest])
                          & (apart <= (1 - SIMILAR) / (1 + SIMILAR) * both + 1e-6) & (np.arange(end - at)[:, None] < np.arange(last - at)))
        if len(i):
            x, y = nodes[at + i], nodes[at + j]
            yield np.minimum(x, y), np.maximum(x, y)


def pairs_by_bitmaps(rows: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` within the bands of ``rows(key, node, root, size, b0, ...)``."""
    def compare(band: pa.Table) -> pa.Table:
        node, root, size, *bits = (band.column(c).to_numpy() for c in ("node", "root", "size", *BITS))
        found = list(maybe_pairs(node, root, size, np.stack(bits, axis=1)))
        a, b = concatenated(found) if found else (node[:0], node[:0])
        return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.groupBy("key").applyInArrow(compare, "a long, b long")


def pairs_across(placed: DataFrame, texts: DataFrame, stages: Stages) -> DataFrame:
    """Pairs ``(a, b)`` of lines that share a band, lie in different components and may be alike."""
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")) \
        .where("low != high")
    apart = stages.table(placed.join(split.select("key", "n"), "key"), "apart")
    # sets that are alike differ in size by the similarity at most
    few = apart.where(F.col("n") <= SMALL).drop("n")
    in_full = few.alias("x").join(few.alias("y"), F.expr(
        f"x.key = y.key and x.root < y.root and least(x.size, y.size) >= {SIMILAR}D * greatest(x.size, y.size)"))
    sized = texts.select("node", *BITS)
    by_bitmaps = pairs_by_bitmaps(apart.where((F.col("n") > SMALL) & (F.col("n") <= MIDDLE)).drop("n").join(sized, "node"))
    nodes = apart.where(F.col("n") > max(SMALL, MIDDLE)).groupBy("node").agg(
        F.min("root").alias("root"), F.min("size").alias("size"), F.collect_set("key").alias("bands"))
    lines = stages.table(texts.select("node", "line", *BITS).join(nodes, "node"), "split")
    rare = placed.sparkSession.sparkContext.broadcast(rarity(lines))          # RARITY numbers
    # a line makes many rows of a prefix: lines are dealt evenly, not by the bytes of their file
    width = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # most rows that meet lie in one component already; what only the others need is a struct, not read for those
    rows = stages.table(prefixes(lines.repartition(width, "node"), rare), "prefixes") \
        .select("token", "node", "root", "size", "at", "own", F.struct("before", "bands", *BITS).alias("rest"))
    # x is the smaller line; no more shingles are shared than stand behind the first one shared
    met = rows.where("own").alias("x").join(rows.alias("y"), F.expr(
        f"""x.token = y.token and x.root != y.root and (x.size < y.size or (x.size = y.size and x.node < y.node))
        and least(x.size - x.at, y.size - y.at) >= {SIMILAR / (1 + SIMILAR)}D * (x.size + y.size) - 1e-6D
        and {maybe_alike("x", "y", "rest")}
        and arrays_overlap(x.rest.bands, y.rest.bands) and not arrays_overlap(x.rest.before, y.rest.before)"""))
    pair = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]
    pairs = stages.table(in_full.select(*pair).unionAll(by_bitmaps).unionAll(met.select(*pair)).distinct(), "pairs")
    stages.drop("prefixes", "split", "apart")
    return pairs


def seen_bits(members: DataFrame) -> np.ndarray:
    """Two tables of ``SEEN`` bits, as words: of all nodes of ``members(key, node)``, and of those that have a key."""
    bit = "shiftleft(1L, cast(shiftrightunsigned(node, 48) & 63 as int))"
    rows = members.groupBy(F.expr(f"node & {SEEN // 64 - 1}").alias("word")).agg(
        F.expr(f"bit_or({bit})").alias("all"), F.expr(f"bit_or(if(key is null, 0L, {bit}))").alias("sharing")).toArrow()
    tables = np.zeros((2, SEEN // 64), np.uint64)           # bounded by SEEN
    for table, name in zip(tables, ("all", "sharing")):
        table[rows.column("word").to_numpy()] = rows.column(name).to_numpy().view(np.uint64)
    return tables


def is_seen(nodes: np.ndarray, table: np.ndarray) -> np.ndarray:
    bits = table[(nodes & np.uint64(len(table) - 1)).astype(np.int64)]
    return (bits >> (nodes >> np.uint64(48) & np.uint64(63)) & np.uint64(1)).astype(bool)


def line_places(docs: DataFrame, seen) -> DataFrame:
    """``(doc, text_key, no, h, check, line)`` of the lines of ``docs(doc, text)`` that may share a band or come repeatedly.
    The text of a line is told if it may share a band, and once a batch."""
    def find(batches):
        for batch in batches:
            lines, row, no = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for k, line in enumerate(text.split("\n")):
                    if line.strip(BLANK):
                        lines.append(line)
                        row.append(i)
                        no.append(k)
            h = node_hashes(lines)
            at = np.flatnonzero(is_seen(h, seen.value[0]))
            once = np.zeros(len(at), bool)
            once[np.unique(h[at], return_index=True)[1]] = True
            once &= is_seen(h[at], seen.value[1])
            some = [lines[i] for i in at.tolist()]
            check = np.fromiter((xxhash.xxh64_intdigest(x.encode(), NODE_SEED + 1) for x in some), np.uint64, len(some))
            row = pa.array(np.array(row, np.int64)[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.array(no, np.int32)[at]), pa.array(h[at].view("i8")),
                 pa.array(check.view("i8")), pa.array([x if told else None for x, told in zip(some, once.tolist())], pa.string())], names=["doc", "text_key", "no", "h", "check", "line"])

    return docs.select("doc", F.xxhash64("text").alias("text_key"), "text") \
        .mapInArrow(find, "doc long, text_key long, no int, h long, check long, line string")


def line_links(members: DataFrame, places: DataFrame, stages: Stages) -> DataFrame:
    """``(node, root)`` of the lines that belong to a component of several."""
    members = members.where("key is not null")
    nodes = members.select("node").distinct()
    texts = stages.table(with_sizes(places.where("line is not null").select(F.col("h").alias("node"), "line").join(nodes, "node")
                                    .dropDuplicates(["node"])), "texts")
    stars = members.where("node != low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    links = stages.table(checked(stars, texts), "stars")
    roots = components(links, stages, "first")
    # bands in several components: pairs across them; those with a band's least line are checked already
    placed = members.where("n > 2 and node != low").join(texts.select("node", "size"), "node").join(roots, "node", "left") \
        .select("key", "node", F.coalesce("root", "node").alias("root"), "size")
    placed = stages.table(placed, "placed")
    more = stages.table(checked(pairs_across(placed, texts, stages), texts), "across")
    stages.drop("texts", "pairs")
    if more.isEmpty():
        return roots
    # the links found across components join whole components: only their roots take part
    of = placed.select(F.col("node").alias("a"), F.col("root").alias("x")).distinct()
    joins = more.join(of, "a").join(of.select(F.col("a").alias("b"), F.col("x").alias("y")), "b")
    merged = components(joins.select(F.col("x").alias("a"), F.col("y").alias("b")), stages, "second")
    moved = merged.select(F.col("node").alias("root"), F.col("root").alias("new"))
    return (roots.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
            .unionAll(merged))


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, text_key, line, kept_doc, kept_line)`` of every line that goes, and of the line that stays
    for it. A document is an id and a text, known by the text's 64-bit hash; a null id comes last."""
    stages = Stages(df.sparkSession, "lines")
    docs = df.select(named(id_col).cast("long").alias("doc"), named(text_col).cast("string").alias("text")).where("text is not null")
    members = stages.table(band_members(docs), "members")
    # a line that shares no band and comes once is no copy and has none
    seen = df.sparkSession.sparkContext.broadcast(seen_bits(members))         # twice SEEN bits
    places = stages.table(line_places(docs, seen), "places")
    links = line_links(members, places, stages)
    stages.drop("members")
    # equal lines: those of one 64-bit hash whose second hash is the first line's too
    place = F.struct(F.col("doc").isNull().alias("nameless"), "doc", "text_key", "no", "check")
    classes = places.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    linked = links.select(F.col("node").alias("h"), "root").unionAll(
        links.select(F.col("root").alias("h"), "root").distinct())
    classes = classes.join(linked, "h", "left").where("n > 1 or root is not null") \
        .select("h", "first", F.coalesce("root", "h").alias("root"))
    classes = stages.table(classes, "line_classes")
    stays = classes.groupBy("root").agg(F.min("first").alias("stays"))
    told = classes.join(stays, "root").select("h", F.col("first.check").alias("check"), F.col("stays.doc").alias("kept_doc"),
                                              F.col("stays.text_key").alias("kept_key"), F.col("stays.no").alias("kept_line"))
    same = F.col("doc").eqNullSafe(F.col("kept_doc")) & (F.col("text_key") == F.col("kept_key")) & (F.col("no") == F.col("kept_line"))
    removed = places.join(told, ["h", "check"]).where(~same) \
        .select("doc", "text_key", F.col("no").alias("line"), "kept_doc", "kept_line")
    removed = stages.table(removed, "removed")              # texts are shuffled when all else is gone
    stages.keep("removed")
    return removed


def without_lines(df: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  told: str | None = None) -> DataFrame:
    """``df`` with the removed lines taken out of its texts. ``told`` names a column to add:
    struct of the lines with a word before, the lines taken out, and the documents that keep them."""
    # by place, whatever names the columns have
    places = [f"c{i}" for i in range(len(df.columns))]
    text_at = df.columns.index(text_col)
    plain = df.select(*[named(c).alias(p) for c, p in zip(df.columns, places)])
    doc, text = plain[places[df.columns.index(id_col)]].cast("long"), plain[places[text_at]].cast("string")
    gone = removed.groupBy("doc", "text_key").agg(
        F.collect_set("line").alias("gone"), F.sort_array(F.collect_set("kept_doc")).alias("kept_in"))
    joined = plain.join(gone.hint("shuffle_hash"), doc.eqNullSafe(gone["doc"]) & (F.xxhash64(text) == gone["text_key"]), "left") \
        .select(*places, "gone", F.coalesce("kept_in", F.array().cast("array<long>")).alias("kept_in"))
    schema = plain.schema
    if told:
        schema = T.StructType([*schema, T.StructField("told", TOLD)])
    told_type = pa.struct([("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_in", pa.list_(pa.int64()))])

    def rebuild(batches):
        for batch in batches:
            texts, n_lines, n_removed = batch.column(text_at).to_pylist(), [], []
            for i, gone in enumerate(batch.column(batch.num_columns - 2).to_pylist()):
                if told:
                    n_lines.append(len(lines_of(texts[i] or "")))
                    n_removed.append(len(gone or ()))
                if gone:
                    gone = set(gone)
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone)
            about = told and pa.StructArray.from_arrays(
                [pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), batch.column(batch.num_columns - 1).cast(told_type[2].type)],
                fields=list(told_type))
            columns = batch.columns[:-2]
            columns[text_at] = pa.array(texts, pa.string())
            names = batch.schema.names[:-2]
            if told:
                columns, names = columns + [about], names + ["told"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(rebuild, schema).toDF(*df.columns, *([told] if told else []))
