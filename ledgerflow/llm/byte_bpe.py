"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary's byte strings: it
resolves a pre-token that is a whole entry with two hashes and one comparison.
Tier two, for misses, merges the pre-token's bytes by rank over a heap and a
linked list. Decoding joins the entries' bytes by identifier.

Identifiers are kept packed, as little-endian unsigned 32-bit integers.
Null texts count as empty: no identifiers, decoded to no bytes. Every row gives
one row, repeated rows included; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, map_batches, read_vocabulary
from .merging import ID, Memory, merge, pair_table

#: Keys per bucket of the perfect hash, on average.
BUCKET = 4
#: Seeds that are tried at a time.
TRIES = 64
WORD = (1 << 64) - 1


def slot_of(h, seed, n: int):
    """Slot of a key's 64-bit hash under its bucket's seed; numbers or arrays of them."""
    if isinstance(h, int):
        x = (h ^ seed * 0x9E3779B97F4A7C15 & WORD) * 0xC4CEB9FE1A85EC53 & WORD
        return (x ^ x >> 32) % n
    x = (h ^ seed * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x ^ x >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash by hash and displace: each bucket of keys, largest
    first, gets the first seed that sends all its keys to free slots."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // BUCKET)
        self.base = next(b for b in range(100) if len({xxhash.xxh3_64_intdigest(k, b) for k in keys}) == n)
        hashes = np.array([xxhash.xxh3_64_intdigest(k, self.base) for k in keys], np.uint64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        seeds, slots = np.zeros(self.buckets, np.int64), np.full(n, -1, np.int64)     # slot -> position of its key
        for b in np.argsort(edges[:-1] - edges[1:], kind="stable"):
            own = order[edges[b]:edges[b + 1]]
            first = 1
            while len(own):
                at = slot_of(hashes[own], np.arange(first, first + TRIES, dtype=np.uint64)[:, None], n)
                fits = (slots[at] < 0).all(axis=1)
                for t in np.flatnonzero(fits):
                    if len(set(at[t].tolist())) == len(own):
                        seeds[b], slots[at[t]] = first + t, own
                        own = own[:0]
                        break
                first += TRIES
        self.seed, self.slot = seeds.tolist(), slots.tolist()

    def position(self, key: bytes) -> int:
        """Position of a key; any other byte string gets the position of some key."""
        h = xxhash.xxh3_64_intdigest(key, self.base)
        return self.slot[slot_of(h, self.seed[h % self.buckets], self.n)]


class ByteBpe:
    """Vocabulary of a rank file: byte strings and their identifiers, which are their ranks."""

    def __init__(self, data: bytes, pattern: str, whole: PerfectHash | None = None):
        pairs = [line.split() for line in data.splitlines() if line.strip()]
        self.keys = [base64.b64decode(a) for a, _ in pairs]
        self.ids = [int(b) for _, b in pairs]
        if max(self.ids, default=0) >= (1 << ID) - 1:
            raise ValueError(f"identifiers of more than {ID} bits are not supported")
        self.whole = whole or PerfectHash(self.keys)
        self.pairs = pair_table(list(zip(self.keys, self.ids, self.ids)))
        self.byte_id = {k[0]: i for k, i in zip(self.keys, self.ids) if len(k) == 1}
        self.packed = [i.to_bytes(4, "little") for i in self.ids]
        self.cut = regex.compile(pattern)
        self.known = Memory(lambda p: self.piece(p.encode()))
        # the entries' bytes side by side, by identifier
        size = np.zeros(max(self.ids, default=0) + 1, np.int64)
        size[self.ids] = [len(k) for k in self.keys]
        by_id = dict(zip(self.ids, self.keys))
        self.size, self.start = size, np.cumsum(size) - size
        self.blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(len(size))), np.uint8)

    def piece(self, raw: bytes) -> bytes:
        """Packed identifiers of one pre-token."""
        at = self.whole.position(raw)
        return self.packed[at] if self.keys[at] == raw else self.merged(raw)

    def merged(self, raw: bytes) -> bytes:
        """Merge the lowest-rank adjacent pair, the leftmost of equals, until none has a rank."""
        symbols = [self.byte_id[b] for b in raw]
        merge(symbols, self.pairs)
        return b"".join([s.to_bytes(4, "little") for s in symbols if s >= 0])

    def encode(self, text: str) -> bytes:
        """Packed identifiers of a text; a bounded number of pre-tokens is remembered."""
        return b"".join(map(self.known.__getitem__, self.cut.findall(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[ids] - ends + sizes, sizes)
        return self.blob[at + np.arange(n)].tobytes()


@lru_cache(maxsize=4)
def hashed(data: bytes) -> PerfectHash:
    """The perfect hash of a rank file, made once in the driver."""
    return PerfectHash([base64.b64decode(line.split()[0]) for line in data.splitlines() if line.strip()])


_vocabularies: dict[tuple[bytes, str], ByteBpe] = {}


def vocabulary(data: bytes, pattern: str, whole: PerfectHash) -> ByteBpe:
    """The vocabulary of a rank file; a Python worker keeps it, and what it remembers, from task to task."""
    if (data, pattern) not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[data, pattern] = ByteBpe(data, pattern, whole)
    return _vocabularies[data, pattern]


def _shared(spark: SparkSession, ranks: str) -> Broadcast:
    """The rank file, whose size is checked, and its perfect hash."""
    data = read_vocabulary(ranks)
    return spark.sparkContext.broadcast((data, hashed(data)))


def encode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """``(id, ids)`` of every row: the packed identifiers of the whole text; with ``decoded`` also
    the bytes that they stand for, decoded in the same pass."""
    shared = _shared(df.sparkSession, ranks)

    def setup():
        data, whole = shared.value
        vocab = vocabulary(data, pattern, whole)

        def each(batch):
            ids = [vocab.encode(t.as_py()) for t in batch.column(1)]
            out = {"id": batch.column(0), "ids": ids}
            return out | {"decoded": [vocab.decode(np.frombuffer(i, "<u4")) for i in ids]} if decoded else out

        return each

    names = ["id", "ids", "decoded"] if decoded else ["id", "ids"]
    out = map_batches(id_text(df, id_col, text_col), None, "id long, ids binary" + ", decoded binary" * decoded, names,
                      [pa.int64()] + [pa.binary()] * (len(names) - 1), setup)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, ids, decoded)``: the bytes that the packed identifiers stand for (null: none)."""
    shared = _shared(encoded.sparkSession, ranks)

    def setup():
        data, whole = shared.value
        vocab = vocabulary(data, pattern, whole)

        def each(batch):
            return {"id": batch.column(0), "ids": batch.column(1),
                    "decoded": [vocab.decode(np.frombuffer(b.as_py() or b"", "<u4")) for b in batch.column(1)]}

        return each

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    out = map_batches(rows, None, "id long, ids binary, decoded binary", ["id", "ids", "decoded"],
                      [pa.int64(), pa.binary(), pa.binary()], setup)
    return out.withColumnRenamed("id", id_col)


def packed_length(ids: str = "ids"):
    """Number of identifiers in a packed column."""
    return (F.octet_length(ids) / 4).cast("long")
