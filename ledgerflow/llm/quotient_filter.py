"""Counting quotient filters over packed n-grams of word numbers.

An n-gram is ``size`` (two or more) numbers of ``width`` bits. Its packed bits are permuted by an
invertible function, which spreads them evenly; the first bits of the result are the
quotient, all others the remainder, so that nothing of the key is lost. A filter holds
its keys in order: the lengths of the quotients' runs as a string of bits (as many ones
as a run has keys, then a zero), the remainders in full, and a byte for each count with
longer counts aside. Filters of the same keys are merged in their sorted order.

Keys stand in memory as rows of 64-bit words, the first bit of the key first.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Rounds of the permutation; three bring every number into the first one of four.
ROUNDS = 3
HEAD = np.dtype([("n", "<u4"), ("bytes", "u1"), ("q", "u1"), ("span", "<u4"), ("first", "<u4"), ("long", "<u4")])


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> U(shift))) * U(factor)
    return x ^ (x >> U(33))


def permuted(grams: list[np.ndarray], width: int, back: bool = False) -> list[np.ndarray]:
    """Each number in turn is changed by a hash of the next one, which stays as it is; undone in reverse."""
    grams, mask, n = list(grams), U((1 << width) - 1), len(grams)
    turns = [(r, i) for r in range(ROUNDS) for i in range(n)]
    for r, i in reversed(turns) if back else turns:
        grams[i] = grams[i] ^ (mixed(grams[(i + 1) % n] + U(0x9E3779B97F4A7C15 * (r * n + i + 1) % 2**64)) & mask)
    return grams


def to_words(grams: list[np.ndarray], width: int) -> np.ndarray:
    """Numbers of each key, side by side, as 64-bit words."""
    out = np.zeros((len(grams[0]), -(-len(grams) * width // 64)), U)
    for i, x in enumerate(grams):
        word, bit = divmod(i * width, 64)
        room = 64 - bit
        if width <= room:
            out[:, word] |= x << U(room - width)
        else:
            out[:, word] |= x >> U(width - room)
            out[:, word + 1] |= x << U(64 - width + room)
    return out


def to_grams(words: np.ndarray, size: int, width: int) -> list[np.ndarray]:
    mask, out = U((1 << width) - 1), []
    for i in range(size):
        word, bit = divmod(i * width, 64)
        room = 64 - bit
        if width <= room:
            out.append(words[:, word] >> U(room - width) & mask)
        else:
            out.append((words[:, word] << U(width - room) | words[:, word + 1] >> U(64 - width + room)) & mask)
    return out


def keys(grams: list[np.ndarray], width: int) -> np.ndarray:
    return to_words(permuted(grams, width), width)


def grams(keys: np.ndarray, size: int, width: int) -> list[np.ndarray]:
    return permuted(to_grams(keys, size, width), width, back=True)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts (null: one each). Runs that are sorted are merged."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T[::-1])
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    if counts is None:
        return keys[new], np.diff(np.append(new, len(keys)))
    return keys[new], np.add.reduceat(counts[order], new)


def packed(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The filter of sorted distinct keys of so many bits."""
    n, size = len(keys), -(-bits // 8)
    q = max((x for x in (1, 2) if x < size and 1 << 8 * x <= 2 * n), default=0)       # bytes of the quotient
    raw = np.ascontiguousarray(keys.astype(">u8")).view("u1").reshape(n, -1)[:, :size]
    quotient = np.zeros(n, np.int64)
    for i in range(q):
        quotient = quotient << 8 | raw[:, i]
    first, span = int(quotient[0]), int(quotient[-1] - quotient[0]) + 1
    runs = np.ones(n + span, np.uint8)
    runs[np.cumsum(np.bincount(quotient - first, minlength=span)) + np.arange(span)] = 0
    much = counts >= 255
    head = np.array((n, size, q, span, first, int(much.sum())), HEAD)
    return b"".join([head.tobytes(), np.packbits(runs).tobytes(), raw[:, q:].tobytes(),
                     np.minimum(counts, 255).astype("u1").tobytes(), counts[much].astype("<i8").tobytes()])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a filter."""
    n, size, q, span, first, much = (int(x) for x in np.frombuffer(data, HEAD, 1)[0])
    at = HEAD.itemsize
    runs = np.unpackbits(np.frombuffer(data, "u1", -(-(n + span) // 8), at))[:n + span]
    at += -(-(n + span) // 8)
    raw = np.zeros((n, 8 * -(-size // 8)), "u1")
    raw[:, q:size] = np.frombuffer(data, "u1", n * (size - q), at).reshape(n, size - q)
    at += n * (size - q)
    quotient = first + (np.cumsum(runs == 0) - (runs == 0))[runs == 1]
    for i in range(q):
        raw[:, i] = quotient >> 8 * (q - 1 - i) & 255
    counts = np.frombuffer(data, "u1", n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", much, at + n)
    return raw.view(">u8").astype(U), counts


class Merger:
    """Merges filters as they come; sums up when much is waiting."""

    def __init__(self, room: int = 4_000_000):
        self.parts, self.waiting, self.room = [], 0, room

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > self.room:
            self.parts = [self.total()]
            self.waiting = 0
            self.room = max(self.room, 2 * len(self.parts[0][0]))

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))
