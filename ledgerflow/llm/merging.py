"""Byte-pair merging over a heap and a linked list, and a bounded memory of its results."""

from __future__ import annotations

import heapq

#: Bits of a symbol's identifier, and of a position.
ID, AT = 20, 32
NONE = (1 << ID) - 1                                      # a symbol that takes no part in merges


def pair_table(ranked: list[tuple[object, int, int]]) -> dict[int, int]:
    """From entries ``(string, rank, id)``: for each pair of entries whose strings joined
    are an entry, ``left id, right id`` -> ``rank, id`` of what they merge to."""
    ids = {s: i for s, _, i in ranked}
    table = {}
    for s, rank, i in ranked:
        for cut in range(1, len(s)):
            a, b = ids.get(s[:cut]), ids.get(s[cut:])
            if a is not None and b is not None:
                table[a << ID | b] = rank << ID | i
    return table


def merge(symbols: list[int], table: dict[int, int]) -> int:
    """Merge the lowest-rank adjacent pair, the leftmost of equals, until no pair has a rank.
    ``symbols`` is changed in place (a symbol that went into its left neighbour becomes -1);
    returns the number of merges."""
    n, get = len(symbols), table.get
    heap = [v << AT | i for i in range(n - 1) if (v := get(symbols[i] << ID | symbols[i + 1])) is not None]
    if not heap:
        return 0
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges, position, ident = 0, (1 << AT) - 1, (1 << ID) - 1
    while heap:
        top = pop(heap)
        i, v = top & position, top >> AT
        left, j = symbols[i], after[i]
        if left < 0 or j >= n or get(left << ID | symbols[j]) != v:
            continue                                      # one of the pair has been merged meanwhile
        symbols[i] = left = v & ident
        symbols[j] = -1
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (v := get(left << ID | symbols[k])) is not None:
                push(heap, v << AT | i)
        h = before[i]
        if h >= 0 and (v := get(symbols[h] << ID | left)) is not None:
            push(heap, v << AT | h)
    return merges


class Memory(dict):
    """Results by piece. The present generation takes new pieces; when it is full, the one
    before is forgotten. What is found in the one before moves up."""

    def __init__(self, compute, size: int = 500_000, longest: int = 100):
        super().__init__()
        self.compute, self.size, self.longest, self.before = compute, size, longest, {}

    def __missing__(self, piece):
        found = self.before.get(piece)
        if found is None:
            found = self.compute(piece)
            if len(piece) > self.longest:
                return found
        if len(self) >= self.size:
            self.before = dict(self)
            self.clear()
        self[piece] = found
        return found
