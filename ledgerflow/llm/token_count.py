"""Token counts by byte-pair merging over a heap and a linked list.

A text is cut where no merge can reach across; each piece starts as its
symbols and the lowest-rank adjacent pair is merged until none is left. The
count is the number of initial symbols less the merges; no identifiers are
made. Vocabularies: sentencepiece BPE models with byte fallback (``.model``)
and rank files (``.tiktoken``).

Null texts count as empty and give 0 tokens. Every row gives one row, repeated
rows included; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_file, id_text, map_batches

#: Distinct pieces whose counts a task remembers; it starts afresh beyond.
MEMO = 200_000


def merged_count(symbols: list, ranks: dict) -> int:
    """Symbols left when the lowest-rank adjacent pair has been merged until no pair has a rank."""
    n = len(symbols)
    if n < 2:
        return n
    parts: list = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    heap = []
    for i in range(n - 1):
        joined = parts[i] + parts[i + 1]
        rank = get(joined)
        if rank is not None:
            heap.append((rank, i, joined))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, joined = heapq.heappop(heap)
        left = parts[i]
        j = after[i]
        if left is None or j >= n or len(left) >= len(joined) or left + parts[j] != joined:
            continue                                      # one of the pair has been merged meanwhile
        parts[i], parts[j] = joined, None
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            longer = joined + parts[k]
            if (rank := get(longer)) is not None:
                heapq.heappush(heap, (rank, i, longer))
        h = before[i]
        if h >= 0:
            longer = parts[h] + joined
            if (rank := get(longer)) is not None:
                heapq.heappush(heap, (rank, h, longer))
    return n - merges


class SentencePieces:
    """Counts tokens as a sentencepiece BPE model with byte fallback does."""

    def __init__(self, model: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(m.get_piece_size())
        self.ranks = {m.id_to_piece(i): -m.get_score(i) for i in ids
                      if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        if sum(m.is_byte(i) for i in ids) != 256:
            raise ValueError("only models with byte fallback are supported")
        if any("▁" in p.lstrip("▁") for p in self.ranks):
            raise ValueError("only models whose pieces keep to one word are supported")
        self.known = {c for p in self.ranks for c in p}
        if not self.known <= self.ranks.keys():
            raise ValueError("only models whose letters are pieces are supported")
        # a letter outside all pieces is a place to cut; of these, the line feed is the common one
        self.cut = re.compile("▁+[^▁\n]*|\n|[^▁\n]+" if "\n" not in self.known else "▁+[^▁]*|[^▁]+")

    def pieces(self, text: str) -> list[str]:
        return self.cut.findall("▁" + text.replace(" ", "▁")) if text else []

    def count(self, piece: str) -> int:
        """Letters outside the vocabulary stand as their bytes and end a run of merges."""
        total, run = 0, []
        for c in piece:
            if c in self.known:
                run.append(c)
            else:
                total += merged_count(run, self.ranks) + len(c.encode())
                run = []
        return total + merged_count(run, self.ranks)


class RankedBytes:
    """Counts tokens as a byte-level rank file does."""

    def __init__(self, data: bytes):
        import public_tokenizers
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.cut = regex.compile(public_tokenizers.PATTERN)

    def pieces(self, text: str) -> list[str]:
        return self.cut.findall(text)

    def count(self, piece: str) -> int:
        raw = piece.encode()
        return 1 if raw in self.ranks else merged_count([raw[i:i + 1] for i in range(len(raw))], self.ranks)


KINDS = {"model": SentencePieces, "tiktoken": RankedBytes}


@lru_cache(maxsize=4)
def counter(kind: str, data: bytes):
    return KINDS[kind](data)


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of every row: bytes of the UTF-8 text and tokens of
    the whole text, without begin, end or special tokens."""
    kind = vocabulary.rpartition(".")[2]
    if kind not in KINDS:
        raise ValueError(f"vocabulary must be one of {sorted(KINDS)}")
    file = broadcast_file(df.sparkSession, vocabulary)

    def setup():
        vocab = counter(kind, file.value)
        memo: dict[str, int] = {}

        def count(batch):
            n = []
            for text in batch.column(1):
                total = 0
                for piece in vocab.pieces(text.as_py()):
                    c = memo.get(piece)
                    if c is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        c = vocab.count(piece)
                        if len(piece) < 100:
                            memo[piece] = c
                    total += c
                n.append(total)
            return {"id": batch.column(0), "n_bytes": batch.column(2), "n_tokens": n}

        return count

    rows = id_text(df, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = map_batches(rows, None, "id long, n_bytes long, n_tokens long", ["id", "n_bytes", "n_tokens"],
                      [pa.int64()] * 3, setup)
    return out.withColumnRenamed("id", id_col)
