"""Secret scans: fixed patterns, and two character Markov models.

The patterns find assigned values, access keys and long hexadecimal runs. Two
models of character pairs, one of random strings and one of ordinary
identifiers, then judge every other run of identifier characters by its
log-likelihood ratio. They are trained from labelled samples: values that are
known to be random, and identifiers that are not. ``learn_from_text`` takes the
labels from the patterns: what they find is random, every other run of the
corpus is ordinary; pair counts cover all texts, are summed up in the tasks, and
only their table (at most :data:`STATES` squared a class) reaches the driver.

Offsets are code points, ends exclusive. Null texts count as empty and have no
spans; every row gives a row, repeated rows included; an empty table gives an
empty table, and models without samples find nothing. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, named

# The words before an assigned value, and the least sizes.
WORDS = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN_VALUE, ACCESS_SIZE, HEX_SIZE = 6, 20, 24
KINDS = ["assign", "access", "hex", "random"]


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join(map(either_case, WORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rf"[0-9a-f]{{{HEX_SIZE},}}")             # the runs of [0-9a-f]+ that are long enough
HINTS = ("passw", "secret", "token", "api")               # every assignment has one of these, in some case

#: Characters of the models; every other one is an edge.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
CODE = np.zeros(256, np.uint8)
CODE[list(ALPHABET.encode())] = np.arange(1, STATES)
#: A run is judged from this size on.
RUN_SIZE = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{RUN_SIZE},}}")
#: Characters that join a pattern's match to the rest of its run.
SEPARATORS = "/+=_-"
#: Characters a random run has at least; rulers and fillers have fewer.
DISTINCT = 6
#: Natural log of how much likelier a run must be as a random string (odds of one in e^-14 among runs).
LEAST_RATIO = 14.0
#: Part of the random model that is uniform, so that alphabets which the samples lack count too.
UNIFORM = 0.5

SPANS = "array<struct<kind:string,start:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def pattern_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, end, kind, value start)`` of the patterns' matches, leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(text)
                if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_SIZE]
    out += [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def pairs(raw: bytes) -> np.ndarray:
    """How often each pair of states follows one another in UTF-8 bytes, edges included."""
    codes = CODE[np.frombuffer(b" " + raw + b" ", np.uint8)].astype(np.int32)
    return np.bincount(codes[:-1] * STATES + codes[1:], minlength=STATES * STATES)


@dataclass(frozen=True)
class Models:
    """``ratio[a, b]``: log-likelihood ratio, random to ordinary, of state b after state a."""

    ratio: np.ndarray

    @staticmethod
    def fit(random: np.ndarray, ordinary: np.ndarray) -> Models:
        """From the pair counts of either class."""
        def chances(counts: np.ndarray, least: float) -> np.ndarray:
            counts = counts.reshape(STATES, STATES).astype(float) + least
            return counts / counts.sum(1, keepdims=True)

        if not random.sum() or not ordinary[1:].sum():
            return Models(np.full((STATES, STATES), -1e3))
        mixed = UNIFORM / STATES + (1 - UNIFORM) * chances(random, 1 / STATES)
        return Models(np.log(mixed) - np.log(chances(ordinary, 1 / STATES)))

    def score(self, run: str) -> float:
        codes = CODE[np.frombuffer(b" " + run.encode() + b" ", np.uint8)]
        return float(self.ratio[codes[:-1], codes[1:]].sum())

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """All spans of a text: the patterns', and runs, or what the patterns leave of them, that the models call random."""
        found = pattern_spans(text)
        out = [(a, b, kind) for a, b, kind, _ in found]
        for m in RUN.finditer(text):
            for start, end in pieces(text, m.start(), m.end(), found):
                piece = text[start:end]
                if len(piece) >= RUN_SIZE and len(set(piece)) >= DISTINCT and self.score(piece) >= LEAST_RATIO:
                    out.append((start, end, 3))
        return sorted(out, key=lambda s: (s[0], s[2]))


def pieces(text: str, start: int, end: int, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a run outside the patterns' matches, without the separators next to a match."""
    out, at, cut = [], start, False
    for a, b, _, _ in found:
        if b <= start or a >= end:
            continue
        if a > at:
            out.append((at, a, cut, True))
        at, cut = max(at, b), True
    if at < end:
        out.append((at, end, cut, False))
    trimmed = []
    for a, b, left, right in out:
        while left and a < b and text[a] in SEPARATORS:
            a += 1
        while right and a < b and text[b - 1] in SEPARATORS:
            b -= 1
        trimmed.append((a, b))
    return trimmed


def summed(counts: DataFrame) -> Models:
    """Models from rows ``(random, pair, n)``."""
    both = np.zeros((2, STATES * STATES), np.int64)
    for r in counts.groupBy("random", "pair").agg(F.sum("n").alias("n")).collect():     # at most 2 * STATES squared
        both[int(r["random"]), r["pair"]] = r["n"]
    return Models.fit(both[1], both[0])


def counted(df: DataFrame, count) -> DataFrame:
    """``(random, pair, n)`` of each batch, where ``count(batch)`` gives the counts of either class."""
    def run(batches):
        for batch in batches:
            both = np.stack(count(batch))
            kind, pair = np.nonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array(kind == 1), pa.array(pair, pa.int64()),
                                              pa.array(both[kind, pair], pa.int64())], names=["random", "pair", "n"])

    return df.mapInArrow(run, "random boolean, pair long, n long")


def learn(samples: DataFrame, value_col: str = "value", random_col: str = "random") -> Models:
    """Train from labelled samples; rows without a value or a label don't count."""
    rows = samples.select(named(value_col).cast("string").alias("value"), named(random_col).cast("boolean").alias("random")) \
        .where("value is not null and random is not null")

    def count(batch):
        values, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        return [pairs(" ".join(v for v, m in zip(values, marks) if m == kind).encode()) for kind in (False, True)]

    return summed(counted(rows, count))


def learn_from_text(df: DataFrame, text_col: str = "text") -> Models:
    """Train from all texts, labelled by the patterns."""
    rows = df.select(F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))

    def count(batch):
        ordinary, values = np.zeros(STATES * STATES, np.int64), []
        for text in batch.column(0):
            text = text.as_py()
            found = pattern_spans(text)
            if found:
                values += [text[v:b] for _, b, _, v in found]
                kept, at = [], 0
                for a, b, _, _ in found:
                    kept.append(text[at:max(a, at)])
                    at = max(at, b)
                text = " ".join(kept + [text[at:]])
            ordinary += pairs(text.encode())
        return [ordinary, pairs(" ".join(values).encode())]

    return summed(counted(rows, count))


def scan(df: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)`` of every row, by start and then by kind as in :data:`KINDS`."""
    def run(batches):
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in models.spans(t.as_py())]
                     for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPAN_TYPE)], names=["id", "spans"])

    return id_text(df, id_col, text_col).mapInArrow(run, f"id long, spans {SPANS}").withColumnRenamed("id", id_col)


def joined(spans):
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(*kinds: str):
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))
