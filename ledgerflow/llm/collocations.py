"""Phrases of two to four words that occur more often than their parts suggest.

Words get numbers by hashing, of as many bits as keep every frequent word's number
its own among all words (checked over the whole table of words, and hashed anew if
not). N-grams of frequent words are counted in counting quotient filters: a task packs
what it counts into a filter for each shard of the permuted keys, and the shards'
filters are merged in sorted order. Counts are exact.

A longer phrase can only be frequent if its parts are, so tasks leave out what a bit
table of fixed size (``FILTER_BITS``) tells to be rare: words before pairs are counted,
pairs before longer phrases. The table errs on one side only, so nothing frequent is
lost at any size.

Texts are processed whole, a null text is empty, a null language counts as ``und``.
Repeated rows count as often as they stand. Phrases never reach across a break or from
text to text. Ids and other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quotient_filter as Q
from .common import Stages, named

#: Characters that end a piece; blank and tab part words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t" + BREAKS, bytes(range(97, 123)) + b" " + b"." * len(BREAKS))
GAP = re.compile(rb"[ .]")
#: Bytes of text that are cut into words at a time, distinct words that a task remembers,
#: n-grams that it gathers before it packs them.
CHUNK, MEMO, GATHER = 1 << 22, 500_000, 2_000_000
#: Bits of the table that tells frequent words, or pairs, from others.
FILTER_BITS = 26
#: Word occurrences a shard, for inputs beyond the session's shuffle partitions times this.
SHARD = 1 << 26
#: Widths of word numbers to try, in bits, and seeds for the last one.
WIDTHS = [(48, "0"), (56, "0"), (64, "0"), (64, "1"), (64, "2"), (64, "3")]
LONGEST = 4


def words_of(text: bytes):
    """Lists of the words of a text, with ``.`` for each break; a word is never cut."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        end = GAP.search(text, at + CHUNK)
        end = end.start() if end else len(text)
        yield text[at:end].replace(b".", b" . ").split()
        at = end


def by_row(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(named(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(named(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """``(lang, word, f)``."""
    def count(batches):
        seen: dict[str, Counter] = {}

        def told():
            for lang, words in seen.items():
                words.pop(b".", None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()).cast(pa.string()),
                                                  pa.array(list(words.values()), pa.int64())], names=["lang", "word", "f"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = seen.setdefault(lang, Counter())
                for some in words_of(text.as_py()):
                    words.update(some)
            if sum(map(len, seen.values())) > MEMO:
                yield from told()
        yield from told()

    return rows.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(words: DataFrame, least: int) -> tuple[DataFrame, int, str]:
    """Frequent words ``(lang, word, f, h)`` with their hashes, and the width and seed of the
    numbers (a hash's first bits) that none of them shares with any other word."""
    for width, seed in WIDTHS:
        hashed = words.withColumn("h", F.xxhash64(F.lit(seed), "lang", "word"))
        number = F.shiftrightunsigned("h", 64 - width)
        clash = hashed.groupBy(number.alias("number")).agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("f")) \
            .where((F.col("f") >= least) & ((F.col("n") > 1) | (F.col("number") == 0)))
        if clash.isEmpty():
            return hashed.where(F.col("f") >= least), width, seed
    raise ValueError("no hash keeps the frequent words apart")


def bit_table(positions: DataFrame, *names: str) -> bytes:
    """A table of ``2**FILTER_BITS`` bits in which all positions are set; its size is fixed."""
    at = positions.select(F.explode(F.array(*names)).alias("p"))
    parts = at.groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("bits"))
    table = bytearray(1 << FILTER_BITS - 3)
    for part, bits in parts.toLocalIterator():
        table[part << 12:part + 1 << 12] = bits
    return bytes(table)


class Numbers(dict):
    """Number of each word of a language; 0 for a break and for words that are surely rare."""

    def __init__(self, lang: str, width: int, seed: str, table: bytes):
        self.seed = xxhash.xxh64_intdigest(lang.encode(), xxhash.xxh64_intdigest(seed.encode(), 42))
        self.shift, self.table = 64 - width, table

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        known = word != b"." and all(self.table[p >> 3] >> (p & 7) & 1 for p in probes(h))
        if len(self) >= MEMO:
            self.clear()
        self[word] = number = h >> self.shift if known else 0
        return number


def probes(h) -> tuple:
    """Two places of a hash (a number or an array) in the bit table."""
    kind, low = type(h) if isinstance(h, int) else Q.U, (1 << FILTER_BITS) - 1
    return h & kind(low), h >> kind(FILTER_BITS) & kind(low)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return Q.mixed(Q.mixed(a) + b)


def in_table(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for p in probes(h):
        found &= (table[p >> Q.U(3)] >> (p & Q.U(7)).astype("u1") & 1).astype(bool)
    return found


def grams_of(a: np.ndarray, pairs: np.ndarray | None) -> list[np.ndarray]:
    """Without ``pairs`` the pairs of an array of numbers, else its phrases of three and four
    words whose pairs are all in that table; zeros fill up the fourth place."""
    fit = (a[:-1] > 0) & (a[1:] > 0)
    if pairs is None:
        at = np.flatnonzero(fit)
        return [a[at], a[at + 1]]
    at = np.flatnonzero(fit)
    fit[at] = in_table(pair_hash(a[at], a[at + 1]), pairs)
    three = np.flatnonzero(fit[:-1] & fit[1:])
    four = np.flatnonzero(fit[:-2] & fit[1:-1] & fit[2:])
    return [np.concatenate([a[three + k], a[four + k]]) for k in range(3)] + [np.concatenate([np.zeros(len(three), Q.U), a[four + 3]])]


def gram_counts(rows: DataFrame, width: int, seed: str, words: bytes, pairs: bytes | None, shards: int, least: int) -> DataFrame:
    """``(key, a, p1, p2)`` of the n-grams with ``least`` occurrences: their numbers side by side,
    and for pairs their places in the bit table."""
    spark = rows.sparkSession
    table, size, step = spark.sparkContext.broadcast((words, pairs)), 2 if pairs is None else LONGEST, width // 8

    def shard_of(keys: np.ndarray) -> np.ndarray:
        return ((keys[:, 0] >> Q.U(32)) * Q.U(shards) >> Q.U(32)).astype(np.int64)

    def packed(gathered: list[np.ndarray]):
        keys, counts = Q.summed(np.concatenate(gathered))
        part = shard_of(keys)
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(keys) else [0]
        yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)),
                                          pa.array([Q.packed(keys[i:j], counts[i:j], size * width) for i, j in zip(cut, cut[1:])], pa.binary())],
                                         names=["shard", "filter"])

    def count(batches):
        word_table, pair_table = table.value
        pair_table = None if pair_table is None else np.frombuffer(pair_table, "u1")
        numbers: dict[str, Numbers] = {}
        waiting, n, gathered, m = [], 0, [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in numbers:
                    if len(numbers) >= 64:
                        numbers.clear()
                    numbers[lang] = Numbers(lang, width, seed, word_table)
                of = numbers[lang].__getitem__
                for some in words_of(text.as_py()):
                    waiting.append(np.fromiter(map(of, some), Q.U, len(some)))
                    n += len(some)
                waiting.append(np.zeros(1, Q.U))
                if n >= GATHER // 4:
                    gathered.append(Q.keys(grams_of(np.concatenate(waiting), pair_table), width))
                    waiting, n, m = [], 0, m + len(gathered[-1])
                    if m >= GATHER:
                        yield from packed(gathered)
                        gathered, m = [], 0
        if waiting:
            gathered.append(Q.keys(grams_of(np.concatenate(waiting), pair_table), width))
        if gathered:
            yield from packed(gathered)

    def merge(batches):
        def told():
            keys, counts = merger.total()
            keys, counts = keys[counts >= least], counts[counts >= least]
            found = Q.grams(keys, size, width)
            p1, p2 = probes(pair_hash(found[0], found[1])) if size == 2 else (np.zeros(len(keys), Q.U),) * 2
            raw = np.stack(found, axis=1).astype(">u8").view("u1").reshape(len(keys), size, 8)[:, :, 8 - step:]
            sizes = size - (found[-1] == 0)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()[:step * k] for r, k in zip(raw, sizes)], pa.binary()), pa.array(counts, pa.int64()),
                                              pa.array(p1.astype(np.int64)), pa.array(p2.astype(np.int64))], names=["key", "a", "p1", "p2"])

        shard, merger = None, None
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != shard:
                    if merger:
                        yield from told()
                    shard, merger = part, Q.Merger()
                merger.add(*Q.unpacked(data.as_py()))
        if merger:
            yield from told()

    filters = rows.mapInArrow(count, "shard int, filter binary")
    return filters.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(merge, "key binary, a long, p1 long, p2 long")


def exact(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def phrases(docs: DataFrame, least: int = 30, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases."""
    spark, stages, rows = docs.sparkSession, Stages(docs.sparkSession, "phrases"), by_row(docs, lang_col, text_col)
    words = stages.table(word_counts(rows), "words")
    langs = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = words.agg(F.sum("f")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SHARD)
    frequent, width, seed = numbered(words, least)
    hash_places = frequent.select(F.expr(f"h & {(1 << FILTER_BITS) - 1}L").alias("p1"),
                                  F.expr(f"shiftrightunsigned(h, {FILTER_BITS}) & {(1 << FILTER_BITS) - 1}L").alias("p2"))
    step = width // 8
    vocabulary = stages.table(frequent.select(
        F.unhex(F.lpad(F.hex(F.shiftrightunsigned("h", 64 - width)), 2 * step, "0")).alias("key"), "lang", "word", "f"), "vocabulary")
    known = bit_table(hash_places, "p1", "p2")
    pairs = stages.table(gram_counts(rows, width, seed, known, None, shards, least), "pairs")
    longer = stages.table(gram_counts(rows, width, seed, known, bit_table(pairs, "p1", "p2"), shards, least), "longer")
    return ranked(pairs.select("key", "a").unionAll(longer.select("key", "a")), vocabulary, langs, step, top)


def ranked(grams: DataFrame, vocabulary: DataFrame, langs: DataFrame, step: int, top: int) -> DataFrame:
    # a rare word that the bit table let through has a number that is in no vocabulary: its phrases
    # can't be candidates; those of frequent words are found in full
    size = (F.octet_length("key") / step).cast("int")
    counts = grams.unionAll(vocabulary.select("key", F.col("f").alias("a")))
    cuts = grams.select("key", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "key", "a", "k", F.expr(f"substring(key, 1, k * {step})").alias("left"), F.expr(f"substring(key, k * {step} + 1)").alias("right"))
    cuts = cuts.join(counts.select(F.col("key").alias("left"), F.col("a").alias("l")), "left") \
        .join(counts.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    score = F.expr("(cast(a as decimal(20,0)) * 2000000BD) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long")
    scored = cuts.withColumn("score", score).groupBy("key").agg(
        F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = grams.where(size > 2).select("a", "key", size.alias("size")) \
        .select("a", "key", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("len")) \
        .select("a", "key", "len", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("len"))).alias("from")) \
        .select(F.expr(f"substring(key, from * {step} + 1, len * {step})").alias("key"), "a") \
        .groupBy("key").agg(F.max("a").alias("around"))
    held = F.col("around").isNull() | (exact("around") * 100 < exact("a") * 80)
    scored = scored.join(inner, "key", "left").where(held)
    scored = scored.withColumn("first", F.expr(f"substring(key, 1, {step})")) \
        .join(vocabulary.select(F.col("key").alias("first"), "lang"), "first")
    # only what can be among the first is spelled out
    by = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"))
    near = scored.withColumn("place", F.rank().over(by)).where(F.col("place") <= top)
    parts = near.select("lang", "key", "a", "cut", F.explode(F.sequence(F.lit(0), size - 1)).alias("i")) \
        .withColumn("part", F.expr(f"substring(key, i * {step} + 1, {step})")) \
        .join(vocabulary.select(F.col("key").alias("part"), "word"), "part")
    spelled = parts.groupBy("lang", "key").agg(
        F.max("a").alias("a"), F.max("cut").alias("cut"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    last = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return spelled.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top).join(langs, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
