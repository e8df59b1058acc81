"""Counting quotient filters and phrase mining against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerflow.llm import collocations as C
from ledgerflow.llm import quotient_filter as Q


@given(st.sampled_from([48, 56, 64]), st.integers(2, 4), st.integers(0, 2**32))
@settings(max_examples=40, deadline=None)
def test_permutation_and_packing_lose_nothing(width, size, seed):
    rnd = np.random.default_rng(seed)
    grams = [rnd.integers(0, 1 << min(width, 63), 50, dtype=np.uint64) for _ in range(size)]
    grams[0][:3] = (1 << width) - 1
    keys = Q.keys(grams, width)
    assert keys.shape == (50, -(-size * width // 64))
    assert all((a == b).all() for a, b in zip(grams, Q.grams(keys, size, width)))


@given(st.sampled_from([(48, 2), (48, 4), (64, 2), (64, 4), (56, 3)]), st.integers(1, 3000), st.integers(0, 2**32))
@settings(max_examples=30, deadline=None)
def test_filters_round_trip_and_merge(shape, n, seed):
    width, size = shape
    rnd, truth, merger = np.random.default_rng(seed), Counter(), Q.Merger(room=500)
    for _ in range(4):
        grams = [rnd.integers(1, 9, n, dtype=np.uint64) for _ in range(size)]
        truth.update(zip(*(g.tolist() for g in grams)))
        keys, counts = Q.summed(Q.keys(grams, width))
        back = Q.unpacked(Q.packed(keys, counts * 400, size * width))
        assert (back[0] == keys).all() and (back[1] == counts * 400).all()
        merger.add(keys, counts)
    keys, counts = merger.total()
    assert Counter(dict(zip(zip(*(g.tolist() for g in Q.grams(keys, size, width))), counts.tolist()))) == truth


def brute(rows, least, top):
    words, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for size in range(1, 5):
                f.update((lang, tuple(w[i:i + size])) for i in range(len(w) - size + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        inside = any(100 * b >= 80 * a for (x, q), b in cand.items() if x == lang and len(q) > len(p)
                     and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if not inside:
            score, _, l, r = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, n + 1, p.decode(), -a, l, r, words[lang], -s)
                  for lang, found in out.items() for n, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def told(df):
    return sorted(map(tuple, df.collect()))


def texts(n, seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["Éa", "x\x1cy", "日本", "The", "the", " ", "."]
    for _ in range(n):
        yield (rnd.choice(["en", "de", None, "und", ""]),
               rnd.choice([None, "", " "]) if rnd.random() < 0.1 else
               rnd.choice(["", " "]).join("".join((rnd.choice(vocab), rnd.choice([" ", " ", "\t", "  ", ", ", "\n", "\x0b"]))) for _ in range(rnd.randint(1, 60))))


@pytest.mark.parametrize("seed,least,top,chunk", [(1, 5, 2000, 1 << 22), (2, 3, 7, 40), (3, 30, 3, 200)])
def test_phrases_equal_brute_force(spark, monkeypatch, seed, least, top, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rows = list(texts(200, seed)) * 2
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert told(C.phrases(df, least, top)) == brute(rows, least, top)


def test_a_full_bit_table_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "bit_table", lambda *a: b"\xff" * (1 << C.FILTER_BITS - 3))
    rows = list(texts(120, 4))
    assert told(C.phrases(spark.createDataFrame(rows, "lang string, text string"), 4, 50)) == brute(rows, 4, 50)


def test_words_are_hashed_again_if_a_frequent_one_shares_its_number(spark, monkeypatch):
    monkeypatch.setattr(C, "WIDTHS", [(8, "0"), (64, "0")])
    words = spark.createDataFrame([("en", f"w{i}", 40 if i < 50 else 1) for i in range(500)], "lang string, word string, f long")
    found, width, _ = C.numbered(words, 30)
    assert width == 64 and found.count() == 50


def test_long_text_empty_table_and_clashing_columns(spark):
    rows = [("en", "alpha beta gamma, " * 40_000), ("en", "y" * 6_000_000)]
    assert told(C.phrases(spark.createDataFrame(rows, "lang string, text string"), 30, 5)) == brute(rows, 30, 5)
    assert C.phrases(spark.createDataFrame([], "lang string, text string, key string")).collect() == []
    df = spark.createDataFrame([("a b. " * 40, "en", 1, {"a": 1})], "text string, lang string, key int, f map<string,int>")
    assert [r.phrase for r in C.phrases(df).collect()][:1] == ["a b"]
