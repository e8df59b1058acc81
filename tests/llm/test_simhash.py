"""Fingerprints and components against every pair."""

import random

import numpy as np
import pytest
import xxhash

from ledgerflow.llm import simhash
from ledgerflow.llm.common import Stages
from ledgerflow.llm.components import components
from ledgerflow.llm.queries import QUERIES
from ledgerflow.llm.simhash import Tree, keep_one, near_duplicates, near_links

SF = "/root/testdata/sf0.001"


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {i: " " for i in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_components(fps):
    n = len(fps)
    return roots(n, [(i, j) for i in range(n) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefé", k=rnd.randint(1, 5)))
    base = [" ".join(word() for _ in range(rnd.randint(1, 300))) for _ in range(60)]
    near = []
    for t in base[:30]:
        w = t.split(" ")
        w[rnd.randrange(len(w))] = word()
        near.append(" ".join(w))
    return base + near + base[:10] + [None, "", " \n\t", "One", "one", "two words", "A\x0bb c", "Ünï Ä", "x " * 30_000, "y\x85z"]


def test_near_duplicates(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "doc_id long, text string, fp int, fingerprint string")
    fps = [brute_fp(t) for t in texts]
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(df).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(texts))}
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "q w e r t y u"), (9, "other words here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (None, 3), (None, None), (9, 9)], key=str)
    assert sorted((r.doc_id for r in keep_one(df).collect()), key=str) == [3, 9, None]
    assert [r.doc_id for r in keep_one(df.where("doc_id = 5")).collect()] == [5]


def test_texts_that_share_an_id_are_told_apart(spark):
    rows = [(1, "alpha beta gamma delta", {"k": 1}), (1, "zeta eta theta iota kappa", {"k": 2}), (0, "alpha beta gamma delta", {"k": 3}),
            (1, "zeta eta theta iota kappa", {"k": 0})]
    df = spark.createDataFrame(rows, "doc_id long, text string, root map<string,int>")
    got = keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text, r.root["k"]) for r in got.collect()) == [(0, rows[2][1], 3), (1, rows[1][1], 0)]


@pytest.mark.parametrize("shard", [64, 500])
def test_links_are_exact_with_many_shards_and_blocks(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "BLOCK", shard)
    rnd = np.random.default_rng(8)
    seeds = rnd.integers(0, 1 << 63, 500, dtype=np.uint64)
    points = set(seeds.tolist())
    for s in seeds[:200].tolist():                        # neighbours at 1 to 6 bits, and one dense cluster
        for _ in range(3):
            for b in rnd.choice(64, rnd.integers(1, 7), replace=False):
                s ^= 1 << int(b)
            points.add(s)
    for _ in range(600):
        points.add(int(seeds[0]) ^ (1 << int(rnd.integers(64))) ^ (1 << int(rnd.integers(64))))
    fps = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    stages = Stages(spark, "t")
    got = dict(map(tuple, components(near_links(df, 3, stages), stages).collect()))
    want = brute_components(fps)
    groups = {}
    for s, w in zip(signed, want):
        groups.setdefault(w, []).append(s)
    assert got == {s: min(g) for g in groups.values() for s in g if s != min(g)}


def test_tree_asks_wherever_neighbours_may_be():
    rnd = np.random.default_rng(1)
    points = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64)
    other = points.copy()
    for i in range(len(other)):
        for b in rnd.choice(64, 3, replace=False):
            other[i] ^= np.uint64(1 << int(b))
    tree = Tree(points, 6)
    both = np.concatenate([points, other])
    row, shard, asks = tree.route(both, 3)
    home = {int(r): int(s) for r, s, a in zip(row, shard, asks) if not a}
    asked = {(int(r), int(s)) for r, s, a in zip(row, shard, asks) if a}
    assert len(home) == 6000 and tree.shards > 30
    for i in range(3000):
        a, b = home[i], home[i + 3000]
        assert a == b or (i, b) in asked or (i + 3000, a) in asked


def test_components_of_long_chains_and_hubs(spark):
    rnd = random.Random(6)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(500)] + [(5000 + i, 4000) for i in range(50)]
    pairs += [(-7, 20), (20, -7), (8, 8), (None, 3)]
    rnd.shuffle(pairs)
    df = spark.createDataFrame(pairs, "a long, b long")
    got = dict(map(tuple, components(df, Stages(spark, "t")).collect()))
    want = {i: -7 for i in range(301)} | {1001 + i: 1000 for i in range(500)} | {5000 + i: 4000 for i in range(50)}
    assert got == want
    assert components(df.where("a > 9999"), Stages(spark, "t")).count() == 0


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    fps = [brute_fp(t) for _, t in docs]
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash_groups"](spark, SF).collect()}
    assert got == {d: (f"{fps[i]:016x}", docs[want[i]][0]) for i, (d, _) in enumerate(docs)}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0 and keep_one(none).count() == 0
