"""Recall against brute force, exact scores and the rows that take no part."""

import random

import numpy as np
import pytest

from ledgerflow.llm import nearest as N
from ledgerflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def brute(ids, x, k=20, every=20):
    out = {}
    for q in np.nonzero(ids % every == 0)[0]:
        s = (x[q] * x).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def shaped(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_of_the_query(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, x)
    monkeypatch.setattr(N, "PART_ROWS", 128)              # 16 parts, in blocks
    got = shaped(QUERIES["op2_nearest_vectors"](spark, SF).collect())
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    scores = {q: {int(i): float((x[ids == q][0] * v).sum()) for i, v in zip(ids, x)} for q in list(want)[:20]}
    for q, best in scores.items():
        for vec, score in got[q]:
            assert score == pytest.approx(best[vec], abs=1e-12) and vec != q
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_clustered_vectors_need_few_parts():
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(64, 16))
    x = centres[rnd.integers(0, 64, 4000)] + rnd.normal(size=(4000, 16)) * 0.05
    router = N.fit(x, 16, 10)
    assert 1 <= router.probes <= 4
    sizes = np.bincount(N.balanced_parts(x, N.neighbour_graph(x, 10), 16), minlength=16)
    assert sizes.max() <= 1.06 * len(x) / 16 + 1


def test_ties_copies_and_rows_without_part(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)], 1, "x") for i in range(300)]
    rows += [(i, rows[7][1], 1, "x") for i in range(300, 380)]            # copies: ties go by id
    ok = list(rows)
    rows += rows[:40]                                                      # repeated rows
    rows += [(400, None, 1, "x"), (420, [0.0] * 8, 1, "x"), (440, [float("nan")] * 8, 1, "x"), (460, [float("inf")] + [1.0] * 7, 1, "x"),
             (480, [None] + [1.0] * 7, 1, "x"), (None, [1.0] * 8, 1, "x"), (500, [1.0] * 3, 1, "x"), (520, [], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string")
    got = shaped(N.nearest(df).collect())
    want = brute(np.array([r[0] for r in ok]), np.array([r[1] for r in ok]))
    assert got.keys() == want.keys()
    for q in want:
        assert [a for a, _ in got[q]] == [a for a, _ in want[q]]
        assert [b for _, b in got[q]] == pytest.approx([b for _, b in want[q]], abs=1e-12)


def test_few_candidates_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert shaped(N.nearest(df).collect()) == {0: [(20, 4.0), (3, -1.0)], 20: [(0, 4.0), (3, -2.0)]}
    assert N.nearest(df.where("vec_id = 0")).count() == 0
    assert N.nearest(df.where("vec_id > 99")).count() == 0
