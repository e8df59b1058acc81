"""Centroid clustering against plain Python."""

import hashlib
import math
import random

from ledgerflow.llm.centroids import cluster, moved

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k, dims, rounds, scale=256):
    """rows: (id, vector); the answer per row, in order, for rows that take part."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(best(v)[1], []).append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g)] if (g := groups.get(n)) else c for n, c in enumerate(centroids)]
    told = [(i, best(v)) for i, v in kept]
    total = sum(d for _, (d, _) in told)
    per = {}
    for _, (d, n) in told:
        per[n] = per.get(n, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, per[n], total, sha[n]) for i, (d, n) in told), key=str)


def check(spark, rows, schema=SCHEMA, **args):
    out, _ = cluster(spark.createDataFrame([(*r, 0) for r in rows], schema), **args)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, args["k"], args["dims"], args["rounds"])
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_random_vectors_ties_and_repeats(spark):
    rnd = random.Random(1)
    rows = [(i % 90, [rnd.choice([-1.5, -0.001, 0.25, rnd.gauss(0, 1)]) for _ in range(5)]) for i in range(120)]
    check(spark, rows + rows[:20], k=7, dims=5, rounds=4)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [nan, 0.0, 0.0]), (5, [inf, 0.0, 0.0]), (6, [1.0, 2.0]),
            (7, [1.0, 2.0, 3.0]), (8, [0.0, 0.0, 0.0]), (8, [0.0, 0.0, 0.0]), (None, [-0.001, 2.0, -3.0])]
    check(spark, rows, k=40, dims=3, rounds=3)           # fewer vectors than centroids


def test_equal_distances_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    check(spark, [(i, [0.0, 0.0]) for i in range(6)], k=3, dims=2, rounds=2)
    df = spark.createDataFrame([([1, 1],), ([2, 2],)], "v array<long>")
    assert moved(df, [[0, 0], [100, 100]], "bigint") == [[1, 1], [100, 100]]
    df = spark.createDataFrame([([-1, 1],), ([-2, 2],)], "v array<long>")
    assert moved(df, [[0, 0]], "bigint") == [[-2, 1]]       # floor, not towards zero


def test_large_components_are_exact(spark):
    check(spark, [(1, [3e6, -3e6]), (2, [2.5e6, 1.0]), (3, [-1e6, 4e6]), (4, [0.0, 0.0])], k=2, dims=2, rounds=2)


def test_empty_table_and_clashing_columns(spark):
    args = dict(k=2, dims=2, rounds=1)
    assert cluster(spark.createDataFrame([], SCHEMA), **args)[0].collect() == []
    check(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<float>, cluster int", **args)
    df = spark.createDataFrame([(1, [1.0, 2.0], 5, {"a": 1})], "vec_id long, embedding array<double>, v int, id map<string,int>")
    assert cluster(df, **args)[0].first()["distance"] == 0
