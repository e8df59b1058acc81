"""Metric operators against brute force on small fixtures."""

import random
from datetime import datetime, timedelta
from fractions import Fraction

from pyspark.sql import functions as F

from ledgerflow.operators import metrics as M

T0 = datetime(2026, 1, 1)


def rank_wanted(n, p):
    """How many values lie before the percentile, in exact fractions (half to even)."""
    exact = Fraction(p * (n - 1), 100)
    low = exact.numerator // exact.denominator
    rest = exact - low
    return low + (rest > Fraction(1, 2) or (rest == Fraction(1, 2) and low % 2 == 1))


def holds_rank(vals, answer, p):
    """The answer is the value with exactly that many before it, equal ones in any order."""
    below = sum(v < answer for v in vals)
    return answer in vals and below <= rank_wanted(len(vals), p) < below + vals.count(answer)


def test_nearest_rank_matches_the_formula(spark):
    rnd = random.Random(3)
    for n in (1, 2, 7, 1000, 2345):
        vals = [round(rnd.choice([rnd.random() * 50, rnd.random() * 500, 3.0]), 2) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in vals], "v double")
        got = M.nearest_rank_percentiles(df, "v").first()
        assert (got["max"], got["n"]) == (max(vals), n)
        assert all(holds_rank(vals, got[f"p{p}"], p) for p in (50, 95, 99))


def test_histogram_quantile_interpolates(spark):
    # one window: 10 values in (0,1], 10 in (1,2.5], 80 in (2.5,5]
    vals = [0.5] * 10 + [2.0] * 10 + [4.0] * 80
    df = spark.createDataFrame([(T0, v) for v in vals], "ts timestamp, v double")
    r = M.histogram_quantiles(df, "ts", "v", qs=(0.5, 0.99)).first()
    assert r["total"] == 100
    assert abs(r["p50"] - (2.5 + 2.5 * (50 - 20) / 80)) < 1e-9
    assert abs(r["p99"] - (2.5 + 2.5 * (99 - 20) / 80)) < 1e-9
    inf = spark.createDataFrame([(T0, 5000.0)], "ts timestamp, v double")
    assert M.histogram_quantiles(inf, "ts", "v").first()["p50"] == M.LATENCY_BUCKETS_MS[-1]


def test_error_rate_denominator_is_clamped(spark):
    rows = [(T0 + timedelta(seconds=i), 500 if i < 3 else 202) for i in range(30)]
    r = M.error_rate(spark.createDataFrame(rows, "ts timestamp, status int")).first()
    # 30 requests in a minute is 0.5/s, clamped to 1/s: 100 * (3/60) / 1
    assert (r["errors"], r["requests"]) == (3, 30) and abs(r["error_pct"] - 5.0) < 1e-9


def test_sliding_rate_counts_each_row_in_six_windows(spark):
    df = spark.createDataFrame([(T0 + timedelta(seconds=5),)], "ts timestamp")
    out = M.sliding_rate(df, "ts").collect()
    assert len(out) == 6 and all(r["events"] == 1 for r in out)


def test_in_flight_lag(spark):
    rows = [(0, T0 + timedelta(seconds=55), 10), (0, T0 + timedelta(seconds=58), 10),
            (1, T0 + timedelta(seconds=10), 0)]
    df = spark.createDataFrame(rows, "partition int, delivered_at timestamp, hold int")
    out = {r["partition"]: r["max_lag"] for r in M.in_flight_lag(
        df, F.col("delivered_at") + F.make_interval(secs=F.col("hold"))).collect()}
    assert out == {0: 2, 1: 0}


def test_throughput(spark):
    df = spark.createDataFrame([(T0,), (T0 + timedelta(seconds=10),), (T0 + timedelta(seconds=4),)], "ts timestamp")
    r = M.throughput(df, "ts").first()
    assert (r["rows"], r["seconds"]) == (3, 10.0) and abs(r["rows_per_sec"] - 0.3) < 1e-12
