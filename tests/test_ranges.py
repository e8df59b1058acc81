"""Sliding ranges and peaks against brute force."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import ranges as R

T0 = datetime(2026, 1, 1)
EPOCH = datetime(1970, 1, 1)


def stamped(spark, rows, schema):
    return spark.createDataFrame([(T0 + timedelta(seconds=s) if s is not None else None, *rest) for s, *rest in rows], schema)


def brute_ranges(rows, length, step):
    """(label, range end) -> rows of that range, for ends that are multiples of the step."""
    out = defaultdict(list)
    for s, label, *rest in rows:
        if s is None:
            continue
        t = (T0 - EPOCH).total_seconds() + s
        end = t // step * step + step
        while end - length <= t < end:
            out[label, end].append(rest)
            end += step
    return out


@pytest.mark.parametrize("length,step", [(300, 15), (60, 15), (15, 15), (7200, 15), (40, 10)])
def test_sliding_counts_equal_brute_force(spark, length, step):
    rnd = random.Random(length)
    rows = [(rnd.choice([rnd.uniform(-4000, 8000), rnd.uniform(0, 40), 3600 * rnd.randrange(-3, 40)]), rnd.choice("ab")) for _ in range(300)] + [(None, "a")]
    got = R.sliding_events_rate(stamped(spark, rows, "ts timestamp, label string"), "ts", length, step, ["label"]).collect()
    want = {k: len(v) for k, v in brute_ranges(rows, length, step).items()}
    assert {(r.label, (r.range_end - EPOCH).total_seconds()): r.events for r in got} == want and len(got) == len(want)
    assert all(abs(r.rate_per_sec - r.events / length) < 1e-12 for r in got)


def test_rows_before_1970_fall_into_ranges_too(spark):
    df = spark.sql("select timestamp '1969-12-31 23:59:58' as ts")
    ends = [(r.range_end - EPOCH).total_seconds() for r in R.sliding_events_rate(df, "ts", 30, 15).orderBy("range_end").collect()]
    assert ends == [0, 15]


def test_quantiles_interpolate_in_buckets(spark):
    rnd = random.Random(3)
    rows = [(rnd.uniform(0, 900), "x", rnd.choice([0.5, 3.0, 30.0, 200.0, 5000.0, None])) for _ in range(400)]
    out = R.sliding_quantiles(stamped(spark, rows, "ts timestamp, label string, v double"), "ts", "v", (0.5, 0.99), 300, 15, ["label"])
    bounds = [0.0, *R.LATENCY_BUCKETS_MS]

    def quantile(values, q):
        rank = q * len(values)
        for low, high in zip(bounds, bounds[1:]):
            upto, below = sum(v <= high for v in values), sum(v <= low for v in values) if low else 0
            if upto >= rank:
                return low + (high - low) * (rank - below) / (upto - below)
        return bounds[-1]

    want = {k: [v for (v,) in vs if v is not None] for k, vs in brute_ranges(rows, 300, 15).items()}
    want = {k: v for k, v in want.items() if v}
    got = {(r.label, (r.range_end - EPOCH).total_seconds()): r for r in out.collect()}
    assert set(got) == set(want)
    for k, values in want.items():
        assert got[k].total == len(values)
        assert abs(got[k].p50 - quantile(values, 0.5)) < 1e-9 and abs(got[k].p99 - quantile(values, 0.99)) < 1e-9


def test_a_spike_across_a_minute_border_is_seen_whole(spark):
    rows = [(58 + i / 10, 500) for i in range(40)]                   # 4 s around the border
    out = R.sliding_error_rate(stamped(spark, rows, "ts timestamp, status int"))
    assert out.agg(F.max("errors")).first()[0] == 40
    assert abs(out.agg(F.max("error_pct")).first()[0] - 100 * (40 / 60)) < 1e-9


def test_peaks_equal_brute_force(spark):
    rnd = random.Random(9)
    rows = []
    for _ in range(500):
        s = rnd.randrange(0, 300)
        rows.append((s, rnd.choice("ab"), rnd.choice([None, s, s + rnd.randrange(1, 60), s - 5])))
    rows += [(None, "a", 5), (0, None, 10), (5, None, 10)]
    df = spark.createDataFrame([(None if s is None else T0 + timedelta(seconds=s), k, None if e is None else T0 + timedelta(seconds=e))
                                for s, k, e in rows], "s timestamp, label string, e timestamp")
    got = {r.label: (r.peak, (r.peak_at - T0).total_seconds()) for r in R.peak_in_flight(df, F.col("s"), F.col("e"), ["label"]).collect()}
    for label in ("a", "b", None):
        own = [(s, e) for s, k, e in rows if k == label and s is not None and (e is None or e > s)]
        most = [(sum(s <= t and (e is None or e > t) for s, e in own), -t) for t in range(400)]
        best = max(most)
        assert got[label] == (best[0], -best[1])


def test_long_flights_are_not_spelled_out(spark):
    df = spark.range(2000).select(F.timestamp_seconds("id").alias("s"), F.timestamp_seconds(F.col("id") + 10**9).alias("e"), F.lit(0).alias("k"))
    assert R.peak_in_flight(df, F.col("s"), F.col("e"), ["k"]).first()["peak"] == 2000
