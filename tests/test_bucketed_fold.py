"""The fold of a bucket of customers against the deque, row by row."""

import random
from dataclasses import replace
from datetime import timedelta
from decimal import Decimal

import pytest

from ledgerflow.schemas import RuleConfig
from ledgerflow.streaming import triage_state
from ledgerflow.streaming.runs import stream_triage_run
from ledgerflow.streaming.triage_state import OUTPUT_SCHEMA

from helpers import PAYMENT_COLS, T0
from test_naive_fold import naive, random_rows

CFG = RuleConfig(window_seconds=60)


def folded(spark, rows, cfg=CFG):
    log = stream_triage_run(spark, spark.createDataFrame(rows, PAYMENT_COLS), cfg, state_partitions=2)
    assert log.committed("late_rows", OUTPUT_SCHEMA).count() == 0
    return {r["payment_id"]: r for r in log.committed("features", OUTPUT_SCHEMA).collect()}


@pytest.mark.parametrize("buckets, cfg", [(1, CFG), (3, replace(CFG, max_history=4)), (512, CFG)])
def test_equals_the_deque_across_micro_batches(spark, monkeypatch, buckets, cfg):
    monkeypatch.setattr(triage_state, "BUCKETS", buckets)
    rows = random_rows(7)
    want = naive(sorted([(r[0], r[3], r[2], r[4], r[7]) for r in rows], key=lambda r: (r[2], int(r[0][1:]))), cfg)
    got = folded(spark, rows, cfg)
    assert {p: (r["velocity_count"], r["geo_distinct"], r["previous_country"], r["avg_prior_amount"], r["history_retained"])
            for p, r in got.items()} == want
    assert {p: (r["customer_id"], r["created_at"], r["event_id"], r["amount"], r["country"]) for p, r in got.items()} \
        == {r[0]: (r[3], r[2], r[1], r[4], r[7]) for r in rows}


def test_the_state_has_a_row_per_bucket_not_per_customer(spark, monkeypatch):
    """A call and a state per customer made 6 GB run out of time."""
    monkeypatch.setattr(triage_state, "BUCKETS", 4)
    rows = [(f"p{i}", i, T0 + timedelta(seconds=i), f"c{i}", Decimal("5.00"), "USD", None, "US", "m") for i in range(300)]
    df = spark.createDataFrame(rows, PAYMENT_COLS)
    log = stream_triage_run(spark, df, CFG, state_partitions=2)
    assert log.committed("features", OUTPUT_SCHEMA).count() == 300
    state = spark.read.format("statestore").load(log.root.rsplit("/", 1)[0] + "/checkpoint")
    assert 0 < state.count() <= 4


def test_amounts_beyond_64_bits_null_amounts_and_null_names(spark):
    big = Decimal("900000000000000.0001")
    rows = [("p0", 0, T0, "c", big, "USD", None, "US", "m"), ("p1", 1, T0 + timedelta(seconds=1), "c", big, "USD", None, None, "m"),
            ("p2", 2, T0 + timedelta(seconds=2), "c", None, "USD", None, "GB", "m"), ("p3", 3, T0 + timedelta(seconds=3), "c", Decimal("1.00"), "USD", None, "GB", "m"),
            ("p4", None, T0, None, Decimal("7.00"), "USD", None, "US", "m"), ("p5", 5, T0 + timedelta(seconds=1), None, Decimal("8.00"), "USD", None, "US", "m")]
    got = folded(spark, rows)
    assert [got[f"p{i}"]["amount"] for i in range(4)] == [big, big, None, Decimal("1.00")]
    assert [got[f"p{i}"]["avg_prior_amount"] for i in range(4)] == [None, *[Decimal("900000000000000.00")] * 3]
    assert [got[f"p{i}"]["geo_distinct"] for i in range(4)] == [1, 1, 2, 2]
    assert got["p4"]["event_id"] is None and got["p5"]["avg_prior_amount"] == Decimal("7.00") and got["p5"]["customer_id"] is None


def test_late_rows_have_no_features(spark):
    df = spark.createDataFrame([(f"p{i}", i, T0 + timedelta(seconds=100 * i), "c", Decimal("5.00"), "USD", None, "US", "m") for i in range(6)], PAYMENT_COLS)
    log = stream_triage_run(spark, df.filter("event_id != 2"), CFG, stragglers=df.filter("event_id = 2"))
    (late,) = log.committed("late_rows", OUTPUT_SCHEMA).collect()
    assert late["payment_id"] == "p2" and late["amount"] == Decimal("5.0000")
    assert [late[c] for c in ("velocity_count", "geo_distinct", "previous_country", "avg_prior_amount", "history_retained")] == [None] * 5


def test_rows_without_a_time_are_late_not_lost(spark):
    rows = [(f"p{i}", i, None if i % 4 == 1 else T0 + timedelta(seconds=i), "c" if i < 8 else "d", Decimal("5.00"), "USD", None, "US", "m") for i in range(12)]
    log = stream_triage_run(spark, spark.createDataFrame(rows, PAYMENT_COLS), CFG)
    late = log.committed("late_rows", OUTPUT_SCHEMA).collect()
    assert {(r["payment_id"], r["created_at"]) for r in late} == {("p1", None), ("p5", None), ("p9", None)}
    assert {r["payment_id"] for r in log.committed("features", OUTPUT_SCHEMA).collect()} == {f"p{i}" for i in range(12) if i % 4 != 1}
