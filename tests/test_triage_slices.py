"""Stream triage with customers cut into time slices: halos, empty slices, hot customers, late rows."""

import random
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerflow.operators.features import activity_snapshot
from ledgerflow.schemas import RuleConfig
from ledgerflow.session import scoped_conf
from ledgerflow.streaming import triage_slices
from ledgerflow.streaming.runs import stream_triage_run
from ledgerflow.streaming.triage_slices import _ROW, stream_activity_slices, window_features
from ledgerflow.streaming.triage_state import OUTPUT_SCHEMA

from helpers import PAYMENT_COLS, T0

COLS = ["payment_id", "velocity_count", "geo_distinct", "previous_country", "avg_prior_amount", "history_retained"]
CFG = RuleConfig(window_seconds=60, max_history=5)


def run(spark, df, cfg, seconds, stragglers=None):
    return stream_triage_run(spark, df, cfg, stragglers=stragglers, state_partitions=4,
                             activity=lambda s, c, d: stream_activity_slices(s, c, d, seconds))


def table(spark, rows):
    return spark.createDataFrame([(f"p{i}", i, T0 + timedelta(seconds=s), c, Decimal(a), "USD", None, n, "m")
                                  for i, (c, s, a, n) in enumerate(rows)], PAYMENT_COLS)


def same(got, want):
    a, b = got.select(COLS), want.select(COLS)
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_equals_batch_with_a_third_of_rows_in_one_customer(spark):
    rnd = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"c{rnd.randrange(9)}", rnd.choice([i // 2, i * 7, i * 400]), f"{rnd.randint(1, 9000)}.{rnd.randint(10, 99)}",
             rnd.choice(["US", "us", "GB", None])) for i in range(900)]
    df = table(spark, rows)
    log = run(spark, df, CFG, 600)
    assert same(log.committed("features", OUTPUT_SCHEMA), activity_snapshot(df, CFG))
    assert log.committed("late_rows", OUTPUT_SCHEMA).count() == 0


def test_halo_crosses_slices_with_few_rows_and_gaps(spark):
    rows = [("c", s, f"{10 + i}.00", n) for i, (s, n) in enumerate(
        [(0, "US"), (9, "GB"), (11, "US"), (35, None), (36, "DE"), (36, "DE"), (5000, "US"), (5001, "GB"), (5009, "US"), (9999, "US")])]
    df = table(spark, rows)
    assert same(run(spark, df, CFG, 10).committed("features", OUTPUT_SCHEMA), activity_snapshot(df, CFG))


def test_rows_of_a_folded_slice_are_late_and_none_is_lost(spark):
    df = table(spark, [("c", s, "1.00", "US") for s in range(0, 400, 10)])
    late = F.col("event_id") % 7 == 3
    log = run(spark, df.filter(~late), CFG, 50, stragglers=df.filter(late))
    done, told = log.committed("features", OUTPUT_SCHEMA), log.committed("late_rows", OUTPUT_SCHEMA)
    assert same(done, activity_snapshot(df.filter(~late), CFG))
    assert {r.payment_id for r in told.collect()} == {r.payment_id for r in df.filter(late).collect()}


def test_state_of_a_hot_customer_is_spread_over_its_slices(spark):
    df = table(spark, [("hot", s, "1.00", "US") for s in range(2000)])
    log = run(spark, df, CFG, 10)
    root = log.root.rsplit("/", 1)[0]
    halos = spark.read.format("statestore").option("stateVarName", "halo").option("operatorId", 0).load(f"{root}/checkpoint")
    assert 0 < halos.count() <= CFG.max_history + 1            # two keys: the customer's halo and the sentinel's
    assert same(log.committed("features", OUTPUT_SCHEMA), activity_snapshot(df, CFG))


def test_features_of_a_long_slice_take_amounts_beyond_64_bits():
    rows = [(i, i, f"p{i}", Decimal("900000000000000.0000"), "USD", "US") for i in range(60)]
    assert str(window_features(rows, 59, RuleConfig())[0][3]) == "900000000000000.00"
    assert len(_ROW.split(", ")) == 6


def test_runs_in_a_session_whose_state_store_has_no_column_families(spark):
    df = table(spark, [("c", s, "1.00", "US") for s in range(0, 60, 10)])
    store = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    with scoped_conf(spark, **{"spark.sql.streaming.stateStore.providerClass": store}):
        assert same(run(spark, df, CFG, 20).committed("features", OUTPUT_SCHEMA), activity_snapshot(df, CFG))


def test_halos_are_kept_by_bucket_not_by_customer(spark, monkeypatch):
    """A key per customer and slice, for a row or two each, made 6 GB run out of time."""
    monkeypatch.setattr(triage_slices, "BUCKETS", 3)
    df = table(spark, [(None if i % 40 == 39 else f"c{i % 40}", i, f"{i + 1}.50", ["US", "GB", None][i % 3]) for i in range(240)])
    log = run(spark, df, CFG, 50)
    assert same(log.committed("features", OUTPUT_SCHEMA), activity_snapshot(df, CFG))
    halos = spark.read.format("statestore").option("stateVarName", "halo").option("operatorId", 0).load(log.root.rsplit("/", 1)[0] + "/checkpoint")
    assert 0 < halos.select("key").distinct().count() <= 3 and halos.count() == 40       # one a customer
