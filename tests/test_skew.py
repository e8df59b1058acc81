"""Skew handling: a hot key must not end up in one task."""

from dataclasses import replace
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerflow.operators import features as FE
from ledgerflow.operators import process as P
from ledgerflow.schemas import RuleConfig

from helpers import PAYMENT_COLS, T0


def skewed(spark, hot_rows=3000, cold=200):
    rows = [(f"h{i}", i, T0 + timedelta(seconds=i), "hot", Decimal("1.00"), "USD", None, "US", "m")
            for i in range(hot_rows)]
    rows += [(f"c{i}", hot_rows + i, T0 + timedelta(seconds=i), f"c{i % 50}", Decimal("2.00"), "USD", None,
              "GB", "m") for i in range(cold)]
    return spark.createDataFrame(rows, PAYMENT_COLS)


def test_hot_customer_partitions_are_bounded(spark):
    cfg = RuleConfig(window_seconds=60, hot_customer_rows=500, hot_bucket_rows=250)
    df = FE._prepare(skewed(spark), "event_id")
    staged = FE._with_halo(df, "event_id", cfg, FE._hot_customers(df, cfg), 12)
    sizes = staged.filter(F.col("customer_id") == "hot").groupBy("_b").agg(
        F.count_if(~F.col("_halo")).alias("own"), F.count_if("_halo").alias("halo")).collect()
    assert len(sizes) == 12 and sum(r.own for r in sizes) == 3000
    assert max(r.own for r in sizes) <= 2 * 250 and sorted(r.halo for r in sizes) == [0] + [50] * 11


def burst(spark, rows):
    """All rows of one customer within a second, many at the same instant."""
    return spark.range(rows).select(
        F.concat(F.lit("p"), "id").alias("payment_id"), F.col("id").alias("event_id"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") % 1000).alias("created_at"), F.lit("hot").alias("customer_id"),
        (F.col("id") % 977 + 1).cast("decimal(19,4)").alias("amount"), F.lit("USD").alias("currency"),
        F.lit(None).cast("string").alias("card_last4"), F.when(F.col("id") % 5 > 0, "US").alias("country"), F.lit("m").alias("merchant"))


def test_a_burst_within_a_second_is_cut_by_rows(spark):
    cfg = RuleConfig(window_seconds=60, hot_customer_rows=100_000, hot_bucket_rows=50_000)
    df = FE._prepare(burst(spark, 1_000_000), "event_id")
    staged = FE._with_halo(df, "event_id", cfg, FE._hot_customers(df, cfg), 20)
    sizes = sorted(r["count"] for r in staged.groupBy("_b").count().collect())
    assert len(sizes) == 20 and sum(sizes) == 1_000_000 + 19 * 50
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_a_burst_has_the_features_of_the_plain_window(spark):
    df, cols = burst(spark, 60_000), ["payment_id", *FE.FEATURE_COLUMNS]
    plain = FE.activity_snapshot(df, RuleConfig(split_hot=False)).select(*cols)
    split = FE.activity_snapshot(df, RuleConfig(hot_customer_rows=1000, hot_bucket_rows=4000)).select(*cols)
    assert plain.exceptAll(split).count() == 0 and split.count() == 60_000


def test_split_result_equals_plain_window_under_skew(spark):
    df = skewed(spark)
    cols = ["payment_id", "velocity_count", "geo_distinct", "previous_country", "avg_prior_amount",
            "history_retained"]
    base = RuleConfig(window_seconds=60)
    plain = FE.activity_snapshot(df, replace(base, split_hot=False)).select(*cols)
    split = FE.activity_snapshot(df, replace(base, hot_customer_rows=500, hot_bucket_rows=250)).select(*cols)
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0


def test_small_ranges_share_a_task(spark):
    rows = FE._prepare(skewed(spark, 4000, 0), "event_id")
    cut = FE._ranged(rows, "event_id", 40, 100)
    sizes = [r["count"] for r in cut.groupBy("_b").count().collect()]
    assert len(cut.inputFiles()) == 1 and sizes == [100] * 40
    late = cut.groupBy("_b").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi")).orderBy("_b").collect()
    assert all(a.hi < b.lo for a, b in zip(late, late[1:]))


def test_delivery_dedup_limits_before_the_shuffle(spark, ds):
    plan = P.first_delivery(P.decode_events(ds.deliveries))._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    exchange = next(i for i, l in enumerate(lines) if "Exchange hashpartitioning(event_id" in l)
    # a WindowGroupLimit both above (final) and below (partial, map side) the exchange
    assert any("WindowGroupLimit" in l for l in lines[:exchange])
    assert any("WindowGroupLimit" in l for l in lines[exchange + 1:])
