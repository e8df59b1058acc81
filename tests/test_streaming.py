"""Stateful stream triage (T1): event-time order, late rows, restart."""

from datetime import timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerflow.operators.features import activity_snapshot
from ledgerflow.schemas import RuleConfig
from ledgerflow.streaming.staging import run_folder
from ledgerflow.streaming.triage_state import stream_activity

from helpers import PAYMENT_COLS, T0

CFG = RuleConfig(window_seconds=60)
FEATURES = ["payment_id", "velocity_count", "geo_distinct", "previous_country", "avg_prior_amount",
            "history_retained"]


def rows(spec):
    """spec: (payment id, customer, seconds, amount, country)."""
    return [(pid, int(pid[1:]), T0 + timedelta(seconds=s), c, Decimal(a), "USD", None, country, "m")
            for pid, c, s, a, country in spec]


def run_stream(spark, files, delay="2 minutes", idle_ttl_seconds=None):
    """Each element of ``files`` is one arrival (a list of rows); returns the output rows."""
    root = run_folder(spark, "t1-test")
    for i, f in enumerate(files):
        # one file per arrival, so arrivals are read in order
        spark.createDataFrame(rows(f), PAYMENT_COLS).coalesce(1).write.mode("append").parquet(f"{root}/in")
    schema = spark.createDataFrame([], PAYMENT_COLS).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = stream_activity(stream.select("payment_id", "customer_id", "created_at", "event_id", "amount",
                                        "currency", "country"), CFG, delay, idle_ttl_seconds)
    q = (out.writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    LAST_QUERY[0] = q
    return spark.read.parquet(f"{root}/out")


LAST_QUERY = [None]


SENTINEL = [("p999", "zz", 10 ** 7, "1.00", "US")]


def test_out_of_order_within_delay_equals_batch(spark):
    a = [("p1", "c", 0, "10.00", "US"), ("p2", "c", 30, "20.00", "GB")]
    b = [("p3", "c", 10, "30.00", "US"), ("p4", "c", 50, "40.00", "US")]   # p3 is older than p2
    c = [("p5", "c", 70, "50.00", "DE")]
    got = run_stream(spark, [a, b, c, SENTINEL]).filter(~F.col("late")).select(*FEATURES)
    batch = activity_snapshot(spark.createDataFrame(rows(a + b + c), PAYMENT_COLS), CFG).select(*FEATURES)
    assert got.count() == 5
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_rows_behind_the_watermark_never_reach_the_fold(spark):
    first = [("p1", "c", 0, "10.00", "US"), ("p2", "c", 1000, "10.00", "US")]
    # when p3 (t=500) arrives the watermark is past it: Spark drops it before the
    # state function (and counts it in the query progress); the others are folded in order
    late = [("p3", "c", 500, "10.00", "GB"), ("p4", "d", 2000, "10.00", "US")]
    out = {r["payment_id"]: r for r in run_stream(spark, [first, [("p9", "x", 1500, "1.00", "US")], late,
                                                          SENTINEL]).collect()}
    assert sorted(out) == ["p1", "p2", "p4", "p9"]
    from ledgerflow.streaming.monitor import rows_dropped_by_watermark, rows_processed
    assert rows_dropped_by_watermark(LAST_QUERY[0]) == 1          # p3
    assert rows_processed(LAST_QUERY[0]) == 6
    assert not any(r["late"] for r in out.values())
    assert out["p2"]["previous_country"] == "US" and out["p2"]["velocity_count"] == 1


def test_idle_customers_are_evicted_only_when_asked(spark):
    first = [("p1", "c", 0, "100.00", "US")]
    later = [("p2", "c", 5000, "10.00", "GB")]          # returns after 5000 s
    filler = [("p3", "x", 3000, "1.00", "US")]
    keep = {r["payment_id"]: r for r in run_stream(spark, [first, filler, later, SENTINEL]).collect()}
    assert keep["p2"]["previous_country"] == "US" and str(keep["p2"]["avg_prior_amount"]) == "100.00"
    gone = {r["payment_id"]: r for r in run_stream(spark, [first, filler, later, SENTINEL],
                                                   idle_ttl_seconds=600).collect()}
    assert gone["p2"]["previous_country"] is None and gone["p2"]["avg_prior_amount"] is None
