"""Order per key, pending ids as bitmaps, rates as streams, mergeable sketches."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerflow.operators import metrics as M
from ledgerflow.operators import sequence as SQ
from ledgerflow.operators.pending_bits import PendingIds
from ledgerflow.streaming.rates import RateRun
from ledgerflow.streaming.staging import run_folder

T0 = datetime(2026, 1, 1)


def test_numbers_and_audit_on_shuffled_input_with_a_hot_key(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", f"k{rnd.randrange(20)}", None]), T0 + timedelta(seconds=rnd.randrange(50)), i) for i in range(3000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at timestamp, id long").repartition(7)
    got = {(r.key, r.id): r.seq for r in SQ.sequenced(df, "key", ["at", "id"]).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]), 1):
            want[key, i] = n
    assert got == want


def test_lanes_hold_each_key_in_order(spark, tmp_path):
    df = spark.range(400).select(F.concat(F.lit("k"), F.col("id") % 7).alias("key"), F.col("id").alias("at")).repartition(5)
    SQ.write_lanes(SQ.sequenced(df, "key", ["at"]), f"{tmp_path}/lanes", "key", lanes=3)
    seen, lane_of = {}, {}
    for lane in range(3):
        for r in spark.read.parquet(f"{tmp_path}/lanes").filter(F.col("lane") == lane).collect():
            assert r.seq == seen.get(r.key, 0) + 1 and lane_of.setdefault(r.key, lane) == lane
            seen[r.key] = r.seq
    assert sum(seen.values()) == 400


def test_audit_tells_gaps_repeats_and_inversions(spark):
    rows = [("ok", i, i) for i in range(1, 6)] + [("gap", 1, 1), ("gap", 2, 4)] + [("twice", 1, 1), ("twice", 2, 1)] + \
        [("turned", 1, 2), ("turned", 2, 1), ("turned", 3, 3)]
    out = SQ.order_audit(spark.createDataFrame(rows, "key string, at int, seq int"), "key", ["at"])
    assert {r.key: (r.rows, r.gaps, r.repeats, r.inversions) for r in out.collect()} == {
        "ok": (5, 0, 0, 0), "gap": (2, 2, 0, 0), "twice": (2, 0, 1, 1), "turned": (3, 0, 0, 1)}


def test_pending_ids_scan_open_buckets_only(spark):
    box = PendingIds(spark, run_folder(spark, "bits-test"))
    rows = spark.range(1, 100_001).select("id", F.concat(F.lit("e"), "id").alias("event_id"))
    box.append(rows.filter("id <= 70000"), 0)
    box.append(rows.filter("id > 70000"), 1)
    schema = "id bigint, event_id string"
    assert box.low_water() == 1 and box.pending(schema).count() == 100_000
    box.publish(rows.filter("id <= 65000 and id % 2 = 0").select("id"), 0)
    box.publish(rows.filter("id <= 65000 and id % 2 = 1 or id in (66000, 99000)").select("id"), 1)
    box.publish(rows.filter("id in (66000, 99000)").select("id"), 1)                     # run again
    assert box.low_water() == 1
    # the second run of batch 1 replaced its stamps: odd ids are pending again
    assert box.pending(schema).count() == 100_000 - 32_500 - 2
    box.publish(rows.filter("id <= 65000").select("id"), 2)
    assert box.low_water() == 2
    left = box.pending(schema)
    assert {r.id for r in left.select("id").collect()} == set(range(65_001, 100_001)) - {66_000, 99_000}
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "(bucket#" in plan.split("PartitionFilters")[1] and ">= 2" in plan.split("PartitionFilters")[1]
    box.publish(rows.select("id"), 3)
    assert box.low_water() is None and box.pending(schema).count() == 0


def test_a_batch_without_marker_is_not_seen(spark):
    box = PendingIds(spark, run_folder(spark, "bits-test"))
    box.append(spark.range(1, 11).withColumn("event_id", F.lit("e")), 0)
    box.rows.commit = lambda n: None
    box.append(spark.range(11, 21).withColumn("event_id", F.lit("e")), 1)
    assert box.pending("id bigint, event_id string").count() == 10


def test_rates_count_late_rows(spark):
    rows = [(T0 + timedelta(seconds=s), "A" if s % 2 else "B") for s in range(0, 4000, 7)]
    run = RateRun(spark, spark.createDataFrame(rows, "at timestamp, status string"), "at", ["status"])
    got = {(r.window_start, r.status): r.events for r in run.close().collect()}
    want = {}
    for t, status in rows:
        start = T0 + timedelta(seconds=(t - T0).total_seconds() // 10 * 10)
        for k in range(6):
            want[start - timedelta(seconds=10 * k), status] = want.get((start - timedelta(seconds=10 * k), status), 0) + 1
    assert got == want and run.late == 0
    run.add(spark.createDataFrame([(T0, "A")], "at timestamp, status string"))
    run.drain()
    assert run.late == 6 and {(r.window_start, r.status): r.events for r in run.windows().collect()} == want


def test_sketches_roll_up_within_a_hundredth(spark):
    df = spark.range(60_000).select(F.timestamp_seconds(F.col("id") % 7200).alias("ts"), (F.rand(3) * F.rand(4)).alias("v"))
    sketches = M.quantile_sketches(df.unionAll(df.limit(5).withColumn("v", F.lit(None).cast("double"))), "ts", "v")
    assert sketches.count() == 120
    errors = M.rank_errors(df, "ts", "v", M.rolled_up(sketches, "hour"), "hour").collect()
    assert len(errors) == 2 and sum(r.n for r in errors) == 60_000 and all(max(r.p50_error, r.p95_error, r.p99_error) <= 0.01 for r in errors)
