"""What a micro-batch of the replayed streams does once, and what it keeps away from the driver."""

from datetime import timedelta

from pyspark.sql import functions as F

from ledgerflow.operators import process as P
from ledgerflow.streaming.effectively_once import AcceptSink, CommitLog, ProcessingSink
from ledgerflow.streaming.staging import replay_in_order, run_folder

from helpers import T0

ADAPTIVE = "spark.sql.adaptive.autoBroadcastJoinThreshold"


class SpyLog(CommitLog):
    """Notes the broadcast limit that each output is planned with."""

    def __init__(self, spark, root):
        super().__init__(spark, root)
        self.limits = {}

    def write(self, name, df, batch_id):
        self.limits[name] = df.sparkSession.conf.get(ADAPTIVE, None)
        super().write(name, df, batch_id)


def test_a_replay_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(i):
        made.add(1)
        return i

    rows = spark.range(40).select(F.udf(count, "bigint")("id").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("d"), "id")
    rows = rows.select("v", (F.lit(T0) + F.make_interval(secs=F.when(F.col("id") > 0, F.col("id") + F.col("d")))).alias("at"))
    root, seen = run_folder(spark, "replay-test"), []

    def drain():
        seen.append({(r["v"], r["at"]) for r in spark.read.parquet(root).collect()})

    width = replay_in_order(rows, "at", root, 4, drain, files=3)
    assert made.value <= 80                                                # for the bounds, and for the rows
    got = [now - before for before, now in zip([set(), *seen], seen)]
    assert sum(map(len, got)) == len(seen[-1]) == 79                       # both copies of row 0 have no time
    assert (0, None) in got[0]
    lo = T0 + timedelta(seconds=1)
    assert all((at - lo) // timedelta(microseconds=width) == i for i, part in enumerate(got) for _, at in part if at)
    assert len(spark.read.parquet(root).inputFiles()) == 12


def test_a_replay_of_no_rows_drains_once(spark):
    root, drains = run_folder(spark, "replay-test"), []
    replay_in_order(spark.createDataFrame([], "v bigint, at timestamp"), "at", root, 4, lambda: drains.append(1))
    assert drains == [1] and spark.read.schema("v bigint, at timestamp").parquet(root).count() == 0


def test_found_events_and_orphans_come_from_one_held_frame(spark, ds):
    held = []
    P.process(ds.deliveries, ds.stored_payments, ds.claimed, hold=lambda df: held.append(df.columns) or df)
    assert sum("_found" in columns for columns in held) == 1


def test_micro_batches_send_no_join_side_through_the_driver(spark, ds):
    before = spark.conf.get(ADAPTIVE, None)
    some = F.col("request_id") < 50
    accept = AcceptSink(spark, run_folder(spark, "steps-test"))
    accept.log = SpyLog(spark, accept.log.root)
    accept(ds.requests.filter(some), 0)
    root = run_folder(spark, "steps-test")
    log = SpyLog(spark, root)
    ProcessingSink(spark, root, ds.stored_payments, ds.claimed, log=log)(ds.deliveries.filter(F.col("offset") < 20), 0)
    for limits in (accept.log.limits, log.limits):
        assert limits and set(limits.values()) == {"-1"}
    assert spark.conf.get(ADAPTIVE, None) == before
