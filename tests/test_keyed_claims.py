"""Claims in keyed state: crash and restart, earlier claims, retries, and what the stream reads."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerflow.plans.q_stream import _processing_run, claim_run
from ledgerflow.streaming import keyed_claims
from ledgerflow.streaming.effectively_once import CLAIMS
from ledgerflow.streaming.keyed_claims import CLAIM_OUTCOMES, DEAD_LETTERS, ClaimStream
from ledgerflow.streaming.staging import run_folder

from helpers import T0, crash_once
from test_process_cases import deliveries, event, no_claims, stored


def verdicts_of(spark):
    return spark.createDataFrame([("p1", "APPROVE", 0.0, ["x"]), ("p2", "BLOCK", 0.9, ["x"])],
                                 "payment_id string, decision string, risk_score double, reasons array<string>")


def outcomes(stream):
    return sorted((r.event_id, r.decision) for r in stream.log.committed("claims", CLAIM_OUTCOMES).collect())


def test_a_crash_before_the_marker_changes_nothing(spark, ds):
    crashed = claim_run(ds, log=crash_once(1))
    rows = crashed.log.committed("claims", CLAIM_OUTCOMES)
    seen = rows.join(ds.claimed.select("event_id"), "event_id", "left_semi").count()
    assert rows.count() == rows.select("event_id").distinct().count() == 877 and seen == 0
    # the state holds the earlier claims and the new ones, and the stream's sources are the two folders
    progress = crashed.last.lastProgress or crashed.last.recentProgress[-1]
    assert {s["description"].split("/")[-1].rstrip("]") for s in progress["sources"]} == {"input", "*"}
    state = spark.read.format("statestore").option("stateVarName", "claim").load(f"{crashed.root}/checkpoint")
    assert state.count() == rows.count() + ds.claimed.count()


def test_an_event_is_claimed_once_across_micro_batches_and_copies(spark):
    root = run_folder(spark, "claims-test")
    pays, verdicts = stored(spark, "p1", "p2"), verdicts_of(spark)
    stream = ClaimStream(spark, root, lambda: pays, lambda: verdicts, no_claims(spark), partitions=2)
    first = deliveries(spark, [event("e1", "p1"), event("e1", "p1"), event("e2", "p2"), "{bad"])
    first.write.parquet(f"{root}/input/a")
    stream.start(f"{root}/input/*").awaitTermination()
    assert outcomes(stream) == [("e1", "APPROVE"), ("e2", "BLOCK")]
    deliveries(spark, [event("e1", "p1"), event("e3", "p9")]).withColumn("offset", F.col("offset") + 100).write.parquet(f"{root}/input/b")
    stream.finish(f"{root}/input/*")
    assert outcomes(stream) == [("e1", "APPROVE"), ("e2", "BLOCK")]
    dead = stream.log.committed("dead_letters", DEAD_LETTERS).collect()
    assert sorted((r.attempt, r.reason[:12]) for r in dead) == [(4, "Payment not "), (4, "Unparseable ")]
    assert stream.log.committed("duplicates", "event_id string").count() == 2


def test_a_payment_that_arrives_between_two_attempts_is_found(spark):
    root = run_folder(spark, "claims-test")
    here, verdicts = [stored(spark, "p1")], verdicts_of(spark)
    stream = ClaimStream(spark, root, lambda: here[0], lambda: verdicts, no_claims(spark), partitions=2)
    deliveries(spark, [event("e1", "p1"), event("e2", "p2")]).write.parquet(f"{root}/input")
    stream.start(f"{root}/input").awaitTermination()
    assert outcomes(stream) == [("e1", "APPROVE")]
    here[0] = stored(spark, "p1", "p2")
    stream.finish(f"{root}/input")
    assert outcomes(stream) == [("e1", "APPROVE"), ("e2", "BLOCK")]
    assert stream.log.committed("dead_letters", DEAD_LETTERS).count() == 0


def test_the_table_form_survives_a_crash_too(spark, ds):
    log = _processing_run(ds, log=crash_once(1000))
    claims = log.committed("claims", CLAIMS)
    assert claims.count() == claims.select("event_id").distinct().count() == 877
    outs = log.committed("outcome_outbox", "aggregate_id string")
    assert outs.count() == outs.distinct().count() == 877


def test_events_of_one_bucket_keep_their_claims_apart(spark, monkeypatch):
    monkeypatch.setattr(keyed_claims, "BUCKETS", 1)
    root = run_folder(spark, "claims-test")
    ids = [f"p{i}" for i in range(40)]
    verdicts = spark.createDataFrame([(p, "APPROVE", 0.0, ["x"]) for p in ids], "payment_id string, decision string, risk_score double, reasons array<string>")
    before = spark.createDataFrame([("e0", T0), ("e0", T0), ("e1", T0), (None, T0)], "event_id string, processed_at timestamp")
    pays = stored(spark, *ids)
    stream = ClaimStream(spark, root, lambda: pays, lambda: verdicts, before, partitions=2)
    deliveries(spark, [event(f"e{i}", f"p{i}") for i in range(20)] * 2 + ["{bad", "{bad"]).write.parquet(f"{root}/input/a")
    stream.start(f"{root}/input/*").awaitTermination()
    assert outcomes(stream) == sorted((f"e{i}", "APPROVE") for i in range(2, 20))
    assert stream.log.committed("duplicates", "event_id string").count() == 22
    deliveries(spark, [event(f"e{i}", f"p{i}") for i in range(40)]).withColumn("offset", F.col("offset") + 1000).write.parquet(f"{root}/input/b")
    stream.finish(f"{root}/input/*")
    assert outcomes(stream) == sorted((f"e{i}", "APPROVE") for i in range(2, 40))
    assert stream.log.committed("duplicates", "event_id string").count() == 42
    assert stream.log.committed("dead_letters", DEAD_LETTERS).count() == 2
    state = spark.read.format("statestore").option("stateVarName", "claim").load(f"{root}/checkpoint")
    assert state.select("key").distinct().count() == 1 and state.count() == 40


class Kept:
    """A state variable in memory; the list of claims may not be read back."""

    def __init__(self):
        self.value, self.rows = None, []

    def getListState(self, name, schema):
        return self

    getValueState = getListState

    def appendList(self, rows):
        self.rows += rows

    def update(self, value):
        self.value = value

    def get(self):
        return self.value


def test_claims_are_told_by_one_value_and_rows_pass_as_one_text(spark):
    """Reading a bucket's list in every micro-batch, and all columns of a record, made 6 GB run out of time."""
    state, claims = Kept(), keyed_claims.Claims()
    claims.init(state)
    row = Row("claim_key", "failing", "us", "decision", "record")
    at = lambda n: f'{{"topic":"t","partition":0,"offset":{n},"delivered_at":{n}}}'
    before = Row("bucket", "claims")(1, '[{"event_id":"a\\nb","us":0},{"event_id":"e0"}]')
    list(claims.handleInitialState((1,), before, None) or [])
    told = [[(r.fate, r.record) for r in claims.handleInputRows((1,), iter(rows), None)] for rows in (
        [row("e1", False, 9, "APPROVE", at(9)), row("e1", False, 5, "BLOCK", at(5)), row("e0", False, 1, "APPROVE", at(1)), row(None, True, 1, None, at(7))],
        [row("e1", False, 2, "APPROVE", at(2)), row("a\nb", True, 2, "APPROVE", at(3)), row("e2", True, 2, None, at(4))])]
    assert told == [[("duplicate", at(9)), ("duplicate", at(1)), ("failed", at(7)), ("processed", at(5))],
                    [("duplicate", at(2)), ("duplicate", at(3)), ("failed", at(4))]]
    assert [(c[0], c[2]) for c in state.rows] == [("a\nb", None), ("e0", None), ("e1", "BLOCK")]
    assert [c[1] and c[1].microsecond for c in state.rows] == [0, None, 5]


def test_a_record_is_whole_behind_the_keyed_step(spark):
    root = run_folder(spark, "claims-test")
    odd = spark.createDataFrame([("p1", "BLOCK", float("nan"), ['a "quoted"\n', None, "é🙂"])],
                                "payment_id string, decision string, risk_score double, reasons array<string>")
    pays = stored(spark, "p1")
    stream = ClaimStream(spark, root, lambda: pays, lambda: odd, no_claims(spark), partitions=2)
    deliveries(spark, [event("e1", "p1"), '{bad \\ " ']).write.parquet(f"{root}/input")
    stream.start(f"{root}/input").awaitTermination()
    stream.finish(f"{root}/input")
    (got,) = stream.log.committed("claims", CLAIM_OUTCOMES).collect()
    assert got.reasons == ['a "quoted"\n', None, "é🙂"] and got.risk_score != got.risk_score
    sent = {r.value: r for r in spark.read.parquet(f"{root}/input").collect()}
    assert got.processed_at in {r.delivered_at for r in sent.values()}
    (dead,) = stream.log.committed("dead_letters", DEAD_LETTERS).collect()
    assert (dead.topic, dead.offset, dead.payload, dead.delivered_at) == (
        sent[dead.payload].topic, sent[dead.payload].offset, '{bad \\ " ', sent[dead.payload].delivered_at)


def test_copies_without_a_time_are_claimed_once(spark):
    root = run_folder(spark, "claims-test")
    pays, verdicts = stored(spark, "p1"), verdicts_of(spark)
    stream = ClaimStream(spark, root, lambda: pays, lambda: verdicts, no_claims(spark), partitions=2)
    rows = deliveries(spark, [event("e1", "p1")] * 3)
    rows.withColumn("delivered_at", F.lit(None).cast("timestamp")).write.parquet(f"{root}/input")
    stream.start(f"{root}/input").awaitTermination()
    (got,) = stream.log.committed("claims", CLAIM_OUTCOMES).collect()
    assert got.event_id == "e1" and got.processed_at is None and stream.log.committed("duplicates", "event_id string").count() == 2
