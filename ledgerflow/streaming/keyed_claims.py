"""Claims in keyed state (T2, K4, J2, T6, T7, T8): the processed-events table is the stream's own state.

Deliveries are decoded, looked up (payment, decision) and keyed by a hash bucket of the
event id. The state of a bucket is the list of its claims, on RocksDB, and never expires;
claims that exist before the stream starts are its initial state. No micro-batch reads a
claims table: a delivery only meets the claims of its own bucket. A bucket costs a few
calls to the state store, however many events of it a micro-batch brings; with a key per
event id those calls took most of the run. The list is only appended to: which events a
bucket has is also told by one value, as reading a list back costs a call's work for each of
its claims, in every micro-batch. Through the keyed step go the claim key and what a claim
tells; the rest of a record passes as one text. The claim and its outcome leave in one row.

A delivery without a payment or a decision, or one that can't be decoded, claims nothing.
It goes to the retry folder, a second source of the same stream, with its next attempt and
time (1, 2, 4 s), and is a dead letter after the fourth. A retry is looked up anew.

Micro-batches are written through the commit log, as those of ``effectively_once``; the
state is committed with the micro-batch, so one that is run again meets the claims as
they were before it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import schemas as S
from ..operators import process as P
from ..session import STATE_STORE, scoped_conf
from .effectively_once import CommitLog

_RECORD = ("topic string, partition int, offset bigint, key string, attempt int, next_attempt_at timestamp, "
           "delivered_at timestamp, value string")
FATES = f"event_id string, fate string, payment_id string, decision string, risk_score double, reasons array<string>, reason string, {_RECORD}"
_fate = Row("fate", "record")
_CLAIM = "event_id string, processed_at timestamp, decision string"
#: What passes the keyed step as JSON: times as microseconds.
_PASSED = FATES.replace(" fate string,", "").replace("timestamp", "bigint")
#: Buckets of event ids; the checkpoint keeps them, so a stream has the same number for life.
BUCKETS = 1 << 14
DELIVERY = _RECORD

PROCESSED, DUPLICATE, FAILED = "processed", "duplicate", "failed"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class Claims(StatefulProcessor):
    """A list state per bucket of event ids: which were claimed, when, and with which decision; and the ids alone."""

    def init(self, handle) -> None:
        self.claim, self.ids = handle.getListState("claim", _CLAIM), handle.getValueState("ids", "ids binary")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for row in [initialState] if isinstance(initialState, Row) else initialState:
            self._add([(c["event_id"], _at(c.get("us")), None) for c in json.loads(row.claims)], self._known())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, first = self._known(), {}
        claimed = set(known)
        for r in rows:
            if r.claim_key in claimed:                      # null where the record has no event id
                yield _fate(DUPLICATE, r.record)
            elif r.failing:                                 # can't be processed: no claim
                yield _fate(FAILED, r.record)
            elif (best := first.get(r.claim_key)) is None or _order(r) < _order(best):
                if best is not None:
                    yield _fate(DUPLICATE, best.record)
                first[r.claim_key] = r
            else:
                yield _fate(DUPLICATE, r.record)
        if first:
            self._add([(k, _at(r.us), r.decision) for k, r in first.items()], known)
        for r in first.values():
            yield _fate(PROCESSED, r.record)

    def _known(self) -> list[str]:
        told = self.ids.get()
        return json.loads(bytes(told[0])) if told is not None else []

    def _add(self, claims: list[tuple], known: list[str]) -> None:
        self.claim.appendList(claims)
        self.ids.update((json.dumps(known + [c[0] for c in claims]).encode(),))


def _at(us: int | None) -> datetime | None:
    return None if us is None else _EPOCH + timedelta(microseconds=us)


def _order(r: Row) -> tuple:
    record = json.loads(r.record)
    return tuple(record.get(c) for c in ("delivered_at", "topic", "partition", "offset"))        # nulls are left out


def fates(deliveries: DataFrame, payments: DataFrame, decisions: DataFrame, claimed: DataFrame) -> DataFrame:
    """The fate of every delivery of a stream. ``decisions`` has ``payment_id, decision, risk_score, reasons``;
    ``claimed`` (``event_id, processed_at``) is read once, when the stream first starts."""
    decoded = P.decode_events(deliveries)
    found = payments.select("payment_id", F.lit(True).alias("_found"))
    looked_up = P.table_decider(decisions)(decoded.join(found, "payment_id", "left"))
    reason = (F.when(F.col("decode_error").isNotNull(), F.col("decode_error"))
              .when(F.col("_found").isNull(), F.concat(F.lit(S.PAYMENT_NOT_FOUND), F.col("payment_id")))
              .when(~F.coalesce(F.col("decision").isin(*S.DECISIONS), F.lit(False)),
                    F.concat(F.lit(S.REASON_NO_DECISION), F.col("payment_id"))))
    # a record that can't be read has no event id: it meets no claim, and its own place deals it to a bucket
    key = F.when(F.col("decode_error").isNull(), F.col("event_id"))
    told = {"risk_score": F.col("risk_score").cast("double"), "reason": reason,
            "delivered_at": F.unix_micros("delivered_at"), "next_attempt_at": F.unix_micros("next_attempt_at")}
    record = F.to_json(F.struct(*[told.get(n, F.col(n)).alias(n) for n in (c.split()[0] for c in _PASSED.split(", "))]))
    rows = looked_up.select(_bucket(F.coalesce(key, F.concat_ws("/", *P.RECORD))), key.alias("claim_key"), reason.isNotNull().alias("failing"),
                            told["delivered_at"].alias("us"), "decision", record.alias("record"))
    before = (claimed.filter(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.unix_micros(F.max("processed_at")).alias("us"))
              .groupBy(_bucket(F.col("event_id"))).agg(F.to_json(F.collect_list(F.struct("event_id", "us"))).alias("claims")))
    out = rows.groupBy("bucket").transformWithState(Claims(), "fate string, record string", "append", "none", before.groupBy("bucket"))
    r = out.select("fate", F.from_json("record", _PASSED).alias("r"))
    times = {c: F.timestamp_micros(f"r.{c}") for c in ("delivered_at", "next_attempt_at")}
    return r.select(*["fate" if n == "fate" else times.get(n, F.col(f"r.{n}")).alias(n) for n in (c.split()[0] for c in FATES.split(", "))])


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")


class ClaimSink:
    """``foreachBatch`` target of ``fates``: ``claims`` (claim and outcome in one row), ``duplicates``,
    ``failed`` and ``dead_letters`` tables, and the retry folder."""

    def __init__(self, spark: SparkSession, root: str, log: CommitLog | None = None):
        self.log = log or CommitLog(spark, f"{root}/out")
        self.retries = f"{root}/retries"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()                             # the stateful step runs once
        try:
            approved = F.col("decision") == S.DECISIONS[0]
            self.log.write("claims", batch.filter(F.col("fate") == PROCESSED).select(
                "event_id", F.col("delivered_at").alias("processed_at"), "payment_id",
                F.when(approved, S.STATUS_PROCESSED).otherwise(S.STATUS_BLOCKED).alias("status"), "decision", "risk_score", "reasons",
                F.when(approved, S.TOPIC_PROCESSED).otherwise(S.TOPIC_BLOCKED).alias("topic"),
                P.deterministic_uuid(F.col("event_id"), F.lit("outcome")).alias("outcome_event_id")), batch_id)
            self.log.write("duplicates", batch.filter(F.col("fate") == DUPLICATE).select(*P.RECORD, "event_id"), batch_id)
            failed = batch.filter(F.col("fate") == FAILED)
            self.log.write("dead_letters", P.exhausted(failed).drop("fate", "decision", "risk_score", "reasons"), batch_id)
            again = P.next_attempts(failed, F.coalesce("next_attempt_at", "delivered_at"))
            if not again.isEmpty():                         # an empty file would start another micro-batch
                again.select(*[c.split()[0] for c in _RECORD.split(", ")]).write.mode("overwrite").parquet(f"{self.retries}/batch-{batch_id}")
            self.log.commit(batch_id)
        finally:
            batch.unpersist()


CLAIM_OUTCOMES = ("event_id string, processed_at timestamp, payment_id string, status string, decision string, risk_score double, "
                  "reasons array<string>, topic string, outcome_event_id string")
DEAD_LETTERS = f"event_id string, payment_id string, reason string, {_RECORD.replace('value', 'payload')}"


class ClaimStream:
    """The stream over an input folder of deliveries. ``payments`` and ``decisions`` are functions that
    are called at each start, so that what has arrived since is found by retries."""

    def __init__(self, spark: SparkSession, root: str, payments: Callable[[], DataFrame], decisions: Callable[[], DataFrame],
                 claimed: DataFrame, log: CommitLog | None = None, partitions: int | None = None):
        self.spark, self.root, self.payments, self.decisions, self.claimed = spark, root, payments, decisions, claimed
        self.sink = ClaimSink(spark, root, log)
        self.log, self.last = self.sink.log, None
        self.partitions = partitions or spark.sparkContext.defaultParallelism
        spark.createDataFrame([], DELIVERY).write.mode("ignore").parquet(f"{self.sink.retries}/batch-none")

    def start(self, input_folder: str):
        """Start the query over what the folders hold by now."""
        reader = self.spark.readStream.schema(DELIVERY)
        fresh = reader.parquet(input_folder).withColumn("attempt", F.coalesce("attempt", F.lit(1)))
        both = fresh.unionByName(reader.parquet(f"{self.sink.retries}/*"))
        with scoped_conf(self.spark, **STATE_STORE, **{"spark.sql.shuffle.partitions": str(self.partitions)}):
            self.last = (fates(both, self.payments(), self.decisions(), self.claimed).writeStream.foreachBatch(self.sink)
                         .option("checkpointLocation", f"{self.root}/checkpoint").outputMode("append").trigger(availableNow=True).start())
        return self.last

    def finish(self, input_folder: str) -> int:
        """Run until no record waits for another attempt; returns the number of runs."""
        runs, before = 0, -1
        while before != (before := self.log.last()):
            self.start(input_folder).awaitTermination()
            runs += 1
        return runs
