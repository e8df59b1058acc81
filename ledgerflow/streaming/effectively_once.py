"""Effectively-once processing of an at-least-once stream.

``foreachBatch`` runs the batch plan on each micro-batch. Every output is
written to a ``batch_id=<n>`` partition with overwrite, and a commit marker is
written last. Readers only see batches with a marker. When a batch is replayed
after a crash (its outputs may be half written, its marker absent, or the
checkpoint not yet advanced), the rerun overwrites the same partitions, so
nothing is lost and nothing is doubled. State that must never expire (claimed
event ids, created payments) lives in these tables, outside the stream, and is
read back as "committed batches other than this one".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import process as P
from ..session import NO_BROADCAST, scoped_conf


class CommitLog:
    """Tables written per batch under ``root`` plus the ``_commits`` marker table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        fs = hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(hpath)

    def write(self, name: str, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={batch_id}")

    def commit(self, batch_id: int) -> None:
        marker = self.spark.range(1).select(F.lit(batch_id).cast("bigint").alias("committed"))
        marker.write.mode("overwrite").parquet(f"{self.root}/_commits/batch_id={batch_id}")

    def committed(self, name: str, schema: str, exclude: int | None = None) -> DataFrame:
        """Rows of ``name`` from committed batches (optionally without one batch), read
        with the declared ``schema``."""
        schema = f"{schema}, batch_id bigint"
        if not (self._exists(f"{self.root}/{name}") and self._exists(f"{self.root}/_commits")):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        marks = self.spark.read.schema("committed bigint, batch_id bigint").parquet(f"{self.root}/_commits").select("batch_id")
        out = rows.join(F.broadcast(marks), "batch_id", "left_semi")       # a row a batch
        if exclude is not None:
            out = out.filter(F.col("batch_id") != exclude)
        return out

    def last(self, before: int | None = None) -> int | None:
        """The latest committed batch, or the latest before one."""
        if not self._exists(f"{self.root}/_commits"):
            return None
        marks = self.spark.read.schema("committed bigint").parquet(f"{self.root}/_commits")
        return (marks if before is None else marks.filter(F.col("committed") < before)).agg(F.max("committed")).first()[0]

    def of_batch(self, name: str, schema: str, batch_id: int | None) -> DataFrame:
        """Rows of ``name`` that one batch has written."""
        path = f"{self.root}/{name}/batch_id={batch_id}"
        if batch_id is None or not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)


CLAIMS = ("event_id string, processed_at timestamp, customer_id string, delivered_at timestamp, "
          "amount decimal(19,4), country string")
QUEUE = ("topic string, partition int, offset bigint, key string, attempt int, next_attempt_at timestamp, "
         "delivered_at timestamp, value string, reason string")
DEAD = QUEUE.replace("value string", "payload string")
UPDATES = ("payment_id string, status string, fraud_decision string, risk_score decimal(4,3), "
           "fraud_reasons string, updated_at timestamp")
# Batch n of the stream is committed as n * STEP; the numbers between are for ``drain``.
STEP = 1000


class ProcessingSink:
    """``foreachBatch`` target for the deliveries stream (K9 + T2 + T6 + T7 + T8).

    Claims never expire, so the claims table only grows. Each batch first narrows it
    to the batch's own event ids, and to its customers for their history (semi joins,
    none of them broadcast).

    A failing record goes to the retry queue and enters a later batch when its time
    has come, by the event time of that batch; after its last attempt it is a dead
    letter, with its payload. The queue is rewritten by each batch and only the last
    committed one is read. ``payments`` may be a function, which is called for every
    batch, so that a payment that arrives between two attempts is found. ``drain``
    works off what is still queued when the input has ended.
    """

    def __init__(self, spark: SparkSession, root: str, payments: DataFrame | Callable[[], DataFrame], claimed: DataFrame,
                 decider: P.Decider | None = None, log: CommitLog | None = None):
        self.log = log or CommitLog(spark, root)
        self.payments = payments if callable(payments) else lambda: payments
        self.claimed = claimed
        self.decider = decider

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumns({"attempt": F.lit(1), "next_attempt_at": F.lit(None).cast("timestamp")}).persist()
        try:
            clock = batch.agg(F.max("delivered_at")).first()[0]
            self._process(batch, batch_id * STEP, F.lit(clock).cast("timestamp"))
        finally:
            batch.unpersist()

    def drain(self) -> int:
        """Give every queued record its remaining attempts; returns the number of rounds."""
        rounds = 0
        while True:
            last = self.log.last()
            queue = self.log.of_batch("retry_queue", QUEUE, last)
            clock = queue.agg(F.max("next_attempt_at")).first()[0]
            if clock is None:
                return rounds
            self._process(queue.limit(0), last + 1, F.lit(clock).cast("timestamp"))
            rounds += 1

    def _process(self, batch: DataFrame, batch_id: int, clock) -> None:
        queue = self.log.of_batch("retry_queue", QUEUE, self.log.last(before=batch_id))
        due = F.coalesce(F.col("next_attempt_at") <= clock, F.lit(False))
        records = batch.unionByName(queue.filter(due), allowMissingColumns=True)
        claims = self.log.committed("claims", CLAIMS, exclude=batch_id).drop("batch_id")
        claimed = self.claimed.unionByName(claims, allowMissingColumns=True)
        held: list[DataFrame] = []
        try:
            with scoped_conf(batch.sparkSession, **NO_BROADCAST):
                self._write(batch_id, queue, due, claimed, records, held)
        finally:
            for df in held:
                df.unpersist()

    def _write(self, batch_id, queue, due, claimed, records, held) -> None:
        def hold(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return df

        decoded = hold(P.decode_events(records))
        ids = decoded.select("event_id").distinct()
        r = P.process(records, self.payments(), claimed.join(ids, "event_id", "left_semi"), self.decider,
                      history=claimed if set(P.EVALUATED) <= set(claimed.columns) else None, hold=hold, decoded=decoded)
        self.log.write("claims", r.claims, batch_id)
        self.log.write("outcome_outbox", r.outcome_outbox, batch_id)
        self.log.write("payment_updates", r.payment_updates, batch_id)
        self.log.write("duplicates", r.duplicates.select(*P.RECORD), batch_id)
        self.log.write("failed", r.failed, batch_id)
        failed = self.log.of_batch("failed", QUEUE, batch_id)
        tried_at = F.coalesce("next_attempt_at", "delivered_at")
        self.log.write("dead_letters", P.exhausted(failed), batch_id)
        self.log.write("retry_queue", P.next_attempts(failed, tried_at).unionByName(queue.filter(~due)), batch_id)
        self.log.commit(batch_id)


def current_payments(log: CommitLog, payments: DataFrame) -> DataFrame:
    """K5: the payments table with every committed update applied, the last one of each payment."""
    updates = log.committed("payment_updates", UPDATES)
    columns = [c for c in updates.columns if c not in ("payment_id", "batch_id")]
    last = updates.groupBy("payment_id").agg(F.max_by(F.struct(*columns), F.struct("updated_at", "batch_id")).alias("u"))
    return P.apply_updates(payments, last.select("payment_id", "u.*"))


class TriageSink:
    """``foreachBatch`` target for the stateful triage stream (T1, with ``keep_late``):
    features of folded rows go to ``features``, rows that came too late to be folded
    to ``late_rows``; every input row lands in one of them."""

    def __init__(self, spark: SparkSession, root: str):
        self.log = CommitLog(spark, root)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()                              # the stateful step runs once
        try:
            self.log.write("features", batch.filter(~F.col("late")), batch_id)
            self.log.write("late_rows", batch.filter(F.col("late")), batch_id)
            self.log.commit(batch_id)
        finally:
            batch.unpersist()


PAYMENTS = ("payment_id string, idempotency_key string, amount decimal(19,4), currency string, customer_id string, "
            "card_last4 string, country string, merchant string, status string, created_at timestamp")
ANSWERS = ("request_id bigint, idempotency_key string, payment_id string, accept_result string, status string, "
           "received_at timestamp")


class AcceptSink:
    """``foreachBatch`` target for the request stream (T3): first valid request per
    key creates the payment (and its outbox row) unless a committed batch already
    created it; every valid request gets an answer row, rejected requests are kept
    with their violations. Committed payments are narrowed to the batch's keys first
    (as in ``ProcessingSink``).

    The TTL of a key runs from the last time its answer was cached, which the
    committed answers tell: the creation, or the last answer from the table."""

    def __init__(self, spark: SparkSession, root: str):
        self.log = CommitLog(spark, root)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        held = [batch := batch.persist()]

        def hold(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return df

        try:
            with scoped_conf(batch.sparkSession, **NO_BROADCAST):
                self._write(batch, batch_id, hold)
        finally:
            for df in held:
                df.unpersist()

    def _write(self, batch: DataFrame, batch_id: int, hold: Callable[[DataFrame], DataFrame]) -> None:
        keys = batch.select("idempotency_key").filter(F.col("idempotency_key").isNotNull()).distinct()
        before = (self.log.committed("payments", PAYMENTS, exclude=batch_id)
                  .select("idempotency_key", "payment_id", "status", "created_at"))
        answered = self.log.committed("answers", ANSWERS, exclude=batch_id)
        cached = (answered.filter(F.col("accept_result").isin("created", "idempotent_db"))
                  .join(keys, "idempotency_key", "left_semi")
                  .groupBy("idempotency_key").agg(F.max("received_at").alias("_cached")))
        relevant = (keys.join(before, "idempotency_key").join(cached, "idempotency_key", "left")
                    .withColumn("created_at", F.coalesce("_cached", "created_at")).drop("_cached"))
        out = I.ingest_batch(batch, existing=hold(relevant), hold=hold)
        times = batch.groupBy("request_id").agg(F.min("received_at").alias("received_at"))
        self.log.write("payments", out.payments, batch_id)
        self.log.write("outbox", out.outbox, batch_id)
        self.log.write("rejected", out.rejected, batch_id)
        self.log.write("answers", out.answers.join(times, "request_id"), batch_id)
        self.log.commit(batch_id)


def run_until_done(start: Callable[[], object], retries: int = 3, partitions: int | None = None) -> int:
    """Start a stream, and restart it from its checkpoint after a failure.

    Returns the number of restarts. ``start`` must build the query on the same
    checkpoint location every time. ``partitions`` sets the shuffle partitions
    the query is started with (the query keeps a copy of the session options;
    stateful operators keep the number in their checkpoint).
    """
    restarts = 0
    while True:
        if partitions:
            spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
            with scoped_conf(spark, **{"spark.sql.shuffle.partitions": str(partitions)}):
                query = start()
        else:
            query = start()
        try:
            query.awaitTermination()
            return restarts
        except Exception:
            restarts += 1
            if restarts > retries:
                raise
