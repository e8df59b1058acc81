"""Payment-domain tables derived from the driver's ``events`` table.

The test datasets hold no payments, so every business table used by the
engine is derived from ``events.parquet`` by a fixed rule (one payment per
event, dirty intake requests, at-least-once deliveries, ...). The rules use
``event_id`` arithmetic to decide *which scenario* a row plays (a replay, a
malformed payload, a missing row); every view still covers the whole table,
so the work of every query grows with the input.

The same rules are written in DuckDB SQL in ``ledgerflow.plans.oracle_views``
for the independent oracle.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .tables import read_table


def _k() -> Column:
    return F.get_json_object("props", "$.k").try_cast("int")


def _country(k: Column) -> Column:
    return (F.when(k < 94, "US").when(k < 97, "GB").when(k < 99, "DE"))


def _card(k: Column) -> Column:
    return F.when(k % 2 == 0, F.lit(None).cast("string")).otherwise(
        F.lpad(((k * 101) % 10000).cast("string"), 4, "0"))


def _cents(value: Column) -> Column:
    return F.round(value * 100, 2).cast(schemas.AMOUNT)


def _requested_event() -> Column:
    """JSON of a payment's requested event."""
    eid = F.col("event_id").cast("string")
    return F.to_json(F.struct(
        F.concat(F.lit("e"), eid).alias("eventId"), F.col("payment_id").alias("paymentId"),
        F.concat(F.lit("key-"), eid).alias("idempotencyKey"), "amount", "currency",
        F.col("customer_id").alias("customerId"), F.col("card_last4").alias("cardLast4"), "country", "merchant"),
        {"ignoreNullFields": "false"})


class Dataset:
    """Lazy DataFrames of one dataset folder. Nothing is cached or collected."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def base(self) -> DataFrame:
        return self.table("events").select(
            "event_id", "ts", "user_id", "event_type", "value", _k().alias("k"))

    @cached_property
    def payments(self) -> DataFrame:
        """Clean triage input: one payment per event."""
        b = self.base
        return b.select(
            F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("payment_id"),
            "event_id",
            F.col("ts").cast("timestamp").alias("created_at"),
            F.col("user_id").cast("string").alias("customer_id"),
            F.greatest(_cents(F.col("value")),
                       F.lit(Decimal(schemas.MIN_AMOUNT)).cast(schemas.AMOUNT)).alias("amount"),
            F.lit("USD").alias("currency"),
            _card(F.col("k")).alias("card_last4"),
            _country(F.col("k")).alias("country"),
            F.col("event_type").alias("merchant"),
        )

    @cached_property
    def stored_payments(self) -> DataFrame:
        """The ``payments`` system-of-record table before processing.

        Every 53rd payment is missing, so deliveries for it become orphans.
        """
        p = self.payments
        return p.filter(F.col("event_id") % 53 != 0).select(
            "payment_id",
            F.concat(F.lit("key-"), F.col("event_id").cast("string")).alias("idempotency_key"),
            "amount", "currency", "customer_id", "card_last4", "country", "merchant",
            F.lit(schemas.STATUS_RECEIVED).alias("status"),
            F.lit(None).cast("string").alias("fraud_decision"),
            F.lit(None).cast(schemas.RISK_DECIMAL).alias("risk_score"),
            F.lit(None).cast("string").alias("fraud_reasons"),
            "created_at",
            F.col("created_at").alias("updated_at"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        """Dirty intake: replayed keys, missing keys and invalid bodies."""
        b = self.base
        eid = F.col("event_id")
        k = F.col("k")
        key = (F.when(eid % 97 == 0, F.lit(None).cast("string"))
               .when(eid % 10 == 7, F.concat(F.lit("far-"), F.col("user_id").cast("string")))
               .when(eid % 10 == 3, F.concat(F.lit("key-"), (eid - 3).cast("string")))
               .otherwise(F.concat(F.lit("key-"), eid.cast("string"))))
        amount = (F.when(eid % 103 == 7, F.lit(None).cast(schemas.AMOUNT))
                  .when(eid % 101 == 5, F.lit(0).cast(schemas.AMOUNT))
                  .otherwise(_cents(F.col("value"))))
        return b.select(
            eid.alias("request_id"),
            F.col("ts").cast("timestamp").alias("received_at"),
            key.alias("idempotency_key"),
            amount.alias("amount"),
            F.when(eid % 89 == 1, "usd").otherwise("USD").alias("currency"),
            F.when(eid % 83 == 4, "  ").otherwise(F.col("user_id").cast("string")).alias("customer_id"),
            F.when(eid % 79 == 6, "12a4").otherwise(_card(k)).alias("card_last4"),
            F.when(eid % 73 == 8, "usa").otherwise(_country(k)).alias("country"),
            F.col("event_type").alias("merchant"),
        )

    @cached_property
    def deliveries(self) -> DataFrame:
        """At-least-once deliveries of the ``payments.requested`` topic.

        Every payment is delivered once, every 7th twice, every 49th three
        times; every 61st payload is not valid JSON.
        """
        p = self.payments
        eid = F.col("event_id")
        copies = F.when(eid % 49 == 0, 3).when(eid % 7 == 0, 2).otherwise(1)
        payload = F.when(eid % 61 == 0, F.lit("{bad")).otherwise(_requested_event())
        d = F.explode(F.sequence(F.lit(1), copies)).alias("delivery")
        return p.select("event_id", "created_at", payload.alias("value"), d).select(
            F.lit(schemas.TOPIC_REQUESTED).alias("topic"),
            (F.col("event_id") % 4).cast("int").alias("partition"),
            (F.expr("event_id div 4") * 3 + F.col("delivery") - 1).alias("offset"),     # repeats across partitions
            F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("key"),
            "value",
            (F.col("created_at") + F.make_interval(secs=F.col("delivery") - 1)).alias("delivered_at"),
            "delivery",
        )

    @cached_property
    def claimed(self) -> DataFrame:
        """``processed_events`` as it stands before this run: every 11th event, with the
        transaction that was evaluated."""
        p = self.payments
        return p.filter(F.col("event_id") % 11 == 0).select(
            F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
            F.col("created_at").alias("processed_at"), "customer_id", F.col("created_at").alias("delivered_at"),
            "amount", "country")

    @cached_property
    def verdicts(self) -> DataFrame:
        """External model verdicts for every 3rd payment (some unusable)."""
        b = self.base
        eid = F.col("event_id")
        return b.filter(eid % 3 == 0).select(
            F.concat(F.lit("p"), eid.cast("string")).alias("payment_id"),
            F.when(eid % 9 == 0, "BLOCK").when(eid % 9 == 3, "APPROVE").alias("decision"),
            F.when(eid % 303 == 0, F.lit(float("nan"))).otherwise((eid % 131) / 100.0).alias("risk_score"),
            F.when(eid % 4 == 0, F.lit(None).cast("array<string>")).otherwise(
                F.array(F.concat(F.lit("model: pattern "), (eid % 5).cast("string")))).alias("reasons"),
        )

    @cached_property
    def http_log(self) -> DataFrame:
        """Gateway request log: status code and latency per request."""
        b = self.base
        status = (F.when((F.col("event_type") == "error") & (F.col("k") < 20), 500)
                  .when(F.col("event_id") % 97 == 0, 400).otherwise(202))
        return b.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                        status.alias("status"), F.col("value").alias("latency_ms"))

    @cached_property
    def outbox(self) -> DataFrame:
        """Outbox rows of the ``payments.requested`` topic, one per payment."""
        p = self.payments
        return p.select(
            (F.col("event_id") + 1).alias("id"),
            F.lit(schemas.AGGREGATE_TYPE).alias("aggregate_type"),
            F.col("payment_id").alias("aggregate_id"),
            F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
            F.lit(schemas.EVENT_TYPE_REQUESTED).alias("event_type"),
            F.lit(schemas.TOPIC_REQUESTED).alias("topic"),
            F.col("payment_id").alias("message_key"),
            _requested_event().alias("payload"),
            F.col("customer_id"),
            F.col("created_at"),
        )

    @cached_property
    def outbox_published(self) -> DataFrame:
        """Publish marks: every outbox row except every 5th one."""
        b = self.base
        return b.filter(F.col("event_id") % 5 != 0).select(
            F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
            F.expr("event_id div 100").alias("batch_id"),
            (F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 SECOND")).alias("published_at"))
