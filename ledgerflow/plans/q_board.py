"""Registered queries: payment board, reasons, stream sources and the relay stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import process as P
from ..operators.board import MISSING, payment_reasons, payments_board
from ..streaming.effectively_once import run_until_done
from ..streaming.relay import RelaySink, relay_query
from ..streaming.staging import replay_in_order, run_folder
from .q_process import DECIDED_SQL, _run
from .registry import query

_AFTER_SQL = DECIDED_SQL + """,
after AS (
  SELECT p.payment_id, p.amount, p.currency, p.created_at,
         CASE WHEN d.decision IS NULL THEN p.status ELSE d.status END AS status,
         d.decision AS fraud_decision, TRY_CAST(d.risk_score AS DECIMAL(4,3)) AS risk_score, d.reasons
  FROM stored_payments p LEFT JOIN decided d USING (payment_id))"""


@query("payments_board", _AFTER_SQL + f"""
SELECT payment_id, left(payment_id, 8) AS short_id,
       CAST(CAST(amount AS DECIMAL(38,2)) AS VARCHAR) || ' ' || currency AS amount_text, status,
       coalesce(fraud_decision, '{MISSING}') AS decision_text,
       coalesce(CAST(CAST(risk_score AS DECIMAL(4,2)) AS VARCHAR), '{MISSING}') AS risk_text, created_at
FROM after ORDER BY created_at DESC, payment_id""")
def q_payments_board(ds):
    """P13 + O2: board rows after processing, newest first."""
    return payments_board(_run(ds).payments_after)


@query("payment_reasons", _AFTER_SQL + """
SELECT payment_id, CAST(pos AS INTEGER) AS pos, reason FROM (
  SELECT payment_id, generate_subscripts(reasons, 1) - 1 AS pos, unnest(reasons) AS reason
  FROM after WHERE len(reasons) > 0)""")
def q_payment_reasons(ds):
    """F10 + F11: stored reasons JSON exploded to one row per reason (payments with reasons)."""
    return payment_reasons(_run(ds).payments_after, keep_empty=False)


@query("requested_stream", """
SELECT "offset", CASE WHEN bad_payload THEN NULL ELSE ev_id END AS event_id,
       CASE WHEN bad_payload THEN NULL ELSE payment_id END AS payment_id, NOT bad_payload AS decode_ok
FROM deliveries""")
def requested_stream(ds):
    """S1 + S2: the requested topic read as a stream (file source here) and decoded."""
    spark = ds.spark
    root = run_folder(spark, "requested_stream")

    def drain():
        stream = spark.readStream.schema(ds.deliveries.schema).parquet(f"{root}/input")
        decoded = P.decode_events(stream).select("offset", "event_id", "payment_id",
                                                 F.col("decode_error").isNull().alias("decode_ok"))
        q = (decoded.writeStream.format("parquet").option("path", f"{root}/output")
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()

    replay_in_order(ds.deliveries, "delivered_at", f"{root}/input", 4, drain)
    return spark.read.parquet(f"{root}/output")


@query("outbox_relay_stream", """
SELECT event_id, topic, message_key AS key, payload AS value FROM outbox
WHERE event_id NOT IN (SELECT event_id FROM outbox_published)""")
def outbox_relay_stream(ds):
    """T5 + K6 + K7: the relay as a stream; every unpublished row is published, with its payload, and stamped exactly once."""
    spark = ds.spark
    root = run_folder(spark, "outbox_relay")
    sink = RelaySink(spark, f"{root}/out", ds.outbox_published)

    def start():
        stream = spark.readStream.schema(ds.outbox.schema).parquet(f"{root}/input")
        return relay_query(stream, sink, f"{root}/checkpoint", interval=None)

    replay_in_order(ds.outbox, "created_at", f"{root}/input", 4,
                    lambda: run_until_done(start, partitions=spark.sparkContext.defaultParallelism))
    stamps = sink.log.committed("stamps", "event_id string").select("event_id")
    records = sink.log.committed("records", "topic string, key string, value string, event_id string")
    return records.join(stamps, "event_id").select("event_id", "topic", "key", "value")
