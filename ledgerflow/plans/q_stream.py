"""Registered queries that run a Structured Streaming job end to end.

Each replays a derived table as a time-ordered file stream into the streaming
operator and returns the committed output; the oracle is the SQL of the batch
query the stream must equal.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import join_text
from ..operators import process as P
from ..operators.rules import rule_findings, rule_only_decision
from ..operators.triage import triage
from ..session import materialize
from ..streaming.effectively_once import ANSWERS, CLAIMS, DEAD, PAYMENTS, UPDATES, AcceptSink, CommitLog, ProcessingSink, current_payments, run_until_done
from ..streaming.keyed_claims import CLAIM_OUTCOMES, DEAD_LETTERS, ClaimStream
from ..streaming.payments_table import PaymentsTable
from ..streaming.rates import RateRun
from ..streaming.runs import stream_triage_features, stream_triage_run
from ..streaming.staging import replay_in_order, run_folder
from ..streaming.triage_slices import stream_activity_slices
from ..streaming.triage_state import OUTPUT_SCHEMA
from .q_ingest import ACCEPT_SQL, VALIDATION_SQL, _PAY_ID
from .q_ops import _K2, _K3, _S2, _S3
from .q_process import DECIDED_SQL, PROC_SQL, _run
from .q_triage import _triage_sql, rules_sql
from .registry import query

DAY = S.DAY_RULES


@query("stream_triage", _triage_sql(86400))
def stream_triage(ds):
    """Triage over a payments stream (keyed state, event-time order) equals batch triage."""
    feats = stream_triage_features(ds.spark, ds.payments, DAY)
    out = rule_only_decision(rule_findings(feats, DAY))
    return out.select("payment_id", "customer_id", "decision", "risk_score",
                      join_text(F.col("reasons")).alias("reasons_text"))


@query("stream_triage_slices", _triage_sql(86400))
def stream_triage_slices(ds):
    """T1 for hot customers: state keyed by customer and day, halos handed from slice to slice."""
    log = stream_triage_run(ds.spark, ds.payments, DAY,
                            activity=lambda stream, cfg, delay: stream_activity_slices(stream, cfg, delay, 86400))
    out = rule_only_decision(rule_findings(log.committed("features", OUTPUT_SCHEMA), DAY))
    return out.select("payment_id", "customer_id", "decision", "risk_score", join_text(F.col("reasons")).alias("reasons_text"))


@query("stream_late_rows", """,
pay AS (SELECT payment_id, customer_id, created_at, event_id % 13 = 0 AS straggler FROM payments),
folded AS (SELECT customer_id, max(created_at) AS last_at FROM pay WHERE NOT straggler GROUP BY customer_id)
SELECT p.payment_id, coalesce(p.straggler AND p.created_at <= f.last_at, false) AS late
FROM pay p LEFT JOIN folded f USING (customer_id)""")
def stream_late_rows(ds):
    """T1 conservation on a replay with late rows: every 13th payment arrives when the watermark has
    passed all others, and each row ends once, in the features or in the table of late rows."""
    straggler = F.col("event_id") % 13 == 0
    log = stream_triage_run(ds.spark, ds.payments.filter(~straggler), DAY, stragglers=ds.payments.filter(straggler))
    both = log.committed("features", OUTPUT_SCHEMA).unionByName(log.committed("late_rows", OUTPUT_SCHEMA))
    return both.select("payment_id", "late")


def _stored(ds):
    """The payments and the claims before the run, each written once, dealt by key: every micro-batch reads them."""
    return (materialize(ds.stored_payments.repartition("payment_id"), "stored_payments"),
            materialize(ds.claimed.repartition("event_id"), "claimed"))


def _processing_run(ds, decider=None, log=CommitLog):
    """Deliveries replayed through the processor, in four drains or more; ends when the retry
    queue is empty. ``log`` makes the commit log (tests give one that fails once)."""
    spark = ds.spark
    root = run_folder(spark, "stream_processing")
    log = log(spark, f"{root}/out")
    payments, claimed = _stored(ds)
    sink = ProcessingSink(spark, f"{root}/out", payments, claimed, log=log,
                          decider=decider or P.rules_decider(DAY, hot_source=payments))

    def start():
        stream = spark.readStream.schema(ds.deliveries.schema).parquet(f"{root}/input")
        return (stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint")
                .trigger(availableNow=True).start())

    replay_in_order(ds.deliveries, "delivered_at", f"{root}/input", 4,
                    lambda: run_until_done(start, partitions=spark.sparkContext.defaultParallelism),
                    files=spark.sparkContext.defaultParallelism)
    sink.drain()
    return log


def claim_run(ds, log=CommitLog):
    """Deliveries replayed through the claims in keyed state, until no record waits for a retry."""
    spark = ds.spark
    root = run_folder(spark, "stream_claims")
    decisions = materialize(triage(ds.payments, DAY).select("payment_id", "decision", "risk_score", "reasons"), "decisions")
    stream = ClaimStream(spark, root, lambda: ds.stored_payments, lambda: decisions, ds.claimed, log(spark, f"{root}/out"))
    replay_in_order(ds.deliveries, "delivered_at", f"{root}/input", 4,
                    lambda: run_until_done(lambda: stream.start(f"{root}/input")))
    stream.finish(f"{root}/input")
    return stream


@query("stream_claims", DECIDED_SQL + """
SELECT ev_id AS event_id, delivered_at AS processed_at FROM decided""")
def stream_claims(ds):
    """T2 + K4 + J2 + T7: claims in the stream's keyed state; no micro-batch reads a claims table."""
    return claim_run(ds).log.committed("claims", CLAIM_OUTCOMES).select("event_id", "processed_at")


@query("stream_claim_outcomes", PROC_SQL + rules_sql(86400) + """
SELECT f.ev_id AS event_id, f.payment_id, f.delivered_at AS processed_at,
       CASE WHEN r.recommended = 'APPROVE' THEN 'PROCESSED' ELSE 'BLOCKED' END AS status, r.recommended AS decision,
       r.rule_risk AS risk_score, r.signals_text || '; """ + S.RULES_ONLY_REASON + """' AS reasons_text,
       CASE WHEN r.recommended = 'APPROVE' THEN 'payments.processed' ELSE 'payments.blocked' END AS topic
FROM found f JOIN findings r USING (payment_id)""")
def stream_claim_outcomes(ds):
    """T7 + R13 + R14: the claim and the outcome that it came with, in one row of the keyed stream."""
    rows = claim_run(ds).log.committed("claims", CLAIM_OUTCOMES)
    return rows.select("event_id", "payment_id", "processed_at", "status", "decision", "risk_score",
                       join_text(F.col("reasons")).alias("reasons_text"), "topic")


@query("stream_claim_dead_letters", PROC_SQL + """
SELECT topic, CAST(partition AS INTEGER) AS partition, "offset", 4 AS attempt, reason, payload,
       delivered_at + INTERVAL 7 SECOND AS died_at FROM dead""")
def stream_claim_dead_letters(ds):
    """K8 + T6: records that failed four attempts, through the retry folder that the keyed stream reads as a
    second source."""
    dead = claim_run(ds).log.committed("dead_letters", DEAD_LETTERS)
    return dead.select("topic", "partition", "offset", "attempt", "reason", "payload", F.col("next_attempt_at").alias("died_at"))


@query("effectively_once", DECIDED_SQL + """
SELECT (SELECT count(*) FROM decided) AS claims, (SELECT count(*) FROM decided) AS outcome_events,
       CAST(0 AS BIGINT) AS duplicated_payments, (SELECT count(*) FROM dead) AS dead_letters""")
def effectively_once(ds):
    """Every event once, no duplicate outcome (tests add a crash and a restart)."""
    log = _processing_run(ds)
    claims = log.committed("claims", CLAIMS).select(F.lit(0).alias("_k"))
    outs = (log.committed("outcome_outbox", "aggregate_id string").groupBy("aggregate_id")
            .agg(F.count(F.lit(1)).alias("_n")))
    dead = log.committed("dead_letters", "offset bigint").select(F.lit(2).alias("_k"))
    both = (claims.unionByName(outs.select(F.lit(1).alias("_k"), "_n"), allowMissingColumns=True)
            .unionByName(dead, allowMissingColumns=True))
    return both.agg(F.count_if(F.col("_k") == 0).alias("claims"),
                    F.coalesce(F.sum(F.when(F.col("_k") == 1, F.col("_n"))), F.lit(0)).cast("bigint")
                    .alias("outcome_events"),
                    F.count_if((F.col("_k") == 1) & (F.col("_n") > 1)).alias("duplicated_payments"),
                    F.count_if(F.col("_k") == 2).alias("dead_letters"))


@query("stream_accept", VALIDATION_SQL + f""",
firsts AS (SELECT v.* FROM valid v JOIN winners w USING (idempotency_key, request_id))
SELECT {_PAY_ID} AS payment_id, idempotency_key, amount, currency, customer_id, card_last4, country,
       merchant, 'RECEIVED' AS status, received_at AS created_at
FROM firsts""", decimals=('amount',))
def stream_accept(ds):
    """Payments created by the request stream; keys dedupe across batches via committed rows."""
    pays = _accept_run(ds).committed("payments", PAYMENTS)
    return pays.select("payment_id", "idempotency_key", "amount", "currency", "customer_id", "card_last4",
                       "country", "merchant", "status", "created_at")


def _accept_run(ds):
    """Requests replayed through the intake, in four micro-batches or more."""
    spark = ds.spark
    root = run_folder(spark, "stream_accept")
    sink = AcceptSink(spark, f"{root}/out")

    def start():
        stream = spark.readStream.schema(ds.requests.schema).parquet(f"{root}/input")
        return (stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint")
                .trigger(availableNow=True).start())

    replay_in_order(ds.requests, "received_at", f"{root}/input", 4,
                    lambda: run_until_done(start, partitions=spark.sparkContext.defaultParallelism),
                    files=spark.sparkContext.defaultParallelism)
    return sink.log


@query("stream_answers", "RECURSIVE" + ACCEPT_SQL + f"""
SELECT request_id, idempotency_key, {_PAY_ID} AS payment_id, accept_result, 'RECEIVED' AS status
FROM classes""")
def stream_answers(ds):
    """T3 + A4: the answers that the request stream gives, across micro-batches, equal those of one batch."""
    return _accept_run(ds).committed("answers", ANSWERS).select(
        "request_id", "idempotency_key", "payment_id", "accept_result", "status")


@query("stream_outcomes", PROC_SQL + rules_sql(86400) + """
SELECT f.payment_id, CASE WHEN r.recommended = 'APPROVE' THEN 'PROCESSED' ELSE 'BLOCKED' END AS status,
       r.recommended AS fraud_decision, CAST(r.rule_risk AS DECIMAL(4,3)) AS risk_score
FROM found f JOIN findings r USING (payment_id)""", decimals=("risk_score",))
def stream_outcomes(ds):
    """T1 + K9 composed: the stateful triage stream writes decisions with full customer
    history; the effectively-once processor (crash and restart included) takes them
    through a table decider. Committed payment updates equal batch triage."""
    feats = stream_triage_features(ds.spark, ds.payments, DAY)
    decisions = rule_only_decision(rule_findings(feats, DAY)).select("payment_id", "decision", "risk_score", "reasons")
    log = _processing_run(ds, decider=P.table_decider(decisions))
    ups = log.committed("payment_updates", UPDATES)
    return ups.select("payment_id", "status", "fraud_decision", "risk_score")


@query("stream_payments_after", DECIDED_SQL + """
SELECT p.payment_id,
       CASE WHEN d.decision IS NULL THEN p.status ELSE d.status END AS status,
       d.decision AS fraud_decision,
       TRY_CAST(d.risk_score AS DECIMAL(4,3)) AS risk_score,
       CASE WHEN d.decision IS NULL THEN NULL ELSE CAST(to_json(d.reasons) AS VARCHAR) END AS fraud_reasons
FROM stored_payments p LEFT JOIN decided d USING (payment_id)""", decimals=("risk_score",))
def stream_payments_after(ds):
    """K5 + J6 + T8: micro-batches decide with the history of earlier ones and of earlier runs, so
    the payments they leave equal those of one batch."""
    after = current_payments(_processing_run(ds), ds.stored_payments)
    return after.select("payment_id", "status", "fraud_decision", "risk_score", "fraud_reasons")


@query("payments_merge", DECIDED_SQL + """
SELECT p.payment_id, p.customer_id, p.amount,
       CASE WHEN d.decision IS NULL THEN p.status ELSE d.status END AS status,
       d.decision AS fraud_decision,
       TRY_CAST(d.risk_score AS DECIMAL(4,3)) AS risk_score,
       CASE WHEN d.decision IS NULL THEN NULL ELSE CAST(to_json(d.reasons) AS VARCHAR) END AS fraud_reasons
FROM stored_payments p LEFT JOIN decided d USING (payment_id)""", decimals=("amount", "risk_score"))
def payments_merge(ds):
    """K5: payments as base and deltas. A third of the payments arrive as inserts; updates come in three
    batches, with a compaction before the last one; the read merges what the base does not hold yet."""
    table = PaymentsTable(ds.spark, run_folder(ds.spark, "payments_table"), buckets=16)
    late = F.pmod(F.xxhash64("payment_id"), F.lit(3)) == 0
    table.create(ds.stored_payments.filter(~late))
    updates = materialize(_run(ds).payment_updates, "payment_updates")
    batch = F.pmod(F.unix_seconds("updated_at"), F.lit(3))
    table.append(0, updates.filter(batch == 0), ds.stored_payments.filter(late))
    table.append(1, updates.filter(batch == 1))
    table.compact()
    table.append(2, updates.filter(batch == 2))
    return table.read().select("payment_id", "customer_id", "amount", "status", "fraud_decision", "risk_score", "fraud_reasons")


@query("stream_dead_letters", PROC_SQL + """
SELECT topic, CAST(partition AS INTEGER) AS partition, "offset", 4 AS attempt, reason, payload,
       delivered_at + INTERVAL 7 SECOND AS died_at FROM dead""")
def stream_dead_letters(ds):
    """K8 + T6: records that failed four attempts (after 1, 2 and 4 s), with their payload."""
    dead = _processing_run(ds).committed("dead_letters", DEAD)
    return dead.select("topic", "partition", "offset", "attempt", "reason", "payload",
                       F.col("next_attempt_at").alias("died_at"))


@query("stream_conservation", DECIDED_SQL + """
SELECT (SELECT count(*) FROM deliveries) AS delivered, (SELECT count(*) FROM decided) AS processed,
       (SELECT count(*) FROM ok) - (SELECT count(*) FROM decided) - (SELECT count(*) FROM orph_copies) AS duplicates,
       (SELECT count(*) FROM dead) AS dead_letters""")
def stream_conservation(ds):
    """Every delivered record ends as processed, duplicate or dead letter, once."""
    log = _processing_run(ds)
    kinds = [ds.deliveries.select(F.lit("delivered").alias("kind")),
             log.committed("claims", CLAIMS).select(F.lit("processed").alias("kind")),
             log.committed("duplicates", "topic string").select(F.lit("duplicates").alias("kind")),
             log.committed("dead_letters", DEAD).select(F.lit("dead_letters").alias("kind"))]
    both = kinds[0].unionAll(kinds[1]).unionAll(kinds[2]).unionAll(kinds[3])
    return both.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("delivered", "processed", "duplicates", "dead_letters")])


@query("stream_retry", DECIDED_SQL + """
SELECT payment_id, 'Payment not found for id=' || payment_id AS first_reason FROM orph""")
def stream_retry(ds):
    """T6 + U2: payments that are missing at the first attempt and arrive before the next one: their
    events re-enter by the retry queue and are processed."""
    spark = ds.spark
    root = run_folder(spark, "stream_retry")
    missing = ds.payments.filter(F.col("event_id") % 53 == 0).select(
        "payment_id", "amount", "currency", "customer_id", "card_last4", "country", "merchant", "created_at",
        F.lit(S.STATUS_RECEIVED).alias("status"))
    payments, claimed = _stored(ds)
    here = [payments]
    sink = ProcessingSink(spark, f"{root}/out", lambda: here[0], claimed, P.rules_decider(DAY, hot_source=payments))
    ds.deliveries.write.parquet(f"{root}/input")

    def start():
        stream = spark.readStream.schema(ds.deliveries.schema).parquet(f"{root}/input")
        return (stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint")
                .trigger(availableNow=True).start())

    run_until_done(start, partitions=spark.sparkContext.defaultParallelism)
    here[0] = payments.unionByName(missing, allowMissingColumns=True)     # they arrive
    sink.drain()
    log = sink.log
    first = log.committed("failed", "topic string, partition int, offset bigint, attempt int, value string, reason string") \
        .filter((F.col("attempt") == 1) & F.col("reason").startswith(S.PAYMENT_NOT_FOUND)) \
        .select(F.get_json_object("value", "$.paymentId").alias("payment_id"), F.col("reason").alias("first_reason")).distinct()
    return log.committed("payment_updates", UPDATES).select("payment_id").join(first, "payment_id")


@query("stream_rate_by_status", DECIDED_SQL + f"""
SELECT {_S2} AS window_start, status, count(*) AS events, count(*) / 60 AS rate_per_sec
FROM decided, {_K2} GROUP BY 1, 2""")
def stream_rate_by_status(ds):
    """Processed payments per second by status, from a watermarked window in append mode."""
    decided = materialize(_run(ds).decided.select("delivered_at", "status"), "decided")
    windows = RateRun(ds.spark, decided, "delivered_at", ["status"]).close()
    return windows.withColumn("rate_per_sec", F.col("events") / 60)


@query("stream_dlq_increase", PROC_SQL + f""",
dl AS (SELECT delivered_at + INTERVAL 7 SECOND AS dead_at FROM dead)
SELECT {_S3} AS window_start, count(*) AS increase FROM dl, {_K3} GROUP BY 1""")
def stream_dlq_increase(ds):
    """Dead letters of each 5-minute window, every minute, as a stream."""
    dead = materialize(_run(ds).dead_letters.select((F.col("delivered_at") + F.expr("INTERVAL 7 SECONDS")).alias("dead_at")), "dead")
    return RateRun(ds.spark, dead, "dead_at", [], "5 minutes", "1 minute").close().withColumnRenamed("events", "increase")
