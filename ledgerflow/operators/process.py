"""Event processing.

``deliveries -> decode (split) -> union due retries -> first delivery per event
-> left-anti existing claims -> left join payments (split orphans) -> decision
columns -> {claims, payments_after, outcome_outbox, dead_letters}``

Only events that reach the end of the plan are claimed (T7): a decode failure,
an orphan or a missing decision leaves no claim, so a retry can process it.
A record is known by topic, partition and offset; offsets alone repeat.
``failed`` holds every failing copy with the attempt that failed; after the last
attempt it is a dead letter, before it ``next_attempts`` says when to try again.
A batch run on its own has no later attempt: ``dead_letters`` are all its
failures, after the whole ladder.

Transactions evaluated by earlier runs are history for the decisions of this one:
where ``claimed`` carries them, the rows that can still matter (those since the
customer's first new event, and the ``max_history`` before it) join the feature
frame and leave it again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import (deterministic_uuid, reasons_json, risk_decimal,
                                 to_json_keep_nulls)
from .rules import rule_findings, rule_only_decision
from .features import activity_snapshot

Decider = Callable[[DataFrame, DataFrame | None], DataFrame]   # events, history -> events with decisions

# Fixed value: what identifies a delivered record.
RECORD = ("topic", "partition", "offset")
# Columns of an evaluated transaction, kept with its claim.
EVALUATED = ("customer_id", "delivered_at", "amount", "country")


def decode_events(deliveries: DataFrame) -> DataFrame:
    """Parse ``value`` with the declared event schema.

    Adds the event fields (snake_case) and ``decode_error`` (null when usable).
    Corrupt JSON, non-objects, a non-numeric amount, a missing event or payment
    id and an event id over 36 characters (Q22) are all decode errors.
    """
    schema = S.with_corrupt_column(S.REQUESTED_EVENT)
    ev = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt_record",
                                       "mode": "PERMISSIVE"})
    # ``inline`` of a one-element array is a Generate: filters on the parsed
    # fields cannot be pushed below it, so the JSON is parsed once per row.
    out = deliveries.select("*", F.inline(F.array(F.struct(ev.alias("_e")))))
    error = (F.when(F.col("_e").isNull() | F.col("_e._corrupt_record").isNotNull()
                    | F.col("_e.eventId").isNull() | F.col("_e.paymentId").isNull(),
                    F.concat(F.lit(S.REASON_UNPARSEABLE), F.coalesce(F.col("value"), F.lit("null"))))
             .when(F.length("_e.eventId") > S.EVENT_ID_MAX,
                   F.concat(F.lit(S.REASON_LONG_ID), F.col("_e.eventId"))))
    return out.select(
        *deliveries.columns,
        F.col("_e.eventId").alias("event_id"), F.col("_e.paymentId").alias("payment_id"),
        F.col("_e.idempotencyKey").alias("idempotency_key"), F.col("_e.amount").alias("amount"),
        F.col("_e.currency").alias("currency"), F.col("_e.customerId").alias("customer_id"),
        F.col("_e.cardLast4").alias("card_last4"), F.col("_e.country").alias("country"),
        F.col("_e.merchant").alias("merchant"), error.alias("decode_error"))


def first_delivery(decoded: DataFrame) -> DataFrame:
    """In-batch dedup: one row per ``event_id``, the earliest delivery.

    ``row_number() == 1`` over ``(event_id ORDER BY delivered_at, record)`` is
    planned as a WindowGroupLimit with a partial limit before the shuffle, so
    each map task ships at most one copy per event id (a hot event id never
    piles up in one task).
    """
    ok = decoded.filter(F.col("decode_error").isNull())
    w = Window.partitionBy("event_id").orderBy("delivered_at", *RECORD)
    return ok.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def rules_decider(cfg: S.RuleConfig = S.DEFAULT_RULES, hot_source: DataFrame | None = None, narrow: bool = True) -> Decider:
    """The decision is columns of the same plan (rules-only reasoner).

    ``hot_source`` (e.g. the payments table) is where hot customers are
    counted, so the event pipeline upstream of the triage runs once. With
    ``narrow`` the history is first cut down to what the events can reach, as
    suits a small batch against a long history; a batch that meets most customers
    does without, and history and events share the one shuffle of the features.
    """

    def decide(events: DataFrame, history: DataFrame | None = None) -> DataFrame:
        rows = events.withColumn("_past", F.lit(False))
        if history is not None:
            past = relevant_history(events, history, cfg) if narrow else history.select("event_id", *EVALUATED)
            past = past.withColumn("_past", F.lit(True))
            rows = rows.unionByName(past, allowMissingColumns=True)
        feats = activity_snapshot(rows.withColumn("created_at", F.col("delivered_at")), cfg,
                                  tiebreak="event_id", hot_source=hot_source)
        feats = feats.filter(~F.col("_past")).drop("_past")
        return rule_only_decision(rule_findings(feats, cfg)).withColumn("created_at", F.col("delivered_at"))

    return decide


def relevant_history(events: DataFrame, history: DataFrame, cfg: S.RuleConfig) -> DataFrame:
    """Earlier transactions that features of ``events`` can reach: per touched customer those
    from its first new event on, and the ``max_history`` before (a limit per group, taken
    before the shuffle)."""
    first = events.groupBy("customer_id").agg(F.min("delivered_at").alias("_first"))
    past = history.select("event_id", *EVALUATED).join(first, "customer_id")
    since = past.filter(F.col("delivered_at") >= F.col("_first"))
    w = Window.partitionBy("customer_id").orderBy(F.desc("delivered_at"), F.desc("event_id"))
    before = (past.filter(F.col("delivered_at") < F.col("_first"))
              .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cfg.max_history).drop("_r"))
    return since.unionByName(before).drop("_first")


def table_decider(decisions: DataFrame) -> Decider:
    """A stub decider reading ``(payment_id, decision, risk_score, reasons)``;
    a missing row or a null decision means "no decision" (fail closed)."""

    def decide(events: DataFrame, history: DataFrame | None = None) -> DataFrame:
        d = decisions.select("payment_id", "decision", "risk_score", "reasons")
        return events.join(d, "payment_id", "left")

    return decide


@dataclass
class Processed:
    decoded: DataFrame
    new_events: DataFrame       # first delivery of events not claimed before
    duplicates: DataFrame       # deliveries skipped as re-deliveries
    orphans: DataFrame          # no payment row
    decided: DataFrame          # events with a decision
    undecided: DataFrame        # decider returned nothing (fail closed)
    claims: DataFrame
    payments_after: DataFrame
    outcome_outbox: DataFrame
    payment_updates: DataFrame  # one row per payment, the last event's
    failed: DataFrame           # failing copies with reason and attempt
    dead_letters: DataFrame


def _severity_ok(decision: Column) -> Column:
    return decision.isin(*S.DECISIONS)


def process(deliveries: DataFrame, payments: DataFrame, claimed: DataFrame,
            decider: Decider | None = None, retries: DataFrame | None = None,
            history: DataFrame | None = None, hold: Callable[[DataFrame], DataFrame] = lambda df: df,
            decoded: DataFrame | None = None) -> Processed:
    """Process one batch of deliveries against the payments and claims tables.

    ``history`` holds the transactions that earlier runs have evaluated (default:
    ``claimed``, where it carries their columns). ``hold`` is applied to the three frames
    that all outputs come from; a caller that writes several outputs persists them.
    ``decoded`` are the decoded deliveries, where the caller has them already.
    """
    decider = decider or rules_decider(hot_source=payments)
    if "attempt" not in deliveries.columns:
        deliveries = deliveries.withColumn("attempt", F.lit(1))
    if retries is not None:                                   # U2: retried records re-enter
        deliveries = deliveries.unionByName(retries, allowMissingColumns=True)
    decoded = hold(decode_events(deliveries)) if decoded is None else decoded
    firsts = first_delivery(decoded)
    fresh = firsts.join(claimed.select("event_id"), "event_id", "left_anti")     # J2
    existing = payments.select("payment_id", F.lit(True).alias("_found"))
    joined = hold(fresh.join(existing, "payment_id", "left"))                    # J1: found and orphans come from it
    orphans = joined.filter(F.col("_found").isNull()).drop("_found")
    found = joined.filter(F.col("_found")).drop("_found")
    if history is None and set(EVALUATED) <= set(claimed.columns):
        history = claimed
    decided_all = hold(decider(found, history))
    usable = decided_all.filter(_severity_ok(F.col("decision")))
    undecided = decided_all.filter(~_severity_ok(F.col("decision")) | F.col("decision").isNull())
    approved = F.col("decision") == S.DECISIONS[0]
    decided = usable.withColumns({
        "status": F.when(approved, S.STATUS_PROCESSED).otherwise(S.STATUS_BLOCKED),     # R13
        "topic_out": F.when(approved, S.TOPIC_PROCESSED).otherwise(S.TOPIC_BLOCKED),    # R14
        "event_type": F.when(approved, S.EVENT_TYPE_PROCESSED).otherwise(S.EVENT_TYPE_BLOCKED),
        "outcome_event_id": deterministic_uuid(F.col("event_id"), F.lit("outcome")),
    })
    claims = decided.select("event_id", F.col("delivered_at").alias("processed_at"), *EVALUATED)   # K4
    # One join gives every decoded delivery the fate of its event: the first copy of a
    # decided event is processed, every copy of an orphan or undecided event fails on
    # its own (its claim rolls back), everything else is a duplicate. Deliveries that
    # don't decode have no event id and stay out of the join.
    record = F.struct(*RECORD)

    def fate_of(df: DataFrame, fate: Column) -> DataFrame:
        return df.select("event_id", record.alias("_first"), fate.alias("_fate"))

    judged = fate_of(decided_all, F.when(_severity_ok(F.col("decision")), F.lit("processed")).otherwise(F.lit("undecided")))
    fates = judged.unionByName(fate_of(orphans, F.lit("orphan")))  # one reference to the decider
    readable = decoded.filter(F.col("decode_error").isNull()).join(fates, "event_id", "left").withColumn(
        "fate",
        F.when((F.col("_fate") == "processed") & (record == F.col("_first")), F.lit("processed"))
        .when(F.col("_fate").isin("orphan", "undecided"), F.col("_fate"))
        .otherwise(F.lit("duplicate"))).drop("_first", "_fate")
    duplicates = readable.filter(F.col("fate") == "duplicate").drop("fate")
    # K5: one update per payment, the last event's
    last = F.max_by(F.struct("status", "decision", "risk_score", "reasons", "delivered_at"),
                    F.struct("delivered_at", *RECORD, "event_id")).alias("u")
    payment_updates = decided.groupBy("payment_id").agg(last).select(
        "payment_id", F.col("u.status").alias("status"), F.col("u.decision").alias("fraud_decision"),
        risk_decimal(F.col("u.risk_score")).alias("risk_score"), reasons_json(F.col("u.reasons")).alias("fraud_reasons"),
        F.col("u.delivered_at").alias("updated_at"))
    outcome = F.struct(                                                           # P7
        F.col("outcome_event_id").alias("eventId"), F.col("payment_id").alias("paymentId"),
        "status", "decision", F.col("risk_score").cast("double").alias("riskScore"), "reasons")
    outcome_outbox = decided.select(                                              # K3
        F.lit(S.AGGREGATE_TYPE).alias("aggregate_type"), F.col("payment_id").alias("aggregate_id"),
        F.col("outcome_event_id").alias("event_id"), "event_type", F.col("topic_out").alias("topic"),
        F.col("payment_id").alias("message_key"), to_json_keep_nulls(outcome).alias("payload"),
        F.col("delivered_at").alias("created_at"))
    reason = (F.when(F.col("fate") == "orphan", F.concat(F.lit(S.PAYMENT_NOT_FOUND), F.col("payment_id")))
              .otherwise(F.concat(F.lit(S.REASON_NO_DECISION), F.col("payment_id"))))
    columns = [c for c in (*RECORD, "key", "attempt", "next_attempt_at", "delivered_at", "value") if c in deliveries.columns]
    failed = (readable.filter(F.col("fate").isin("orphan", "undecided")).select(*columns, reason.alias("reason"))
              .unionByName(decoded.filter(F.col("decode_error").isNotNull())
                           .select(*columns, F.col("decode_error").alias("reason"))))
    dead = failed.select(*RECORD, F.lit(S.RETRY_ATTEMPTS).alias("attempt"), "reason",               # K8
                         F.col("value").alias("payload"), "delivered_at")
    return Processed(decoded, fresh, duplicates, orphans, decided, undecided, claims,
                     apply_updates(payments, payment_updates), outcome_outbox, payment_updates, failed, dead)


def apply_updates(payments: DataFrame, updates: DataFrame) -> DataFrame:
    """K5: the payments table with ``updates`` (one row per payment) applied."""
    changed = [c for c in updates.columns if c != "payment_id"]
    new = updates.select("payment_id", *[F.col(c).alias(f"_{c}") for c in changed])
    return payments.join(new, "payment_id", "left").select(
        *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in payments.columns])


def next_attempts(failed: DataFrame, failed_at: Column) -> DataFrame:
    """Failed records that have an attempt left, with ``next_attempt_at``: 1, 2, 4 s after the failure."""
    wait = F.make_interval(secs=F.expr("shiftleft(1, attempt - 1)") * (S.RETRY_BASE_DELAY_MS // 1000))
    return (failed.filter(F.col("attempt") < S.RETRY_ATTEMPTS)
            .withColumn("next_attempt_at", failed_at + wait).withColumn("attempt", F.col("attempt") + 1))


def exhausted(failed: DataFrame) -> DataFrame:
    """K8: dead letters, records that failed their last attempt."""
    return failed.filter(F.col("attempt") >= S.RETRY_ATTEMPTS).withColumnRenamed("value", "payload")


def retry_ladder(failed: DataFrame) -> DataFrame:
    """Attempt ledger for failing records (1 s, 2 s, 4 s, then dead letter).

    ``failed`` has ``offset`` and ``delivered_at``; every attempt of a
    deterministic failure fails, so each record walks the whole ladder.
    Output: offset, attempt, failed_at, route, next_attempt_at.
    """
    a = F.col("attempt")
    delay_s = F.expr("shiftleft(1, attempt - 1)")            # 2^(attempt-1) seconds
    before_s = delay_s - 1                                    # delays already waited
    base = S.RETRY_BASE_DELAY_MS // 1000
    ladder = failed.select("offset", "delivered_at",
                           F.explode(F.sequence(F.lit(1), F.lit(S.RETRY_ATTEMPTS))).alias("attempt"))
    failed_at = F.col("delivered_at") + F.make_interval(secs=before_s * base)
    last = a >= S.RETRY_ATTEMPTS
    return ladder.select(
        "offset", "attempt", failed_at.alias("failed_at"),
        F.when(last, F.lit(S.TOPIC_DEAD_LETTER))
        .otherwise(F.concat(F.lit(S.TOPIC_REQUESTED + "-retry-"), (a - 1).cast("string"))).alias("route"),
        F.when(~last, failed_at + F.make_interval(secs=delay_s * base)).alias("next_attempt_at"))
