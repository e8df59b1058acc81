"""Processing hand cases: replay, routing, fail closed, malformed payloads, retry ladder."""

import json
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerflow import schemas as S
from ledgerflow.operators import process as P

from helpers import T0

DELIVERY_COLS = ("topic string, partition int, offset bigint, key string, value string, "
                 "delivered_at timestamp, delivery int")
PAY_COLS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.PAYMENTS.fields)


def event(eid, pid, amount="10.00"):
    return json.dumps({"eventId": eid, "paymentId": pid, "idempotencyKey": "k-" + pid, "amount": amount,
                       "currency": "USD", "customerId": "c", "cardLast4": None, "country": "US",
                       "merchant": "m"})


def deliveries(spark, values):
    rows = [(S.TOPIC_REQUESTED, 0, i, None, v, T0 + timedelta(seconds=i), 1) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, DELIVERY_COLS)


def stored(spark, *pids):
    rows = [(p, "k-" + p, Decimal("10.00"), "USD", "c", None, "US", "m", "RECEIVED", None, None, None, T0, T0)
            for p in pids]
    return spark.createDataFrame(rows, PAY_COLS)


def no_claims(spark):
    return spark.createDataFrame([], "event_id string, processed_at timestamp")


def stub(spark, decision, risk=0.0):
    rows = [("p1", decision, risk, ["stub"])]
    return P.table_decider(spark.createDataFrame(rows, "payment_id string, decision string, risk_score double, "
                                                       "reasons array<string>"))


def test_replay_three_times_one_claim_one_outcome(spark):
    d = deliveries(spark, [event("e1", "p1")] * 3)
    r = P.process(d, stored(spark, "p1"), no_claims(spark), stub(spark, "APPROVE"))
    assert r.claims.count() == 1 and r.outcome_outbox.count() == 1 and r.duplicates.count() == 2
    again = P.process(d, stored(spark, "p1"), r.claims, stub(spark, "APPROVE"))
    assert again.claims.count() == 0 and again.duplicates.count() == 3


def test_block_routes_to_blocked_topic(spark):
    r = P.process(deliveries(spark, [event("e1", "p1")]), stored(spark, "p1"), no_claims(spark),
                  stub(spark, "BLOCK", 0.97))
    out = r.outcome_outbox.collect()
    assert [o["topic"] for o in out] == [S.TOPIC_BLOCKED]
    pay = r.payments_after.collect()[0]
    assert pay["status"] == "BLOCKED" and pay["risk_score"] == Decimal("0.970")


def test_escalate_ends_blocked(spark):
    r = P.process(deliveries(spark, [event("e1", "p1")]), stored(spark, "p1"), no_claims(spark),
                  stub(spark, "ESCALATE", 0.5))
    assert r.payments_after.collect()[0]["status"] == "BLOCKED"
    assert r.outcome_outbox.collect()[0]["event_type"] == S.EVENT_TYPE_BLOCKED


def test_null_decision_is_quarantined_without_claim(spark):
    r = P.process(deliveries(spark, [event("e1", "p1")]), stored(spark, "p1"), no_claims(spark),
                  stub(spark, None))
    assert r.claims.count() == 0 and r.outcome_outbox.count() == 0
    assert r.payments_after.collect()[0]["status"] == "RECEIVED"
    assert r.dead_letters.collect()[0]["reason"].startswith(S.REASON_NO_DECISION)


def test_malformed_payloads_are_dead_letters(spark):
    bad = ["{bad", "", "null", "[1]", event("e9", "p1", amount="abc").replace('"abc"', '"abc"'),
           event("e" * 37, "p1")]
    r = P.process(deliveries(spark, bad), stored(spark, "p1"), no_claims(spark), stub(spark, "APPROVE"))
    assert r.claims.count() == 0
    assert r.dead_letters.count() == len(bad)


def test_orphan_is_dead_lettered(spark):
    r = P.process(deliveries(spark, [event("e1", "p404")]), stored(spark, "p1"), no_claims(spark))
    assert [x["reason"] for x in r.dead_letters.collect()] == [S.PAYMENT_NOT_FOUND + "p404"]


def test_retry_ladder(spark):
    failed = spark.createDataFrame([(7, T0)], "offset bigint, delivered_at timestamp")
    rows = {r["attempt"]: r for r in P.retry_ladder(failed).collect()}
    assert [rows[a]["route"] for a in (1, 2, 3, 4)] == [
        "payments.requested-retry-0", "payments.requested-retry-1", "payments.requested-retry-2",
        "payments.requested-dlt"]
    assert [(rows[a]["next_attempt_at"] - T0).total_seconds() for a in (1, 2, 3)] == [1, 3, 7]
    assert rows[4]["next_attempt_at"] is None


def test_two_events_of_one_payment_give_one_row(spark):
    both = [event("e1", "p1"), event("e2", "p1")]
    r = P.process(deliveries(spark, both), stored(spark, "p1"), no_claims(spark), stub(spark, "APPROVE"))
    assert r.claims.count() == 2 and r.payments_after.count() == 1


def test_equal_offsets_in_two_topics_are_two_records(spark):
    main = deliveries(spark, [event("e1", "p1")])
    retry = main.withColumn("topic", F.lit("payments.requested-retry-0"))
    r = P.process(main, stored(spark, "p1"), no_claims(spark), stub(spark, "APPROVE"), retries=retry)
    assert r.claims.count() == 1 and r.duplicates.count() == 1


def test_five_claimed_the_sixth_blocks(spark):
    events = [event(f"e{i}", f"p{i}") for i in range(6)]
    pays = stored(spark, *[f"p{i}" for i in range(6)])
    before = P.process(deliveries(spark, events[:5]), pays, no_claims(spark))
    sixth = deliveries(spark, events).filter("offset = 5")
    alone = P.process(sixth, pays, no_claims(spark)).decided.first()
    assert alone["decision"] == "APPROVE"
    after = P.process(sixth, pays, before.claims).decided.collect()
    assert [(r["event_id"], r["decision"]) for r in after] == [("e5", "BLOCK")]


def test_largest_amounts(spark):
    top = "999999999999999.9999"
    events = [event(f"e{i}", f"p{i}", amount=top) for i in range(4)]
    r = P.process(deliveries(spark, events), stored(spark, *[f"p{i}" for i in range(4)]), no_claims(spark))
    rows = {x["event_id"]: x for x in r.decided.collect()}
    assert rows["e0"]["avg_prior_amount"] is None
    assert rows["e3"]["avg_prior_amount"] == Decimal("1000000000000000.00")
