"""Intake hand cases: validation patterns, first writer wins, TTL answer classes."""

from datetime import timedelta
from decimal import Decimal

from ledgerflow.operators import ingest as I

from helpers import T0

REQ_COLS = ("request_id bigint, received_at timestamp, idempotency_key string, amount decimal(19,4), "
            "currency string, customer_id string, card_last4 string, country string, merchant string")


def req(i, key="k", hours=0.0, amount="10.00", currency="USD", customer="c", card=None, country=None,
        merchant=None):
    return (i, T0 + timedelta(hours=hours), key, Decimal(amount) if amount is not None else None, currency,
            customer, card, country, merchant)


def violations(spark, rows):
    df = I.validate_requests(spark.createDataFrame(rows, REQ_COLS))
    return {r["request_id"]: list(r["violations"]) for r in df.collect()}


def test_patterns_match_the_whole_string(spark):
    v = violations(spark, [req(1, currency="USD\n"), req(2, currency="usd"), req(3, currency="US"),
                           req(4, card="12345"), req(5, merchant="m" * 128), req(6, merchant="m" * 129),
                           req(7, customer="\t"), req(8, country="usa"), req(9, card="1234", country="GB")])
    assert v[1] == [I.MSG_CURRENCY_CODE] and v[2] == [I.MSG_CURRENCY_CODE] and v[3] == [I.MSG_CURRENCY_CODE]
    assert v[4] == [I.MSG_CARD]
    assert v[5] == [] and v[6] == [I.MSG_MERCHANT_SIZE]
    assert v[7] == [I.MSG_CUSTOMER_BLANK]
    assert v[8] == [I.MSG_COUNTRY]
    assert v[9] == []


def test_missing_key_and_amount_rules(spark):
    v = violations(spark, [req(1, key=None), req(2, amount=None), req(3, amount="0.00"), req(4, amount="0.01"),
                           req(5, key="")])
    assert v[1] == [I.MSG_KEY_REQUIRED]
    assert v[2] == [I.MSG_AMOUNT_NULL] and v[3] == [I.MSG_AMOUNT_POSITIVE]
    assert v[4] == [] and v[5] == []            # an empty key is allowed, a missing one is not


def test_same_key_returns_first_payment(spark):
    rows = [req(1, hours=0, amount="10.00"), req(2, hours=1, amount="99.00")]
    valid = I.validate_requests(spark.createDataFrame(rows, REQ_COLS)).filter("valid")
    pays = I.new_payments(valid).collect()
    assert len(pays) == 1 and pays[0]["amount"] == Decimal("10.0000")
    outbox = I.requested_outbox(I.new_payments(valid)).collect()
    assert len(outbox) == 1 and outbox[0]["aggregate_id"] == pays[0]["payment_id"]
    answers = {r["request_id"]: r for r in I.accept_classes(valid).collect()}
    assert answers[1]["payment_id"] == answers[2]["payment_id"] == pays[0]["payment_id"]


def test_ttl_is_anchored_at_caching_time(spark):
    hours = [0, 5, 23, 24, 25, 47, 48, 49, 100]
    rows = [req(i, hours=h) for i, h in enumerate(hours)]
    valid = I.validate_requests(spark.createDataFrame(rows, REQ_COLS)).filter("valid")
    got = {r["request_id"]: r["accept_result"] for r in I.accept_classes(valid).collect()}
    expected = ["created", "idempotent_redis", "idempotent_redis", "idempotent_db", "idempotent_redis",
                "idempotent_redis", "idempotent_db", "idempotent_redis", "idempotent_db"]
    assert [got[i] for i in range(len(hours))] == expected


def test_ttl_chain_with_small_buckets_and_many_keys(spark):
    import random
    rnd = random.Random(7)
    rows, i = [], 0
    for k in range(20):
        t = 0.0
        for _ in range(rnd.randint(1, 25)):
            t += rnd.choice([0.5, 3, 23.9, 24, 24.1, 48, 70])
            rows.append(req(i, key=f"k{k}", hours=t))
            i += 1
    valid = I.validate_requests(spark.createDataFrame(rows, REQ_COLS)).filter("valid")
    got = {r["request_id"]: r["accept_result"] for r in I.accept_classes(valid, bucket_rows=3).collect()}
    expected = {}
    for k in {r[2] for r in rows}:
        expires = None
        for r in sorted([r for r in rows if r[2] == k], key=lambda r: (r[1], r[0])):
            if expires is None:
                expected[r[0]], expires = "created", r[1] + timedelta(hours=24)
            elif r[1] < expires:
                expected[r[0]] = "idempotent_redis"
            else:
                expected[r[0]], expires = "idempotent_db", r[1] + timedelta(hours=24)
    assert got == expected


def test_ingest_batch_splits_and_dedupes_against_existing(spark):
    rows = [req(1, key="a"), req(2, key="a", hours=1), req(3, key=None), req(4, key="b", currency="usd"),
            req(5, key="c")]
    df = spark.createDataFrame(rows, REQ_COLS)
    existing = spark.createDataFrame([("c", "old-c", "PROCESSED", T0 - timedelta(hours=30))],
                                     "idempotency_key string, payment_id string, status string, created_at timestamp")
    out = I.ingest_batch(df, existing=existing)
    assert sorted(r["idempotency_key"] for r in out.payments.collect()) == ["a"]
    assert out.outbox.count() == 1
    assert sorted(r["request_id"] for r in out.rejected.collect()) == [3, 4]
    answers = {r["request_id"]: (r["accept_result"], r["payment_id"], r["status"]) for r in out.answers.collect()}
    assert answers[1][0] == "created" and answers[2][0] == "idempotent_redis" and answers[1][1] == answers[2][1]
    assert answers[5] == ("idempotent_db", "old-c", "PROCESSED")     # created 30 h before: cache expired


def test_existing_key_inside_ttl_is_a_cache_hit(spark):
    rows = [req(1, key="c", hours=0), req(2, key="c", hours=10), req(3, key="c", hours=30)]
    existing = spark.createDataFrame([("c", "old-c", "BLOCKED", T0 - timedelta(hours=5))],
                                     "idempotency_key string, payment_id string, status string, created_at timestamp")
    valid = I.validate_requests(spark.createDataFrame(rows, REQ_COLS)).filter("valid")
    got = {r["request_id"]: (r["accept_result"], r["payment_id"], r["status"])
           for r in I.accept_classes(valid, existing=existing).collect()}
    # creation at -5 h cached until 19 h; request at 30 h re-reads the table (re-cached until 54 h)
    assert got == {1: ("idempotent_redis", "old-c", "RECEIVED"), 2: ("idempotent_redis", "old-c", "RECEIVED"),
                   3: ("idempotent_db", "old-c", "BLOCKED")}


def test_malformed_bodies_are_kept_and_rejected(spark):
    from ledgerflow.sources.intake import parse_intake

    landing = spark.createDataFrame(
        [(1, "k1", '{"amount": "12.5", "currency": "USD", "customerId": "c"}', T0),
         (2, "k2", "{bad", T0), (3, "k3", '{"amount": "abc", "currency": "USD", "customerId": "c"}', T0)],
        "request_id bigint, idempotency_key string, body string, received_at timestamp")
    parsed = {r["request_id"]: r for r in parse_intake(landing).collect()}
    assert parsed[1]["amount"] == Decimal("12.5000") and parsed[1]["_corrupt_record"] is None
    assert parsed[2]["_corrupt_record"] == "{bad" and parsed[2]["amount"] is None
    assert parsed[3]["_corrupt_record"] is not None
    checked = {r["request_id"]: r["valid"] for r in I.validate_requests(parse_intake(landing)).collect()}
    assert checked == {1: True, 2: False, 3: False}
