"""Registered queries: request intake, validation, first writer, accept classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import join_text
from ..operators import ingest as I
from ..sources.intake import intake_bodies, parse_intake
from .registry import query


def sql_uuid(*parts: str) -> str:
    """DuckDB text of ``deterministic_uuid``: SHA-256 hex as 8-4-4-4-12."""
    joined = " || chr(1) || ".join(parts)
    h = f"sha256({joined})"
    return (f"(substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || "
            f"substr({h},17,4) || '-' || substr({h},21,12))")


VALIDATION_SQL = rf""",
vreq AS (
  SELECT *, list_filter([
    CASE WHEN idempotency_key IS NULL THEN '{I.MSG_KEY_REQUIRED}' END,
    CASE WHEN amount IS NULL THEN '{I.MSG_AMOUNT_NULL}' END,
    CASE WHEN amount < 0.01 THEN '{I.MSG_AMOUNT_POSITIVE}' END,
    CASE WHEN currency IS NULL OR NOT regexp_matches(currency, '[^\x00-\x20]') THEN '{I.MSG_CURRENCY_BLANK}' END,
    CASE WHEN currency IS NOT NULL AND NOT regexp_full_match(currency, '[A-Z]{{3}}') THEN '{I.MSG_CURRENCY_CODE}' END,
    CASE WHEN customer_id IS NULL OR NOT regexp_matches(customer_id, '[^\x00-\x20]') THEN '{I.MSG_CUSTOMER_BLANK}' END,
    CASE WHEN length(customer_id) > 64 THEN '{I.MSG_CUSTOMER_SIZE}' END,
    CASE WHEN card_last4 IS NOT NULL AND NOT regexp_full_match(card_last4, '[0-9]{{4}}') THEN '{I.MSG_CARD}' END,
    CASE WHEN country IS NOT NULL AND NOT regexp_full_match(country, '[A-Z]{{2}}') THEN '{I.MSG_COUNTRY}' END,
    CASE WHEN length(merchant) > 128 THEN '{I.MSG_MERCHANT_SIZE}' END
  ], lambda x: x IS NOT NULL) AS violations
  FROM requests),
valid AS (SELECT * FROM vreq WHERE len(violations) = 0),
winners AS (
  SELECT idempotency_key, request_id, received_at, n_requests FROM (
    SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY received_at, request_id) AS rn,
           count(*) OVER (PARTITION BY idempotency_key) AS n_requests
    FROM valid) WHERE rn = 1)"""


def _validated(ds):
    return I.validate_requests(ds.requests)


@query("validate_requests", VALIDATION_SQL + """
SELECT request_id, len(violations) = 0 AS valid, CAST(len(violations) AS BIGINT) AS n_violations,
       array_to_string(violations, '; ') AS violations_text
FROM vreq""")
def validate_requests(ds):
    """P1 + P2: every request with its ordered violations."""
    v = _validated(ds)
    return v.select("request_id", "valid", F.size("violations").cast("bigint").alias("n_violations"),
                    join_text(F.col("violations")).alias("violations_text"))


@query("rejected_requests", VALIDATION_SQL + """
SELECT request_id, idempotency_key, array_to_string(violations, '; ') AS violations_text
FROM vreq WHERE len(violations) > 0""")
def rejected_requests(ds):
    """P1 + P2 split: the rejected side (missing key or invalid body)."""
    v = _validated(ds).filter(~F.col("valid"))
    return v.select("request_id", "idempotency_key", join_text(F.col("violations")).alias("violations_text"))


@query("validate_eval_input", r"""
SELECT 'p' || request_id AS payment_id, len(v) = 0 AS valid, array_to_string(v, '; ') AS violations_text
FROM (SELECT request_id, list_filter([
    CASE WHEN amount IS NULL THEN 'amount: must not be null' END,
    CASE WHEN amount <= 0 THEN 'amount: must be greater than 0' END,
    CASE WHEN currency IS NULL OR NOT regexp_matches(currency, '[^\x00-\x20]') THEN 'currency: must not be blank' END,
    CASE WHEN customer_id IS NULL OR NOT regexp_matches(customer_id, '[^\x00-\x20]') THEN 'customerId: must not be blank' END
  ], lambda x: x IS NOT NULL) AS v FROM requests)""")
def validate_eval_input(ds):
    """Evaluation-input checks on every request seen as a triage input."""
    r = ds.requests.withColumn("payment_id", F.concat(F.lit("p"), F.col("request_id").cast("string")))
    v = r.withColumn("_v", I.eval_input_violations())
    return v.select("payment_id", (F.size("_v") == 0).alias("valid"),
                    join_text(F.col("_v")).alias("violations_text"))


@query("first_writer_wins", VALIDATION_SQL + """
SELECT idempotency_key, request_id, n_requests FROM winners""")
def first_writer_wins(ds):
    """First valid request per key (ties by request id); null keys never dedupe."""
    v = _validated(ds).filter("valid")
    return I.first_writer_wins(v).select("idempotency_key", "request_id", "n_requests")


_PAY_ID = sql_uuid("idempotency_key", "'payment'")
_EVT_ID = sql_uuid("idempotency_key", "'requested-event'")


@query("ingest_payments", VALIDATION_SQL + f""",
firsts AS (SELECT v.* FROM valid v JOIN winners w USING (idempotency_key, request_id))
SELECT {_PAY_ID} AS payment_id, idempotency_key, amount, currency, customer_id, card_last4, country,
       merchant, 'RECEIVED' AS status, received_at AS created_at
FROM firsts""", decimals=('amount',))
def ingest_payments(ds):
    """K1 + P4: one RECEIVED payment row per idempotency key."""
    v = _validated(ds).filter("valid")
    return I.new_payments(v).select("payment_id", "idempotency_key", "amount", "currency", "customer_id",
                                    "card_last4", "country", "merchant", "status", "created_at")


def _json_str(col: str) -> str:
    return f"coalesce('\"' || {col} || '\"', 'null')"


@query("ingest_outbox", VALIDATION_SQL + f""",
firsts AS (SELECT v.* FROM valid v JOIN winners w USING (idempotency_key, request_id))
SELECT 'payment' AS aggregate_type, {_PAY_ID} AS aggregate_id, {_EVT_ID} AS event_id,
       'PaymentRequested' AS event_type, 'payments.requested' AS topic, {_PAY_ID} AS message_key,
       '{{"eventId":"' || {_EVT_ID} || '","paymentId":"' || {_PAY_ID} || '","idempotencyKey":"'
         || idempotency_key || '","amount":' || CAST(amount AS VARCHAR) || ',"currency":'
         || {_json_str('currency')} || ',"customerId":' || {_json_str('customer_id')}
         || ',"cardLast4":' || {_json_str('card_last4')} || ',"country":' || {_json_str('country')}
         || ',"merchant":' || {_json_str('merchant')} || '}}' AS payload,
       received_at AS created_at
FROM firsts""")
def ingest_outbox(ds):
    """K2 + P5 + P8: the requested-event outbox row of every new payment."""
    v = _validated(ds).filter("valid")
    return I.requested_outbox(I.new_payments(v))


ACCEPT_SQL = VALIDATION_SQL + """,
nxt AS (
  SELECT request_id, nxt_id FROM (
    SELECT a.request_id, b.request_id AS nxt_id,
           row_number() OVER (PARTITION BY a.request_id ORDER BY b.received_at, b.request_id) AS rn
    FROM valid a LEFT JOIN valid b ON a.idempotency_key = b.idempotency_key
         AND b.received_at >= a.received_at + INTERVAL 24 HOUR) WHERE rn = 1),
chain AS (
  SELECT request_id FROM winners
  UNION ALL
  SELECT n.nxt_id FROM chain c JOIN nxt n ON n.request_id = c.request_id WHERE n.nxt_id IS NOT NULL),
classes AS (
  SELECT v.request_id, v.idempotency_key,
         CASE WHEN w.request_id = v.request_id THEN 'created'
              WHEN v.request_id IN (SELECT request_id FROM chain) THEN 'idempotent_db'
              ELSE 'idempotent_redis' END AS accept_result
  FROM valid v JOIN winners w USING (idempotency_key))"""


@query("accept_result", "RECURSIVE" + ACCEPT_SQL + f"""
SELECT request_id, idempotency_key, {_PAY_ID} AS payment_id, accept_result, 'RECEIVED' AS status
FROM classes""")
def accept_result(ds):
    """S8 + J3 + P9 + Q17-Q19: answer (payment id, status, class) for every accepted request."""
    v = _validated(ds).filter("valid")
    return I.accept_classes(v)


@query("accepted_by_result", "RECURSIVE" + ACCEPT_SQL + """
SELECT accept_result, count(*) AS n FROM classes GROUP BY accept_result""")
def accepted_by_result(ds):
    """A4: accepted requests per answer class."""
    v = _validated(ds).filter("valid")
    return I.accept_classes(v).groupBy("accept_result").agg(F.count(F.lit(1)).alias("n"))


@query("payment_by_idem_key", """
SELECT r.request_id, r.idempotency_key, p.payment_id
FROM requests r LEFT JOIN stored_payments p ON r.idempotency_key = p.idempotency_key
WHERE r.idempotency_key IS NOT NULL""")
def payment_by_idem_key(ds):
    """Secondary-key lookup of every keyed request in the payments table."""
    r = ds.requests.filter(F.col("idempotency_key").isNotNull())
    p = ds.stored_payments.select("idempotency_key", "payment_id")
    return r.join(p, "idempotency_key", "left").select("request_id", "idempotency_key", "payment_id")


@query("payment_by_id", """
SELECT v.payment_id, p.status, p.amount FROM verdicts v JOIN stored_payments p USING (payment_id)""", decimals=('amount',))
def payment_by_id(ds):
    """Primary-key lookup of many ids (the verdicts' payment ids) by an inner join."""
    p = ds.stored_payments.select("payment_id", "status", "amount")
    return ds.verdicts.select("payment_id").join(p, "payment_id")


@query("payments_scan", """
SELECT payment_id, customer_id, amount, status FROM stored_payments""", decimals=('amount',))
def payments_scan(ds):
    """S3: table scan with a declared schema (only the projected columns are read)."""
    return ds.stored_payments.select("payment_id", "customer_id", "amount", "status")


@query("request_intake", """
SELECT request_id, idempotency_key, amount, currency, customer_id, card_last4, country, merchant
FROM requests""", decimals=('amount',))
def request_intake(ds):
    """Landing rows ``(idempotency_key, body, received_at)`` decoded with the declared body schema."""
    parsed = parse_intake(intake_bodies(ds.requests))
    return parsed.select("request_id", "idempotency_key", "amount", "currency", "customer_id",
                         "card_last4", "country", "merchant")
