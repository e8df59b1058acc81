"""DuckDB SQL for the derived test views (oracle side).

Independent re-statement of ``ledgerflow.sources.views`` over the
pre-registered parquet views (``events`` ...). Every oracle query is
``WITH <VIEWS>, ... SELECT ...``; unused CTEs cost nothing.
"""

VIEWS = """
base AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
payments AS (
  SELECT 'p' || event_id AS payment_id, event_id, ts AS created_at,
         CAST(user_id AS VARCHAR) AS customer_id,
         greatest(CAST(round(value * 100, 2) AS DECIMAL(19,4)), CAST(0.01 AS DECIMAL(19,4))) AS amount,
         'USD' AS currency,
         CASE WHEN k % 2 = 0 THEN NULL ELSE lpad(CAST((k * 101) % 10000 AS VARCHAR), 4, '0') END AS card_last4,
         CASE WHEN k < 94 THEN 'US' WHEN k < 97 THEN 'GB' WHEN k < 99 THEN 'DE' END AS country,
         event_type AS merchant
  FROM base),
stored_payments AS (
  SELECT payment_id, 'key-' || event_id AS idempotency_key, amount, currency, customer_id,
         card_last4, country, merchant, 'RECEIVED' AS status, created_at, event_id
  FROM payments WHERE event_id % 53 <> 0),
requests AS (
  SELECT event_id AS request_id, ts AS received_at,
         CASE WHEN event_id % 97 = 0 THEN NULL
              WHEN event_id % 10 = 7 THEN 'far-' || user_id
              WHEN event_id % 10 = 3 THEN 'key-' || (event_id - 3)
              ELSE 'key-' || event_id END AS idempotency_key,
         CASE WHEN event_id % 103 = 7 THEN NULL
              WHEN event_id % 101 = 5 THEN CAST(0 AS DECIMAL(19,4))
              ELSE CAST(round(value * 100, 2) AS DECIMAL(19,4)) END AS amount,
         CASE WHEN event_id % 89 = 1 THEN 'usd' ELSE 'USD' END AS currency,
         CASE WHEN event_id % 83 = 4 THEN '  ' ELSE CAST(user_id AS VARCHAR) END AS customer_id,
         CASE WHEN event_id % 79 = 6 THEN '12a4' WHEN k % 2 = 0 THEN NULL
              ELSE lpad(CAST((k * 101) % 10000 AS VARCHAR), 4, '0') END AS card_last4,
         CASE WHEN event_id % 73 = 8 THEN 'usa' WHEN k < 94 THEN 'US' WHEN k < 97 THEN 'GB'
              WHEN k < 99 THEN 'DE' END AS country,
         event_type AS merchant
  FROM base),
deliveries AS (
  SELECT p.*, d.d AS delivery, event_id % 4 AS partition, (event_id // 4) * 3 + d.d - 1 AS "offset",
         'e' || event_id AS ev_id, event_id % 61 = 0 AS bad_payload,
         p.created_at + to_seconds(d.d - 1) AS delivered_at
  FROM payments p, (SELECT unnest([1, 2, 3]) AS d) d
  WHERE d.d = 1 OR (d.d = 2 AND event_id % 7 = 0) OR (d.d = 3 AND event_id % 49 = 0)),
claimed AS (
  SELECT 'e' || event_id AS event_id, ts AS processed_at FROM base WHERE event_id % 11 = 0),
verdicts AS (
  SELECT 'p' || event_id AS payment_id,
         CASE event_id % 9 WHEN 0 THEN 'BLOCK' WHEN 3 THEN 'APPROVE' END AS decision,
         CASE WHEN event_id % 303 = 0 THEN 'NaN'::DOUBLE ELSE (event_id % 131) / 100.0 END AS risk_score,
         CASE WHEN event_id % 4 = 0 THEN NULL ELSE ['model: pattern ' || (event_id % 5)] END AS reasons
  FROM base WHERE event_id % 3 = 0),
http_log AS (
  SELECT event_id, ts,
         CASE WHEN event_type = 'error' AND k < 20 THEN 500 WHEN event_id % 97 = 0 THEN 400 ELSE 202 END AS status,
         value AS latency_ms
  FROM base),
outbox AS (
  SELECT event_id + 1 AS id, 'payment' AS aggregate_type, payment_id AS aggregate_id,
         'e' || event_id AS event_id, 'PaymentRequested' AS event_type, 'payments.requested' AS topic,
         payment_id AS message_key, customer_id, created_at,
         '{"eventId":"e' || event_id || '","paymentId":"' || payment_id || '","idempotencyKey":"key-' || event_id
           || '","amount":' || CAST(amount AS VARCHAR) || ',"currency":"' || currency || '","customerId":"' || customer_id
           || '","cardLast4":' || coalesce('"' || card_last4 || '"', 'null') || ',"country":' || coalesce('"' || country || '"', 'null')
           || ',"merchant":"' || merchant || '"}' AS payload
  FROM payments),
outbox_published AS (
  SELECT 'e' || event_id AS event_id, event_id // 100 AS batch_id, ts + INTERVAL 1 SECOND AS published_at
  FROM base WHERE event_id % 5 <> 0)
"""


def with_views(body: str) -> str:
    """Prefix a query body with the views. A body may start with ``RECURSIVE``
    (it then owns a recursive CTE) and with more CTEs led by a comma."""
    body = body.strip()
    head = "WITH "
    if body.startswith("RECURSIVE"):
        head, body = "WITH RECURSIVE ", body[len("RECURSIVE"):].strip()
    return head + VIEWS.strip() + "\n" + body
