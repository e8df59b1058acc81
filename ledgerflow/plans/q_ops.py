"""Registered queries: outbox relay, audits and operational metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import audit as A
from ..operators import metrics as M
from ..operators import publish as PB
from .q_process import DECIDED_SQL, PROC_SQL, _run
from .registry import query

# ---------------------------------------------------------------- relay


@query("outbox_pending", """
SELECT id, event_id, topic FROM outbox
WHERE topic IN ('payments.requested') AND event_id NOT IN (SELECT event_id FROM outbox_published)
ORDER BY id LIMIT 100""")
def outbox_pending(ds):
    """S6 + O1 + U3: the next relay batch, oldest 100 unpublished rows of the owned topics."""
    rows = PB.oldest_pending(ds.outbox, ds.outbox_published, [S.TOPIC_REQUESTED])
    return rows.select("id", "event_id", "topic")


@query("outbox_publish", """
SELECT event_id, topic, message_key AS key, CAST(1 AS BIGINT) AS batch_id FROM outbox
WHERE event_id NOT IN (SELECT event_id FROM outbox_published)""")
def outbox_publish(ds):
    """K6 + K7 + T4: publish every pending row (key = payment id) and stamp it in batch 1."""
    rows = PB.pending(ds.outbox, ds.outbox_published).withColumnRenamed("message_key", "key")
    return PB.stamps(rows, 1, keep=("topic", "key")).drop("published_at")


# ---------------------------------------------------------------- audits

_PAYAFTER_SQL = """,
after AS (
  SELECT p.payment_id, p.customer_id,
         CASE WHEN d.decision IS NULL THEN p.status ELSE d.status END AS status
  FROM stored_payments p LEFT JOIN decided d USING (payment_id)),
outs AS (
  SELECT p.customer_id, d.payment_id, count(*) AS n
  FROM decided d JOIN stored_payments p USING (payment_id) GROUP BY 1, 2)"""


def _processed(ds, once=False):
    r = _run(ds, once=once)
    return r.payments_after, r.outcome_outbox


@query("audit_counts", DECIDED_SQL + _PAYAFTER_SQL + """
SELECT customer_id, count(*) AS created,
       count(*) FILTER (WHERE status IN ('PROCESSED', 'BLOCKED')) AS terminal
FROM after GROUP BY customer_id""")
def audit_counts(ds):
    """A1 + P10: created and terminal payments per run (customer)."""
    pay, _ = _processed(ds)
    return A.audit_counts(pay)


@query("audit_outcomes", DECIDED_SQL + _PAYAFTER_SQL + """
SELECT customer_id, CAST(sum(n) AS BIGINT) AS outcome_events FROM outs GROUP BY customer_id""")
def audit_outcomes(ds):
    """Outcome events joined to their payments, per run."""
    _, out = _processed(ds)
    return A.audit_outcomes(out, ds.stored_payments)


@query("audit_duplicates", DECIDED_SQL + _PAYAFTER_SQL + """
SELECT customer_id, count(*) FILTER (WHERE n > 1) AS duplicated_payments FROM outs GROUP BY customer_id""")
def audit_duplicates(ds):
    """A2: payments with more than one outcome event, per run."""
    _, out = _processed(ds)
    return A.audit_duplicates(out, ds.stored_payments)


@query("audit_verdict", DECIDED_SQL + _PAYAFTER_SQL + """,
c AS (SELECT customer_id, count(*) AS created,
             count(*) FILTER (WHERE status IN ('PROCESSED', 'BLOCKED')) AS terminal
      FROM after GROUP BY customer_id),
o AS (SELECT customer_id, CAST(sum(n) AS BIGINT) AS outcome_events, count(*) FILTER (WHERE n > 1) AS duplicated_payments
      FROM outs GROUP BY customer_id)
SELECT c.customer_id, c.created, c.terminal, coalesce(o.outcome_events, 0) AS outcome_events,
       coalesce(o.duplicated_payments, 0) AS duplicated_payments,
       c.created = c.terminal AND c.terminal = coalesce(o.outcome_events, 0)
         AND coalesce(o.duplicated_payments, 0) = 0 AS passed
FROM c LEFT JOIN o USING (customer_id)""")
def audit_verdict(ds):
    """A3: loss / duplicate verdict per run (created = terminal = outcomes, no duplicates)."""
    pay, out = _processed(ds, once=True)
    return A.audit_verdict(out, pay, lookup=ds.stored_payments)


@query("delete_by_key", """
SELECT id, event_id FROM outbox
WHERE aggregate_id NOT IN (SELECT payment_id FROM verdicts WHERE decision = 'BLOCK')""")
def delete_by_key(ds):
    """K10 + J5: delete outbox rows whose payment is in a key set (here: BLOCK verdicts)."""
    keys = ds.verdicts.filter(F.col("decision") == "BLOCK")
    return A.delete_by_key(ds.outbox, keys, "aggregate_id", "payment_id").select("id", "event_id")


@query("keep_by_key", """
SELECT id, event_id FROM outbox
WHERE aggregate_id IN (SELECT payment_id FROM verdicts WHERE decision = 'BLOCK')""")
def keep_by_key(ds):
    """``IN (SELECT ..)`` as a semi join."""
    keys = ds.verdicts.filter(F.col("decision") == "BLOCK")
    return A.keep_by_key(ds.outbox, keys, "aggregate_id", "payment_id").select("id", "event_id")


# ---------------------------------------------------------------- metrics

@query("latency_percentiles", """,
s AS (SELECT latency_ms AS v, row_number() OVER (ORDER BY latency_ms) - 1 AS idx,
             count(*) OVER () AS n FROM http_log WHERE latency_ms IS NOT NULL)
SELECT max(v) FILTER (WHERE idx = least(n - 1, round_even((n - 1) * 0.5::DOUBLE, 0))) AS p50,
       max(v) FILTER (WHERE idx = least(n - 1, round_even((n - 1) * 0.95::DOUBLE, 0))) AS p95,
       max(v) FILTER (WHERE idx = least(n - 1, round_even((n - 1) * 0.99::DOUBLE, 0))) AS p99,
       max(v) AS max, max(n) AS n
FROM s""")
def latency_percentiles(ds):
    """A9 + O3: nearest-rank p50/p95/p99 and max of request latency (exact)."""
    return M.nearest_rank_percentiles(ds.http_log, "latency_ms")


@query("throughput", """
SELECT count(*) AS rows, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds,
       count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS rows_per_sec
FROM http_log""")
def throughput(ds):
    """A10: accepted requests per second over the log's span."""
    return M.throughput(ds.http_log, "ts")


@query("drain_throughput", DECIDED_SQL + """
SELECT count(*) AS rows, (epoch_us(max(delivered_at)) - epoch_us(min(delivered_at))) / 1e6 AS seconds,
       count(*) / ((epoch_us(max(delivered_at)) - epoch_us(min(delivered_at))) / 1e6) AS rows_per_sec
FROM decided""")
def drain_throughput(ds):
    """A10: processed payments per second (drain rate)."""
    return M.throughput(_run(ds).claims.withColumnRenamed("processed_at", "ts"), "ts")


def _bucket_sql(col: str) -> str:
    cases = " ".join(f"WHEN {col} <= {b} THEN {b}::DOUBLE" for b in M.LATENCY_BUCKETS_MS)
    return f"CASE {cases} ELSE 'inf'::DOUBLE END"


def _lower_sql(col: str) -> str:
    prev = (0.0,) + M.LATENCY_BUCKETS_MS[:-1]
    cases = " ".join(f"WHEN {col} = {b} THEN {p}::DOUBLE" for p, b in zip(prev, M.LATENCY_BUCKETS_MS))
    return f"CASE {cases} ELSE {M.LATENCY_BUCKETS_MS[-1]}::DOUBLE END"


def _hq_sql(q: float, tag: str) -> str:
    return f"""
  h{tag} AS (
    SELECT window_start, arg_min(le, le) AS le, arg_min(c, le) AS c, arg_min(cum, le) AS cum, max(total) AS total
    FROM cum WHERE cum >= total * {q}::DOUBLE GROUP BY window_start)"""


@query("latency_histogram_quantile", f""",
b AS (SELECT make_timestamp((epoch_us(ts) // 300000000) * 300000000) AS window_start,
             {_bucket_sql('latency_ms')} AS le FROM http_log),
g AS (SELECT window_start, le, count(*) AS c FROM b GROUP BY 1, 2),
cum AS (SELECT *, sum(c) OVER (PARTITION BY window_start ORDER BY le) AS cum,
               CAST(sum(c) OVER (PARTITION BY window_start) AS BIGINT) AS total FROM g),
{_hq_sql(0.5, '50').strip()},
{_hq_sql(0.99, '99').strip()}
SELECT h50.window_start, h50.total,
       CASE WHEN h50.le = 'inf'::DOUBLE THEN {M.LATENCY_BUCKETS_MS[-1]}::DOUBLE
            ELSE {_lower_sql('h50.le')} + (h50.le - {_lower_sql('h50.le')})
                 * ((h50.total * 0.5::DOUBLE - (h50.cum - h50.c)) / h50.c) END AS p50,
       CASE WHEN h99.le = 'inf'::DOUBLE THEN {M.LATENCY_BUCKETS_MS[-1]}::DOUBLE
            ELSE {_lower_sql('h99.le')} + (h99.le - {_lower_sql('h99.le')})
                 * ((h99.total * 0.99::DOUBLE - (h99.cum - h99.c)) / h99.c) END AS p99
FROM h50 JOIN h99 USING (window_start)""")
def latency_histogram_quantile(ds):
    """p50 / p99 by bucket interpolation per 5-minute window."""
    return M.histogram_quantiles(ds.http_log, "ts", "latency_ms")


@query("error_rate", """
SELECT make_timestamp((epoch_us(ts) // 60000000) * 60000000) AS window_start,
       count(*) FILTER (WHERE status >= 500) AS errors, count(*) AS requests,
       100 * (count(*) FILTER (WHERE status >= 500) / 60) / greatest(count(*) / 60, 1.0) AS error_pct
FROM http_log GROUP BY 1""")
def error_rate(ds):
    """5xx percentage per minute with the rate denominator clamped to 1/s."""
    return M.error_rate(ds.http_log)


def _sliding_sql(ts: str, length_s: int, slide_s: int) -> str:
    n = length_s // slide_s
    return (f"make_timestamp((epoch_us({ts}) // {slide_s * 1_000_000}) * {slide_s * 1_000_000} "
            f"- k * {slide_s * 1_000_000})"), f"(SELECT unnest(range(0, {n})) AS k) kk"


_S1, _K1 = _sliding_sql("ts", 60, 10)


@query("rate_1m", f"""
SELECT {_S1} AS window_start, count(*) AS events, count(*) / 60 AS rate_per_sec
FROM http_log, {_K1} GROUP BY 1""")
def rate_1m(ds):
    """Accepted requests per second over a 1-minute range, every 10 s."""
    return M.sliding_rate(ds.http_log, "ts")


_S2, _K2 = _sliding_sql("delivered_at", 60, 10)


@query("rate_by_status", DECIDED_SQL + f"""
SELECT {_S2} AS window_start, status, count(*) AS events, count(*) / 60 AS rate_per_sec
FROM decided, {_K2} GROUP BY 1, 2""")
def rate_by_status(ds):
    """Processed payments per second by status over a 1-minute range, every 10 s."""
    return M.sliding_rate(_run(ds).decided, "delivered_at", ["status"])


_S3, _K3 = _sliding_sql("dead_at", 300, 60)


@query("dlq_increase_5m", PROC_SQL + f""",
dl AS (SELECT delivered_at + INTERVAL 7 SECOND AS dead_at FROM dead)
SELECT {_S3} AS window_start, count(*) AS increase FROM dl, {_K3} GROUP BY 1""")
def dlq_increase_5m(ds):
    """Dead letters per 5-minute range, every minute (dead after 1 + 2 + 4 s of retries)."""
    dead = _run(ds).dead_letters.withColumn("dead_at", F.col("delivered_at") + F.expr("INTERVAL 7 SECONDS"))
    return M.sliding_increase(dead, "dead_at")
