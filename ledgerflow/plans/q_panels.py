"""Registered queries: panels over sliding ranges, and peaks of records in flight."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import ranges as R
from ..operators import sequence as SQ
from ..operators.metrics import LATENCY_BUCKETS_MS
from ..operators.pending_bits import PendingIds
from ..session import materialize
from ..streaming.staging import run_folder
from .q_process import DECIDED_SQL, PROC_SQL, _run
from .registry import query


def _ends(ts: str, range_s: int, step_s: int = 15) -> str:
    """A row's range ends: one for each step of a range (the oracle copies rows, the engine sums panes)."""
    us = step_s * 1_000_000
    return f"make_timestamp((epoch_us({ts}) // {us} + 1 + k) * {us}) AS range_end", f"range({range_s // step_s}) kk(k)"


def _quantile_sql(q: float) -> str:
    arms, low = [], 0.0
    for i, b in enumerate(LATENCY_BUCKETS_MS):
        below = f"le_{i - 1}" if i else "0"
        arms.append(f"WHEN le_{i} >= total * {q}::DOUBLE THEN {low}::DOUBLE + {b - low}::DOUBLE * ((total * {q}::DOUBLE - {below}) / (le_{i} - {below}))")
        low = b
    return f"CASE {' '.join(arms)} ELSE {LATENCY_BUCKETS_MS[-1]}::DOUBLE END"


def _latency_sql(source: str, ts: str, value: str, by: str) -> str:
    end, steps = _ends(ts, 300)
    les = ", ".join(f"count(*) FILTER (WHERE {value} <= {b}) AS le_{i}" for i, b in enumerate(LATENCY_BUCKETS_MS))
    return f"""
r AS (SELECT {end}, {by}, {value} FROM {source}, {steps}),
g AS (SELECT range_end, {by}, count({value}) AS total, {les} FROM r GROUP BY ALL)
SELECT range_end, {by}, total, {_quantile_sql(0.5)} AS p50, {_quantile_sql(0.99)} AS p99 FROM g WHERE total > 0"""


@query("create_latency_5m", """,
log AS (SELECT ts, latency_ms, CAST(status // 100 AS INTEGER) AS status_class FROM http_log),""" + _latency_sql("log", "ts", "latency_ms", "status_class"))
def create_latency_5m(ds):
    """p50 / p99 of request latency by status class over the last 5 minutes, every 15 s."""
    log = ds.http_log.withColumn("status_class", F.floor(F.col("status") / 100).cast("int"))
    return R.sliding_quantiles(log, "ts", "latency_ms", by=["status_class"])


_SERVED = "(SELECT event_id, latency_ms FROM http_log)"


@query("processing_latency_5m", DECIDED_SQL + f""",
took AS (SELECT d.delivered_at, d.status, s.latency_ms FROM decided d JOIN {_SERVED} s ON d.ev_id = 'e' || s.event_id),""" +
       _latency_sql("took", "delivered_at", "latency_ms", "status"))
def processing_latency_5m(ds):
    """p50 / p99 of the processing time of claimed events by status over 5 minutes, every 15 s. The
    time that an event takes is the latency logged for it."""
    took = ds.http_log.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), "latency_ms")
    return R.sliding_quantiles(_run(ds).decided.join(took, "event_id"), "delivered_at", "latency_ms", by=["status"])


_E1, _K1 = _ends("ts", 60)


@query("error_rate_1m", f""",
r AS (SELECT {_E1}, status FROM http_log, {_K1})
SELECT range_end, count(*) AS requests, count(*) FILTER (WHERE status >= 500) AS errors,
       100 * (count(*) FILTER (WHERE status >= 500) / 60) / greatest(count(*) / 60, 1.0) AS error_pct FROM r GROUP BY 1""")
def error_rate_1m(ds):
    """5xx percentage over the last minute, every 15 s, the rate of all requests clamped to 1/s."""
    return R.sliding_error_rate(ds.http_log)


_E5, _K5 = _ends("delivered_at", 300)


@query("duplicates_rate_5m", PROC_SQL + f""",
dup AS (SELECT delivered_at FROM ok WHERE ev_id NOT IN (SELECT ev_id FROM orph)
        AND NOT (delivery = 1 AND ev_id IN (SELECT ev_id FROM found))),
r AS (SELECT {_E5} FROM dup, {_K5})
SELECT range_end, count(*) AS events, count(*) / 300 AS rate_per_sec FROM r GROUP BY 1""")
def duplicates_rate_5m(ds):
    """Duplicates skipped per second over the last 5 minutes, every 15 s."""
    return R.sliding_events_rate(_run(ds).duplicates, "delivered_at")


_ED, _KD = _ends("delivered_at", 300)


@query("dead_letters_by_reason_5m", PROC_SQL + f""",
why AS (SELECT delivered_at, CASE WHEN reason LIKE 'Payment not found%' THEN 'payment not found' ELSE 'unparseable' END AS cause FROM dead),
r AS (SELECT {_ED}, cause FROM why, {_KD})
SELECT range_end, cause, count(*) AS events, count(*) / 300 AS rate_per_sec FROM r GROUP BY 1, 2""")
def dead_letters_by_reason_5m(ds):
    """K8: poison records per second by cause over 5 minutes, every 15 s (for alarms)."""
    return R.sliding_events_rate(_run(ds).dead_letters.withColumn("cause", R.cause_of(F.col("reason"))), "delivered_at", by=["cause"])


_PEAK_SQL = """
net AS (SELECT {by}, t, sum(d) AS d FROM (SELECT {by}, s AS t, 1 AS d FROM fl UNION ALL SELECT {by}, e, -1 FROM fl WHERE e IS NOT NULL) GROUP BY 1, 2),
run AS (SELECT {by}, t, CAST(sum(d) OVER (PARTITION BY {by} ORDER BY t) AS BIGINT) AS n FROM net)
SELECT {by}, max(n) AS peak, min(t) FILTER (WHERE n = top) AS peak_at
FROM (SELECT *, max(n) OVER (PARTITION BY {by}) AS top FROM run) GROUP BY {by}"""


@query("consumer_lag", PROC_SQL + """,
fl AS (SELECT CAST(d.partition AS INTEGER) AS partition, d.delivered_at AS s,
              CASE WHEN x."offset" IS NOT NULL THEN d.delivered_at + INTERVAL 7 SECOND
                   ELSE d.delivered_at + to_microseconds(CAST(floor(l.latency_ms * 1000) AS BIGINT)) END AS e
       FROM deliveries d JOIN http_log l USING (event_id)
       LEFT JOIN dead x ON x.partition = d.partition AND x."offset" = d."offset"
       WHERE x."offset" IS NOT NULL OR floor(l.latency_ms * 1000) > 0),""" + _PEAK_SQL.format(by="partition"))
def consumer_lag(ds):
    """The most records of each partition that were delivered and not yet done at once. A record takes
    the time logged for its event, a dead letter its retries (7 s)."""
    log = ds.http_log.select(F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("key"), "latency_ms")
    dead = _run(ds).dead_letters.select("partition", "offset", F.lit(True).alias("dead"))
    rows = ds.deliveries.join(log, "key").join(dead, ["partition", "offset"], "left")
    took = F.when(F.col("dead"), F.lit(7_000_000)).otherwise(F.floor(F.col("latency_ms") * 1000))
    end = F.timestamp_micros(F.unix_micros("delivered_at") + took)
    return R.peak_in_flight(rows, F.col("delivered_at"), end, ["partition"])


@query("outbox_backlog", """,
fl AS (SELECT o.topic, o.created_at AS s, p.published_at AS e FROM outbox o LEFT JOIN outbox_published p USING (event_id)),""" +
       _PEAK_SQL.format(by="topic"))
def outbox_backlog(ds):
    """The most outbox rows of a topic that waited to be published at once, and since when."""
    rows = ds.outbox.select("event_id", "topic", "created_at").join(ds.outbox_published.select("event_id", "published_at"), "event_id", "left")
    return R.peak_in_flight(rows, F.col("created_at"), F.col("published_at"), ["topic"])


@query("latency_sketch", """
SELECT date_trunc('day', ts) AS bucket_start, count(latency_ms) AS n, true AS p50_close, true AS p95_close, true AS p99_close
FROM http_log WHERE latency_ms IS NOT NULL GROUP BY 1""")
def latency_sketch(ds):
    """Sketches of every minute, stored, rolled up to days; whether each quantile's rank is within a
    hundredth of the one asked for, measured on all values."""
    stored = materialize(M.quantile_sketches(ds.http_log, "ts", "latency_ms"), "sketches")
    errors = M.rank_errors(ds.http_log, "ts", "latency_ms", M.rolled_up(stored, "day"), "day")
    return errors.select("bucket_start", "n", *[(F.col(f"p{p}_error") <= 0.01).alias(f"p{p}_close") for p in (50, 95, 99)])


@query("outbox_pending_bits", """
SELECT id, event_id, topic FROM outbox
WHERE event_id NOT IN (SELECT event_id FROM outbox_published)""")
def outbox_pending_bits(ds):
    """S6 + U3: every pending outbox row by the complement of the published ids' bitmaps, which three
    batches of rows and of stamps have left."""
    box = PendingIds(ds.spark, run_folder(ds.spark, "pending_ids"))
    rows = ds.outbox.select("id", "event_id", "topic")
    stamped = rows.join(ds.outbox_published.select("event_id"), "event_id", "left_semi").select("id")
    for n in range(3):
        box.append(rows.filter(F.col("id") % 3 == n), n)
        box.publish(stamped.filter(F.col("id") % 3 == n), n)
    return box.pending("id bigint, event_id string, topic string")


_ORDER_SQL = """,
ordered AS (SELECT id, customer_id AS key, event_id, row_number() OVER (PARTITION BY customer_id ORDER BY created_at, id) AS seq FROM outbox)"""


@query("outbox_ordered", _ORDER_SQL + """
SELECT id, key, event_id, seq FROM ordered""")
def outbox_ordered(ds):
    """T4: each outbox row's number among its customer's rows, read back from the sink's lanes."""
    return _lanes(ds).select("id", "key", "event_id", "seq")


def _lanes(ds):
    rows = ds.outbox.select("id", F.col("customer_id").alias("key"), "event_id", "created_at")
    path = f"{run_folder(ds.spark, 'outbox_lanes')}/lanes"
    SQ.write_lanes(SQ.sequenced(rows, "key", ["created_at", "id"]), path, "key")
    return ds.spark.read.parquet(path)


@query("outbox_order_audit", _ORDER_SQL + """
SELECT key, count(*) AS rows, max(seq) - count(DISTINCT seq) AS gaps, count(*) - count(DISTINCT seq) AS repeats,
       CAST(0 AS BIGINT) AS inversions FROM ordered GROUP BY key""")
def outbox_order_audit(ds):
    """T4: gaps, repeats and inversions of each customer's rows in the sink's lanes."""
    return SQ.order_audit(_lanes(ds), "key", ["created_at", "id"])
