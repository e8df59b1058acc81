"""Request intake.

Pipeline: ``requests -> validate (split) -> first writer per key -> payments +
outbox``, and the answer every request gets (``accept_result``).

The answer class follows the original's cache-then-database lookup: the first
request of a key creates the payment and caches ``id|status`` for a TTL
(24 h) anchored at caching time; a replay inside the TTL is answered from the
cache (``idempotent_redis``); the first replay at or after expiry is answered
from the table and re-caches (``idempotent_db``). The re-cache moments form a
chain per key: ``s0`` = first request, ``s(k+1)`` = first request at or after
``s(k) + TTL``. It is computed without collecting a key's requests anywhere:

1. ``next(r)`` = first request of the same key at or after ``t(r) + TTL``, from
   windows partitioned by ``(key, time bucket)`` plus a per-key window over
   bucket minima (bounded by the number of buckets, not rows); each key's
   buckets hold about ``bucket_rows`` requests, so a hot key is split too;
2. the chain from ``s0`` is marked by pointer doubling: jump tables
   ``J(j+1) = J(j) o J(j)`` by self-joins, then a descent from ``s0``. That is
   ``2 * ceil(log2(chain length))`` joins; each jump table is written to the
   shared checkpoint folder and read back so the lineage stays flat.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import deterministic_uuid, full_match, not_blank, to_json_keep_nulls
from ..session import materialize

_MICROS = 1_000_000

# Fixed violation messages, in check order.
MSG_KEY_REQUIRED = "idempotencyKey: header is required"
MSG_AMOUNT_NULL = "amount: must not be null"
MSG_AMOUNT_POSITIVE = "amount: must be positive"
MSG_CURRENCY_BLANK = "currency: must not be blank"
MSG_CURRENCY_CODE = "currency: must be a 3-letter ISO code"
MSG_CUSTOMER_BLANK = "customerId: must not be blank"
MSG_CUSTOMER_SIZE = "customerId: size must be between 0 and 64"
MSG_CARD = "cardLast4: must be 4 digits"
MSG_COUNTRY = "country: must be a 2-letter ISO code"
MSG_MERCHANT_SIZE = "merchant: size must be between 0 and 128"


def violations(key: Column | None = None) -> Column:
    """P1 + P2: ordered array of violation messages (empty when valid)."""
    amount, currency = F.col("amount"), F.col("currency")
    customer, card = F.col("customer_id"), F.col("card_last4")
    country, merchant = F.col("country"), F.col("merchant")
    checks = []
    if key is not None:
        checks.append(F.when(key.isNull(), F.lit(MSG_KEY_REQUIRED)))
    checks += [
        F.when(amount.isNull(), F.lit(MSG_AMOUNT_NULL)),
        F.when(amount < F.lit(Decimal(S.MIN_AMOUNT)), F.lit(MSG_AMOUNT_POSITIVE)),
        F.when(~not_blank(currency), F.lit(MSG_CURRENCY_BLANK)),
        F.when(currency.isNotNull() & ~full_match(currency, "[A-Z]{3}"), F.lit(MSG_CURRENCY_CODE)),
        F.when(~not_blank(customer), F.lit(MSG_CUSTOMER_BLANK)),
        F.when(F.length(customer) > S.CUSTOMER_ID_MAX, F.lit(MSG_CUSTOMER_SIZE)),
        F.when(card.isNotNull() & ~full_match(card, r"\d{4}"), F.lit(MSG_CARD)),
        F.when(country.isNotNull() & ~full_match(country, "[A-Z]{2}"), F.lit(MSG_COUNTRY)),
        F.when(F.length(merchant) > S.MERCHANT_MAX, F.lit(MSG_MERCHANT_SIZE)),
    ]
    return F.array_compact(F.array(*checks))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Adds ``violations`` (array) and ``valid`` (bool). Requests without key are invalid."""
    return (requests.withColumn("violations", violations(F.col("idempotency_key")))
            .withColumn("valid", F.size("violations") == 0))


def eval_input_violations() -> Column:
    """Evaluation input checks (not blank ids/currency, amount > 0; no patterns)."""
    return F.array_compact(F.array(
        F.when(~not_blank(F.col("payment_id")), F.lit("paymentId: must not be blank")),
        F.when(F.col("amount").isNull(), F.lit(MSG_AMOUNT_NULL)),
        F.when(F.col("amount") <= 0, F.lit("amount: must be greater than 0")),
        F.when(~not_blank(F.col("currency")), F.lit(MSG_CURRENCY_BLANK)),
        F.when(~not_blank(F.col("customer_id")), F.lit(MSG_CUSTOMER_BLANK)),
    ))


def first_writer_wins(valid: DataFrame, key: str = "idempotency_key",
                      order: tuple[str, str] = ("received_at", "request_id")) -> DataFrame:
    """The first request per key, as ``(key, request_id, received_at, n_requests)``.

    A min-by aggregate: partial per map task, so a hot key never reaches one
    task with all of its rows. Null keys are left out (they never dedupe).
    """
    first = F.min(F.struct(*order)).alias("_first")
    return (valid.filter(F.col(key).isNotNull())
            .groupBy(key).agg(first, F.count(F.lit(1)).alias("n_requests"))
            .select(key, F.col("_first.request_id").alias("request_id"),
                    F.col("_first.received_at").alias("received_at"), "n_requests"))


def payment_id_for(key: Column) -> Column:
    """payment id derived from the idempotency key (a replayed run gives the same id)."""
    return deterministic_uuid(key, F.lit("payment"))


def requested_event_id_for(key: Column) -> Column:
    return deterministic_uuid(key, F.lit("requested-event"))


def new_payments(valid: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """K1 + P4: one RECEIVED payment per key not yet in ``existing`` (left anti)."""
    winners = first_writer_wins(valid).select("idempotency_key", "request_id")
    if existing is not None:
        winners = winners.join(existing.select("idempotency_key"), "idempotency_key", "left_anti")
    rows = valid.join(winners, ["idempotency_key", "request_id"], "left_semi")
    return rows.select(
        payment_id_for(F.col("idempotency_key")).alias("payment_id"),
        "idempotency_key", "amount", "currency", "customer_id", "card_last4", "country", "merchant",
        F.lit(S.STATUS_RECEIVED).alias("status"),
        F.lit(None).cast("string").alias("fraud_decision"),
        F.lit(None).cast(S.RISK_DECIMAL).alias("risk_score"),
        F.lit(None).cast("string").alias("fraud_reasons"),
        F.col("received_at").alias("created_at"),
        F.col("received_at").alias("updated_at"),
    )


def requested_event(payments: DataFrame) -> Column:
    """P5: the 9-field requested-event struct of a payment row."""
    return F.struct(
        requested_event_id_for(F.col("idempotency_key")).alias("eventId"),
        F.col("payment_id").alias("paymentId"),
        F.col("idempotency_key").alias("idempotencyKey"),
        "amount", "currency",
        F.col("customer_id").alias("customerId"),
        F.col("card_last4").alias("cardLast4"),
        "country", "merchant")


def requested_outbox(payments: DataFrame) -> DataFrame:
    """K2 + P8: one ``payments.requested`` outbox row per new payment."""
    return payments.select(
        F.lit(S.AGGREGATE_TYPE).alias("aggregate_type"),
        F.col("payment_id").alias("aggregate_id"),
        requested_event_id_for(F.col("idempotency_key")).alias("event_id"),
        F.lit(S.EVENT_TYPE_REQUESTED).alias("event_type"),
        F.lit(S.TOPIC_REQUESTED).alias("topic"),
        F.col("payment_id").alias("message_key"),
        to_json_keep_nulls(requested_event(payments)).alias("payload"),
        "created_at",
    )


# ----------------------------------------------------------------- TTL chain

def _next_pointer(req: DataFrame, ttl_us: int) -> DataFrame:
    """``(rid, nxt)``: first request of the same key at or after ``t + ttl``.

    ``req`` carries each key's bucket origin ``_lo`` and width ``_w``.
    """
    def bucket(c: Column) -> Column:
        return F.floor((c - F.col("_lo")) / F.col("_w"))

    tgt = req.select("k", "t", "rid", bucket(F.col("t")).alias("b"))
    probe = req.select("k", (F.col("t") + ttl_us).alias("x"), F.col("rid").alias("src"), "_lo", "_w")
    probe = probe.select("k", "x", "src", bucket(F.col("x")).alias("b"))
    # (a) inside the probe's bucket: running min over time descending.
    both = (tgt.select("k", "b", F.col("t").alias("time"), F.lit(0).alias("kind"), "rid",
                       F.lit(None).cast("bigint").alias("src"))
            .unionByName(probe.select("k", "b", F.col("x").alias("time"), F.lit(1).alias("kind"),
                                      F.lit(None).cast("bigint").alias("rid"), "src")))
    w = (Window.partitionBy("k", "b").orderBy(F.desc("time"), F.asc("kind"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cand = F.min(F.when(F.col("kind") == 0, F.struct(F.col("time").alias("t"), "rid"))).over(w)
    inside = both.withColumn("c", cand).filter(F.col("kind") == 1).select("src", "k", "b", "c")
    # (b) otherwise the earliest request in a later bucket.
    mins = tgt.groupBy("k", "b").agg(F.min(F.struct("t", "rid")).alias("m"))
    probe_b = probe.select("k", "b").distinct()
    seq = (mins.select("k", "b", F.lit(1).alias("kind"), "m")
           .unionByName(probe_b.select("k", "b", F.lit(0).alias("kind"),
                                       F.lit(None).cast("struct<t:bigint,rid:bigint>").alias("m"))))
    wb = (Window.partitionBy("k").orderBy(F.desc("b"), F.asc("kind"))
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    later = seq.withColumn("lm", F.min("m").over(wb)).filter(F.col("kind") == 0).select("k", "b", "lm")
    return (inside.join(later, ["k", "b"], "left")
            .select(F.col("src").alias("rid"), F.coalesce("c", "lm")["rid"].alias("nxt")))


def _chain_members(starts: DataFrame, nxt: DataFrame, max_len: int) -> DataFrame:
    """Request ids on the chain from each key's start request (pointer doubling).

    Jump table ``J(k)`` maps a request to the one ``2^k`` chain steps later;
    ``J(k+1) = J(k) o J(k)`` references ``J(k)`` twice, so each table is
    written to the shared checkpoint folder and read back (lineage cut). The
    descent from the first request keeps one reference per level (a left join
    then ``explode([self, jump])``), so its plan stays linear in the levels.
    """
    levels = max(1, math.ceil(math.log2(max_len + 1)))
    jumps = [materialize(nxt.select("rid", F.col("nxt").alias("j")), "jump0")]
    for _ in range(1, levels):
        cur = jumps[-1]
        nxt_j = (cur.alias("a").join(cur.alias("b"), F.col("a.j") == F.col("b.rid"), "left")
                 .select(F.col("a.rid").alias("rid"), F.col("b.j").alias("j")))
        jumps.append(materialize(nxt_j, f"jump{len(jumps)}"))
    marked = starts.select("rid")
    for table in reversed(jumps):
        marked = (marked.select("rid").join(table, "rid", "left")
                  .select(F.explode(F.array("rid", "j")).alias("rid"))
                  .filter(F.col("rid").isNotNull()))
    return marked


def accept_classes(valid: DataFrame, ttl_seconds: int = S.IDEMPOTENCY_TTL_SECONDS,
                   bucket_rows: int = 100_000, bucket_seconds: int = 1,
                   key: str = "idempotency_key", existing: DataFrame | None = None,
                   hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A4 / Q17-Q19: answer class and payment for every valid request with a key.

    Output: request_id, idempotency_key, payment_id, accept_result, status.
    Each key's time span is cut into buckets of about ``bucket_rows`` requests
    (at least ``bucket_seconds`` wide) for the next-pointer windows.

    ``existing`` (``idempotency_key, payment_id, status, created_at``) holds
    payments made before this batch: their creation cached the answer, so the
    key's chain starts at the first request at or after ``created_at + TTL``
    (answered from the table), earlier replays are cache hits, and answers carry
    the stored payment id; the table path answers with the stored status.
    """
    ttl_us = ttl_seconds * _MICROS
    req = (valid.filter(F.col(key).isNotNull())
           .select(F.col(key).alias("k"), F.unix_micros("received_at").alias("t"),
                   F.col("request_id").alias("rid")))
    first = F.min(F.struct("t", "rid"))
    starts = req.groupBy("k").agg(first["rid"].alias("rid"), first["t"].alias("_st"))
    old = None
    if existing is not None:
        old = existing.select(F.col(key).alias("k"), F.unix_micros("created_at").alias("_c"),
                              F.col("payment_id").alias("_pid"), F.col("status").alias("_status"))
        reopened = (req.join(old.select("k", "_c"), "k").filter(F.col("t") >= F.col("_c") + ttl_us)
                    .groupBy("k").agg(first["rid"].alias("rid"), first["t"].alias("_st")))
        starts = starts.join(old.select("k"), "k", "left_anti").unionByName(reopened)
    starts = hold(starts)
    # Only keys whose requests span at least one TTL can re-cache more than once;
    # next pointers are computed for those alone (picked by a partial aggregate).
    spans = req.groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.min("t").alias("_lo"),
                                 F.max("t").alias("_hi"))
    width = F.greatest(F.lit(bucket_seconds * _MICROS),
                       ((F.col("_hi") - F.col("_lo")) / F.ceil(F.col("_n") / bucket_rows)).cast("bigint") + 1)
    long_keys = spans.filter(F.col("_hi") - F.col("_lo") >= ttl_us).select("k", "_lo", width.alias("_w"))
    long_req = materialize(req.join(long_keys, "k"), "long_keys")
    # Chain length is bounded by the longest span (one scalar).
    lo, hi = long_req.agg(F.min("t"), F.max("t")).first()
    longest = (hi - lo) if lo is not None else 0
    if longest >= ttl_us:
        chain = _chain_members(starts, _next_pointer(long_req, ttl_us), int(longest // ttl_us) + 1)
    else:
        chain = starts.select("rid")
    out = (valid.filter(F.col(key).isNotNull())
           .join(chain.select(F.col("rid").alias("request_id"), F.lit(True).alias("_on_chain")),
                 "request_id", "left")
           .join(starts.select(F.col("k").alias(key), F.col("rid").alias("_start"), "_st"), key, "left"))
    pid = payment_id_for(F.col(key))
    status = F.lit(S.STATUS_RECEIVED)
    is_new = F.lit(True)
    if old is not None:
        out = out.join(old.select(F.col("k").alias(key), "_pid", "_status"), key, "left")
        is_new = F.col("_pid").isNull()
        pid = F.coalesce(F.col("_pid"), pid)
        # table answers, and cache hits after one, carry the stored status
        reread = F.col("_st").isNotNull() & (F.unix_micros("received_at") >= F.col("_st"))
        status = F.when(~is_new & reread, F.col("_status")).otherwise(status)
    result = (F.when(is_new & (F.col("request_id") == F.col("_start")), "created")
              .when(F.col("_on_chain"), "idempotent_db").otherwise("idempotent_redis"))
    return out.select("request_id", key, pid.alias("payment_id"), result.alias("accept_result"),
                      status.alias("status"))


@dataclass
class Intake:
    payments: DataFrame      # K1: one RECEIVED row per new key
    outbox: DataFrame        # K2: its requested event
    rejected: DataFrame      # P1 + P2: invalid or keyless requests with their violations
    answers: DataFrame       # S8 / A4: payment, status and answer class per accepted request


def ingest_batch(requests: DataFrame, existing: DataFrame | None = None, with_answers: bool = True,
                 hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> Intake:
    """One intake run: ``validate (split) -> first writer per key -> left anti existing
    -> {payments, outbox, rejected}`` plus the answer each accepted request gets.
    ``existing`` is the payments table (answers need ``payment_id, status, created_at``).
    ``hold`` is applied to the frames that several outputs come from; a caller that writes them persists these."""
    checked = hold(validate_requests(requests))
    valid = checked.filter(F.col("valid"))
    rejected = checked.filter(~F.col("valid")).select(
        "request_id", "idempotency_key", "received_at", "violations")
    pays = hold(new_payments(valid, existing))
    answers = accept_classes(valid, existing=existing, hold=hold) if with_answers else None
    return Intake(pays, requested_outbox(pays), rejected, answers)
