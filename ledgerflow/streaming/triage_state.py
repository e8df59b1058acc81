"""Streaming triage (T1): sliding state per customer, kept by hash bucket of customers.

``applyInPandasWithState`` keyed by a bucket of customers. The state of a bucket holds, as
one Arrow table, each customer's retained history (at most ``max_history`` rows, trimmed
to ``retention_windows`` windows) plus rows that arrived but are not yet safe to fold: a
row is folded once the event-time watermark has passed it, so rows are folded in event
order even when a micro-batch delivers them out of order. An event-time timeout releases
buffered rows of buckets that receive nothing new. Rows behind the watermark are dropped
by Spark before the state function and counted in the query progress
(``numRowsDroppedByWatermark``); a row that still reaches the fold behind its customer's
last folded row is emitted with ``late = true`` and no features, never folded out of
order. So is a row without a time, where ``keep_late`` lets it pass Spark's filter.

The fold is the deque of the original (read previous country and prior average, append,
trim, count inside the window), for all rows of a bucket at once: a customer's rows stand
side by side in order, and the deque after each is a range of them. A key per customer
cost a call, a data frame and a state of its own for the few rows that a micro-batch
brings each customer. Features feed the same Column rules as the batch path, so streaming
results equal batch results.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import DEFAULT_RULES, RuleConfig

FAR_FUTURE = "2200-01-01 00:00:00"   # inside the pandas timestamp range

# Arrow output of groups with all-null feature columns trips a pandas notice
# inside the PySpark serializer; it does not affect results.
warnings.filterwarnings("ignore", category=FutureWarning, module="pyspark.sql.pandas.serializers")

OUTPUT_SCHEMA = (
    "payment_id string, customer_id string, created_at timestamp, event_id bigint, amount decimal(19,4), "
    "currency string, country string, velocity_count bigint, geo_distinct bigint, previous_country string, "
    "avg_prior_amount decimal(19,2), history_retained bigint, late boolean")

#: Buckets of customers; the checkpoint keeps them, so a stream has the same number for life.
BUCKETS = 512
STATE_SCHEMA = "rows binary"
_NO_ID = -(1 << 63)                   # stands for a null event id, before all others
_NEVER = -(1 << 62)                   # the time of rows without one, and of the last row of customers without any
#: Amounts below this have ``units`` (of 1/10000); others, and nulls, have ``big`` (null: empty), and no units.
_USUAL = Decimal(10 ** 11)
_USUAL_UNITS = 10 ** 15

_ROWS = pa.schema([("customer_id", pa.string()), ("t", pa.int64()), ("event_id", pa.int64()), ("units", pa.int64()), ("big", pa.string()),
                   ("payment_id", pa.string()), ("currency", pa.string()), ("country", pa.string())])
_STATE = _ROWS.append(pa.field("folded", pa.bool_()))
_FOLDED = ("customer_id string, t bigint, event_id bigint, units bigint, big string, payment_id string, currency string, country string, "
           "velocity_count bigint, geo_distinct bigint, previous_country string, avg_cents bigint, averaged bigint, "
           "history_retained bigint, late boolean")


# Spark looks for this key on a column to filter rows behind the watermark.
_WATERMARK_KEY = "spark.watermarkDelayMs"


def _codes(column: pa.ChunkedArray, null: str) -> np.ndarray:
    """A number for each value; nulls have one too (``null="encode"``) or -1 (``null="mask"``)."""
    codes = column.combine_chunks().dictionary_encode(null_encoding=null).indices
    return codes.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _amounts(units: np.ndarray, big: pa.ChunkedArray, max_history: int) -> tuple[np.ndarray, np.ndarray]:
    """Units as numbers whose sums over a history are exact, and which are not null."""
    if big.null_count == len(big) and 4 * _USUAL_UNITS * max_history < 1 << 63:
        return units, np.ones(len(units), bool)
    told = big.to_pylist()
    exact = np.array([u if b is None else int(Decimal(b) * 10000) if b else 0 for u, b in zip(units.tolist(), told)], object)
    return exact, np.array([b != "" for b in told], bool)


def deque_features(customer: np.ndarray, t: np.ndarray, units: np.ndarray, known: np.ndarray, country: np.ndarray,
                   cfg: RuleConfig, idle_us: int | None = None) -> dict[str, np.ndarray]:
    """What the deque has after each row: ``kept`` and ``inside`` (the first row that it, or its window, has),
    ``geo``, ``start`` (the customer's first row), ``cents`` and ``averaged`` (mean of what it had before, and of
    how many). Rows are in order by customer and time; ``units`` count where ``known``; ``country`` is -1 if null."""
    n, h = len(t), cfg.max_history
    window, keep = cfg.window_seconds * 1_000_000, cfg.window_seconds * cfg.retention_windows * 1_000_000
    at = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = customer[1:] != customer[:-1]
    if idle_us is not None:
        new[1:] |= t[1:] > t[:-1] + idle_us                  # idle longer than the TTL: forgotten
    start = np.maximum.accumulate(np.where(new, at, 0)) if n else at
    run = np.cumsum(new)
    times, rank = np.unique(t, return_inverse=True)
    place = run * (len(times) + 1) + rank

    def since(when: np.ndarray) -> np.ndarray:
        """The first row of each row's customer that is not before a time."""
        return np.searchsorted(place, run * (len(times) + 1) + np.searchsorted(times, when))

    kept = np.maximum(np.maximum(start, at - h + 1), since(t - keep))
    inside = np.maximum(kept, since(t - window))
    # of the rows of a window, those whose country does not come before in it
    order = np.lexsort((at, country, run))
    before = np.full(n, -1)
    again = (run[order][1:] == run[order][:-1]) & (country[order][1:] == country[order][:-1])
    before[order[1:][again]] = order[:-1][again]
    geo = np.zeros(n, np.int64)
    for k in range(min(h, n)):
        j = at - k
        has = j >= inside
        if not has.any():
            break
        j = np.maximum(j, 0)
        geo += has & (country[j] >= 0) & (before[j] < inside)
    prior = np.where(new, at, np.maximum(start, np.concatenate([kept[:1], kept[:-1]])))
    counts, sums = np.concatenate([[0], np.cumsum(known)]), np.concatenate([units[:0], [0], np.cumsum(units)])
    averaged = counts[at] - counts[prior]
    some = np.maximum(averaged, 1)
    cents = (2 * (sums[at] - sums[prior]) + 100 * some) // (200 * some)          # HALF_UP at scale 2 (amounts > 0)
    return {"start": start, "kept": kept, "inside": inside, "geo": geo, "averaged": averaged, "cents": cents.astype(np.int64)}


def make_fold(cfg: RuleConfig, idle_ttl_seconds: int | None = None, keep_late: bool = False):
    """The fold of a bucket of customers. With ``idle_ttl_seconds`` a customer idle for longer
    than that in event time is forgotten: a row arriving later starts from an
    empty history, and the history of a customer with nothing buffered is removed once the watermark
    passes the customer's last row plus the TTL (off by default: the original
    never forgets a customer). A customer without state may have been forgotten, so
    with ``keep_late`` and a TTL a row older than the TTL before the watermark is late."""
    idle_us = None if idle_ttl_seconds is None else idle_ttl_seconds * 1_000_000

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = restored(state.get[0]) if state.exists else _STATE.empty_table()
        fresh = [pa.Table.from_pandas(pdf[_ROWS.names], _ROWS, preserve_index=False) for pdf in pdfs]
        fresh = [x.append_column(_STATE.field("folded"), pa.array(np.zeros(len(x), bool))) for x in fresh]
        rows = pa.concat_tables([known, *fresh]).combine_chunks()
        watermark_us = state.getCurrentWatermarkMs() * 1000
        t, folded = rows["t"].to_numpy(), rows["folded"].to_numpy()
        customer = _codes(rows["customer_id"], "encode")
        last = np.full(len(rows) + 1, _NEVER)                # of each customer, folded by earlier micro-batches
        np.maximum.at(last, customer[folded], t[folded])
        if keep_late and idle_us is not None:
            here = np.zeros(len(last), bool)
            here[customer[:len(known)]] = True
            last[~here] = watermark_us - idle_us
        ready = ~folded & (t <= watermark_us)
        late = ready & (t <= last[customer])
        # side by side in order; of rows folded before, the order that they have
        some = np.flatnonzero(folded | ready & ~late)
        some = some[np.lexsort((np.where(folded[some], 0, rows["event_id"].to_numpy()[some]), t[some], customer[some]))]
        country, (units, counted) = _codes(rows["country"], "mask"), _amounts(rows["units"].to_numpy(), rows["big"], cfg.max_history)
        f = deque_features(customer[some], t[some], units[some], counted[some], country[some], cfg, idle_us)
        at, out = np.arange(len(some)), np.flatnonzero(~folded[some])
        if len(out):
            told = rows.take(some[out]).select(_ROWS.names).to_pandas()
            previous = rows["country"].take(some[np.maximum(out - 1, 0)]).to_numpy().copy()
            previous[f["start"][out] == out] = None
            yield told.assign(velocity_count=(at + 1 - f["inside"])[out], geo_distinct=f["geo"][out], previous_country=previous,
                              avg_cents=f["cents"][out], averaged=f["averaged"][out],
                              history_retained=(at + 1 - f["kept"])[out], late=False)
        if late.any():
            yield rows.filter(pa.array(late)).select(_ROWS.names).to_pandas().assign(
                velocity_count=0, geo_distinct=0, previous_country=None, avg_cents=0, averaged=0, history_retained=0, late=True)
        # what each customer's deque has at the end
        waits = np.flatnonzero(~folded & ~ready)
        ends = np.flatnonzero(np.append(customer[some][1:] != customer[some][:-1], True)) if len(some) else at
        oldest = np.repeat(f["kept"][ends], np.diff(ends, prepend=-1))
        stays, timers = at >= oldest, list(t[waits] // 1000 + 1)
        if idle_us is not None:
            buffered = np.zeros(len(last), bool)
            buffered[customer[waits]] = True
            idle_ms = (t[some][ends] + idle_us) // 1000
            gone = ~buffered[customer[some][ends]] & (watermark_us // 1000 >= idle_ms)       # idle customers: forget the history
            stays &= ~np.repeat(gone, np.diff(ends, prepend=-1))
            timers += list(np.maximum(idle_ms[~gone], watermark_us // 1000 + 1))
        history = rows.take(some[stays])
        blank = {c: pa.nulls(len(history), pa.string()) for c in ("payment_id", "currency")} | {"folded": pa.array(np.ones(len(history), bool))}
        history = pa.table([blank.get(c, history[c]) for c in _STATE.names], schema=_STATE)
        keep = pa.concat_tables([history, rows.take(waits)])
        if len(keep):
            state.update((stored(keep),))
            if timers:
                state.setTimeoutTimestamp(int(min(timers)))
        elif state.exists:
            state.remove()

    return fold


def stored(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def restored(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def stream_activity(stream: DataFrame, cfg: RuleConfig = DEFAULT_RULES, delay: str = "10 minutes",
                    idle_ttl_seconds: int | None = None, keep_late: bool = False) -> DataFrame:
    """Activity features over a payments stream (needs ``payment_id, customer_id,
    created_at, event_id, amount, currency, country``). ``idle_ttl_seconds``
    bounds state growth by evicting idle customers (default: never).

    With ``keep_late`` every input row comes out, folded or with ``late = true``:
    the watermark still follows ``created_at``, but the column that Spark filters
    late rows by is never behind it."""
    passing = F.greatest("created_at", F.lit(FAR_FUTURE).cast("timestamp"))
    clock = passing.alias("_passing", metadata={_WATERMARK_KEY: 0}) if keep_late else F.col("created_at")
    amount = F.col("amount").cast("decimal(19,4)")
    usual = F.coalesce(F.abs(amount) < F.lit(_USUAL), F.lit(False))
    src = (stream.withColumn("created_at", F.col("created_at").cast("timestamp"))
           .withWatermark("created_at", delay)
           .select(F.pmod(F.xxhash64("customer_id"), F.lit(BUCKETS)).alias("bucket"), clock, "payment_id", "customer_id",
                   F.coalesce(F.unix_micros("created_at"), F.lit(_NEVER)).alias("t"), F.coalesce("event_id", F.lit(_NO_ID)).alias("event_id"),
                   F.when(usual, (amount * 10000).cast("bigint")).otherwise(F.lit(0)).alias("units"),
                   F.when(~usual, F.coalesce(amount.cast("string"), F.lit(""))).alias("big"), "currency", "country"))
    out = src.groupBy("bucket").applyInPandasWithState(
        make_fold(cfg, idle_ttl_seconds, keep_late), _FOLDED, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    on_time = lambda c: F.when(~F.col("late"), F.col(c)).alias(c)
    return out.select(
        "payment_id", "customer_id", F.timestamp_micros(F.nullif("t", F.lit(_NEVER))).alias("created_at"), F.nullif("event_id", F.lit(_NO_ID)).alias("event_id"),
        F.when(F.col("big").isNull(), F.expr("units * 0.0001BD")).otherwise(F.nullif("big", F.lit("")).cast("decimal(19,4)"))
        .cast("decimal(19,4)").alias("amount"), "currency", "country", on_time("velocity_count"), on_time("geo_distinct"),
        "previous_country", F.when(F.col("averaged") > 0, F.expr("avg_cents * 0.01BD").cast("decimal(19,2)")).alias("avg_prior_amount"),
        on_time("history_retained"), "late")
