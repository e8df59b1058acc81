"""Streaming triage with customers cut into time slices (T1 for hot customers).

Two keyed steps. The first is keyed by (bucket of customers, slice of time): rows wait in
a list state, to which a micro-batch only appends; when the watermark passes the slice's
end a timer folds it, customer by customer. (Most customers have few rows in a slice: with
a key for each, calls to the state store took most of the run.) A row with a full history
inside its slice gets its features there.
The slice hands on what its neighbours need: its first ``max_history`` rows (heads),
whose history lies in earlier slices, and its last ones (tails), the halo of the next
slice. The second step is keyed by bucket and sees at most twice ``max_history`` rows
of a customer's slice, however many rows the slice has: it folds the heads after the halo that
earlier slices have left and keeps the new one, as one text a customer. Rows that are done
pass the second step under their slice's key, so no step brings a hot customer's rows into
one task.

Rows of a slice that has been folded come out with ``late = true`` and no features.
Late rows are told from others here, by the slice's end: the event-time column is left
out before the first step, so Spark itself drops none.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from decimal import Decimal
from itertools import accumulate

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..schemas import DEFAULT_RULES, RuleConfig
from .triage_state import OUTPUT_SCHEMA

_FEATURES = "velocity_count bigint, geo_distinct bigint, previous_country string, avg_prior_amount decimal(19,2), history_retained bigint"
_ROW = "t bigint, event_id bigint, payment_id string, amount decimal(19,4), currency string, country string"
#: Kinds of rows between the steps.
DONE, HEAD, TAIL, LATE = "done", "head", "tail", "late"
BETWEEN = f"bucket bigint, customer_id string, part bigint, kind string, {_ROW}, {_FEATURES}"
#: Buckets of customers; the checkpoint keeps them, so a stream has the same number for life.
BUCKETS = 512
_BLANK = (None,) * 5
OUTPUT = OUTPUT_SCHEMA.replace("created_at timestamp", "t bigint")
_between, _told = (Row(*[c.split()[0] for c in schema.split(", ")]) for schema in (BETWEEN, OUTPUT))


def window_features(rows: list[tuple], start: int, cfg: RuleConfig) -> list[tuple]:
    """Features of ``rows[start:]``; rows are ``(t, event_id, payment_id, amount, currency, country)`` in order."""
    window, keep, h = cfg.window_seconds * 1_000_000, cfg.window_seconds * cfg.retention_windows * 1_000_000, cfg.max_history
    times, units = [r[0] for r in rows], [int(r[3] * 10000) for r in rows]
    upto = [0, *accumulate(units)]
    out = []
    for i in range(start, len(rows)):
        t, first = times[i], max(0, i - h + 1)
        inside = bisect_left(times, t - window, first, i + 1)
        kept = bisect_left(times, t - keep, first, i + 1)
        previous = avg = None
        if i:
            previous = rows[i - 1][5]
            prior = bisect_left(times, times[i - 1] - keep, max(0, i - h), i)
            n, total = i - prior, upto[i] - upto[prior]
            avg = _avg_of(n, total)
        countries = {r[5] for r in rows[inside:i + 1]} - {None}
        out.append((i + 1 - inside, len(countries), previous, avg, i + 1 - kept))
    return out


def _avg_of(n: int, units: int) -> Decimal | None:
    return None if not n else (Decimal((2 * units + 100 * n) // (200 * n)) / 100).quantize(Decimal("0.01"))     # HALF_UP


class SliceFold(StatefulProcessor):
    """Step one, keyed by (bucket of customers, slice)."""

    def __init__(self, cfg: RuleConfig, slice_ms: int):
        self.cfg, self.slice_ms = cfg, slice_ms

    def init(self, handle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", f"customer_id string, {_ROW}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        bucket, part = key
        end = (part + 1) * self.slice_ms
        new = [(r.customer_id, r.t, r.event_id, r.payment_id, r.amount, r.currency, r.country) for r in rows]
        if end <= timerValues.getCurrentWatermarkInMs():
            for customer, *r in new:
                yield _between(bucket, customer, part, LATE, *r, *_BLANK)
            return
        self.rows.appendList(new)
        self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (bucket, part), h = key, self.cfg.max_history
        customers: dict[str, list[tuple]] = {}
        for customer, *r in self.rows.get():
            customers.setdefault(customer, []).append(tuple(r))
        self.rows.clear()
        for customer, rows in customers.items():
            rows.sort(key=lambda r: r[:2])
            for r in rows[:h]:
                yield _between(bucket, customer, -1, HEAD, *r, *_BLANK)
            for r in rows[max(h, len(rows) - h):]:
                yield _between(bucket, customer, -1, TAIL, *r, *_BLANK)
            for r, f in zip(rows[h:], window_features(rows, h, self.cfg)):
                yield _between(bucket, customer, part, DONE, *r, *f)


class HaloFold(StatefulProcessor):
    """Step two, keyed by (bucket, -1) for heads and tails, by (bucket, slice) for rows that only pass."""

    def __init__(self, cfg: RuleConfig, slice_us: int):
        self.cfg, self.slice_us = cfg, slice_us

    def init(self, handle) -> None:
        self.halo = handle.getListState("halo", "customer_id string, rows string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        customers: dict[str, dict[int, list[tuple]]] = {}
        for r in rows:
            _, customer, _, kind, *rest = r
            row, features = tuple(rest[:6]), tuple(rest[6:])
            if kind in (DONE, LATE):
                yield self._row(customer, row, features, kind == LATE)
            else:
                customers.setdefault(customer, {}).setdefault(row[0] // self.slice_us, []).append((kind == HEAD, row))
        if not customers:
            return
        halos = {customer: told for customer, told in self.halo.get()}
        for customer, slices in customers.items():
            halo = [_history(*r) for r in json.loads(halos.get(customer, "[]"))]
            for _, found in sorted(slices.items()):
                heads = sorted((r for head, r in found if head), key=lambda r: r[:2])
                tails = sorted((r for head, r in found if not head), key=lambda r: r[:2])
                both = halo + heads
                for row, f in zip(heads, window_features(both, len(halo), self.cfg)):
                    yield self._row(customer, row, f, False)
                halo = (both + tails)[-self.cfg.max_history:]
            halos[customer] = json.dumps([(r[0], str(r[3]), r[5]) for r in halo])
        self.halo.put(list(halos.items()))

    @staticmethod
    def _row(customer, row, features, late) -> Row:
        t, event_id, payment_id, amount, currency, country = row
        return _told(payment_id, customer, t, event_id, amount, currency, country, *features, late)


def _history(t: int, amount: str, country: str | None) -> tuple:
    """What a row of the halo tells the rows after it."""
    return t, None, None, Decimal(amount), None, country


def stream_activity_slices(stream: DataFrame, cfg: RuleConfig = DEFAULT_RULES, delay: str = "10 minutes",
                           slice_seconds: int = 3600) -> DataFrame:
    """Activity features over a payments stream, like ``triage_state.stream_activity`` with ``keep_late``."""
    us = slice_seconds * 1_000_000
    rows = (stream.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
            .withColumn("t", F.unix_micros("created_at")).withColumn("part", F.floor(F.col("t") / us).cast("bigint"))
            .select(F.pmod(F.xxhash64("customer_id"), F.lit(BUCKETS)).alias("bucket"), "customer_id", "part", *[c.split()[0] for c in _ROW.split(", ")]))
    folded = rows.groupBy("bucket", "part").transformWithState(
        SliceFold(cfg, slice_seconds * 1000), BETWEEN, "append", "eventTime")
    out = folded.groupBy("bucket", "part").transformWithState(
        HaloFold(cfg, us), OUTPUT, "append", "none")
    return out.withColumn("created_at", F.timestamp_micros("t")).drop("t")
