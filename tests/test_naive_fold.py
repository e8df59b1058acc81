"""Third witness: a naive single-threaded deque fold against the window plan,
on random histories with ties, gaps around the window and retention bounds,
more than 50 rows per customer, null and mixed-case countries. The skew split
(hot customers cut into ranges with a history halo) must agree too."""

import random
from collections import deque
from dataclasses import replace
from datetime import timedelta
from decimal import ROUND_HALF_UP, Decimal

from ledgerflow.operators.features import activity_snapshot
from ledgerflow.schemas import RuleConfig

from helpers import PAYMENT_COLS, T0

CFG = RuleConfig(window_seconds=60)


def naive(rows, cfg):
    """rows sorted by (t, id): yields id -> features, following the deque literally."""
    hist: dict[str, deque] = {}
    out = {}
    for pid, cust, t, amount, country in rows:
        h = hist.setdefault(cust, deque())
        prev = h[-1][2] if h else None
        avg = (sum(a for _, a, _ in h) / len(h)).quantize(Decimal("0.01"), ROUND_HALF_UP) if h else None
        h.append((t, amount, country))
        while len(h) > cfg.max_history:
            h.popleft()
        cutoff = t - timedelta(seconds=cfg.window_seconds * cfg.retention_windows)
        while h and h[0][0] < cutoff:
            h.popleft()
        start = t - timedelta(seconds=cfg.window_seconds)
        inside = [c for tt, _, c in h if tt >= start]
        out[pid] = (len(inside), len({c for c in inside if c is not None}), prev, avg, len(h))
    return out


def random_rows(seed, customers=12, max_rows=130):
    rnd = random.Random(seed)
    rows, i = [], 0
    for c in range(customers):
        t = T0 + timedelta(seconds=rnd.randint(0, 1000))
        for _ in range(rnd.randint(1, max_rows)):
            t += timedelta(seconds=rnd.choice([0, 0, 1, 5, 30, 59, 60, 61, 300, 599, 600, 601, 4000]))
            country = rnd.choice(["US", "US", "GB", "us", None, "DE"])
            amount = Decimal(rnd.choice(["0.01", "0.02", "3.00", "49.99", "120.50", "999.99", "6000"]))
            rows.append((f"p{i}", i, t, f"c{c}", amount, "USD", None, country, "m"))
            i += 1
    return rows


def check(spark, cfg, seed):
    rows = random_rows(seed)
    expected = naive(sorted([(r[0], r[3], r[2], r[4], r[7]) for r in rows],
                            key=lambda r: (r[2], int(r[0][1:]))), cfg)
    df = spark.createDataFrame(rows, PAYMENT_COLS)
    got = {r["payment_id"]: (r["velocity_count"], r["geo_distinct"], r["previous_country"],
                             r["avg_prior_amount"], r["history_retained"])
           for r in activity_snapshot(df, cfg).collect()}
    assert got == expected


def test_window_plan_matches_deque(spark):
    for seed in (1, 2):
        check(spark, replace(CFG, split_hot=False), seed)


def test_hot_split_matches_deque(spark):
    # customers with more than 20 (5) rows are split into buckets of about 8 (3) rows
    check(spark, replace(CFG, hot_customer_rows=20, hot_bucket_rows=8), 3)
    check(spark, replace(CFG, hot_customer_rows=5, hot_bucket_rows=3), 4)
    check(spark, replace(CFG, hot_customer_rows=5, hot_bucket_rows=1000), 5)


def test_hot_split_on_dataset_equals_plain_plan(spark, ds):
    cols = ["payment_id", "velocity_count", "geo_distinct", "previous_country", "avg_prior_amount",
            "history_retained"]
    day = RuleConfig(window_seconds=86400)
    plain = activity_snapshot(ds.payments, replace(day, split_hot=False)).select(*cols)
    split = activity_snapshot(ds.payments, replace(day, hot_customer_rows=3, hot_bucket_rows=2)).select(*cols)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastExchange" in plan
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0


def test_hot_split_counted_on_another_table(spark, ds):
    from ledgerflow.operators import process as P

    day = RuleConfig(window_seconds=86400)
    forced = replace(day, hot_customer_rows=3, hot_bucket_rows=2)
    cols = ["event_id", "decision", "risk_score", "reasons"]
    a = P.process(ds.deliveries, ds.stored_payments, ds.claimed,
                  P.rules_decider(replace(day, split_hot=False))).decided.select(*cols)
    b = P.process(ds.deliveries, ds.stored_payments, ds.claimed,
                  P.rules_decider(forced, hot_source=ds.stored_payments)).decided.select(*cols)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
