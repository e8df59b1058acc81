"""Triage hand cases: the six cases of the original's synthetic test and the
untested semantics listed in FIXTURES §3 (60 s window unless stated)."""

from ledgerflow.operators.features import activity_snapshot
from ledgerflow.operators.triage import triage
from ledgerflow.schemas import DEFAULT_RULES

from helpers import by_id, payments


def decide(spark, rows, cfg=DEFAULT_RULES):
    return by_id(triage(payments(spark, rows), cfg), "decision", "reasons", "risk_score")


def test_clean_is_approved(spark):
    d = decide(spark, [("clean", 0, "49.99", "US")])
    assert d["p0"][0] == "APPROVE"
    assert d["p0"][1][-1] == "decision by deterministic rules (LLM triage not applied)"


def test_card_testing_velocity_is_blocked(spark):
    d = decide(spark, [("v", 5 * i, "3.00", "US") for i in range(6)])
    assert d["p5"][0] == "BLOCK"
    assert any("velocity" in r.lower() for r in d["p5"][1])
    assert d["p3"][0] == "ESCALATE" and d["p2"][0] == "APPROVE"


def test_impossible_travel_is_blocked(spark):
    d = decide(spark, [("g", 0, "40.00", "US"), ("g", 10, "40.00", "GB")])
    assert d["p1"][0] == "BLOCK" and any("geo" in r.lower() for r in d["p1"][1])


def test_slow_country_change_is_escalated(spark):
    d = decide(spark, [("g", 0, "40.00", "US"), ("g", 120, "40.00", "GB")])
    assert d["p1"][0] == "ESCALATE"


def test_large_amount_escalated_and_extreme_blocked(spark):
    d = decide(spark, [("a", 0, "6000.00", "US"), ("b", 0, "25000.00", "US")])
    assert d["p0"][0] == "ESCALATE" and any("amount" in r.lower() for r in d["p0"][1])
    assert d["p1"][0] == "BLOCK"


def test_window_bounds_are_closed(spark):
    inside = decide(spark, [("x", 0, "1.00", "US"), ("x", 60, "1.00", "GB")])
    assert inside["p1"][0] == "BLOCK"
    outside = decide(spark, [("x", 0, "1.00", "US"), ("x", 60.001, "1.00", "GB")])
    assert outside["p1"][0] == "ESCALATE"


def test_same_timestamp_orders_by_tiebreak(spark):
    f = by_id(activity_snapshot(payments(spark, [("t", 0, "1.00", "US"), ("t", 0, "1.00", "US")])),
              "velocity_count")
    assert f["p0"] == (1,) and f["p1"] == (2,)


def test_count_is_capped_by_history(spark):
    f = by_id(activity_snapshot(payments(spark, [("c", i * 0.5, "1.00", "US") for i in range(60)])),
              "velocity_count", "history_retained")
    assert f["p59"] == (50, 50)


def test_average_survives_a_long_gap(spark):
    rows = [("y", 0, "100.00", "US"), ("y", 10, "300.00", "US"), ("y", 365 * 86400, "10.00", "GB")]
    f = by_id(activity_snapshot(payments(spark, rows)), "avg_prior_amount", "previous_country")
    assert str(f["p2"][0]) == "200.00" and f["p2"][1] == "US"


def test_null_previous_country_gives_no_mismatch(spark):
    d = decide(spark, [("n", 0, "1.00", "US"), ("n", 120, "1.00", None), ("n", 240, "1.00", "GB")])
    assert d["p2"][0] == "APPROVE"


def test_country_case(spark):
    near = decide(spark, [("k", 0, "1.00", "us"), ("k", 10, "1.00", "US")])
    assert near["p1"][0] == "BLOCK"              # distinct is case-sensitive
    far = decide(spark, [("k", 0, "1.00", "us"), ("k", 120, "1.00", "US")])
    assert far["p1"][0] == "APPROVE"             # mismatch ignores case


def test_anomaly_threshold_is_strict(spark):
    base = [("m", 0, "100.00", "US")]
    for amount, expected in (("1000.00", "APPROVE"), ("1000.01", "ESCALATE"), ("499.99", "APPROVE")):
        d = decide(spark, base + [("m", 1000, amount, "US")])
        assert d["p1"][0] == expected, amount


def test_amount_thresholds(spark):
    rows = [(f"z{i}", 0, a, "US") for i, a in enumerate(("4999.99", "5000", "19999.99", "20000"))]
    d = decide(spark, rows)
    assert [d[f"p{i}"][0] for i in range(4)] == ["APPROVE", "ESCALATE", "ESCALATE", "BLOCK"]
    assert all(not any(r.startswith("amount") for r in d["p0"][1]) for _ in [0])


def test_half_cent_average_rounds_up(spark):
    f = by_id(activity_snapshot(payments(spark, [("h", 0, "0.01", "US"), ("h", 1, "0.02", "US"),
                                                 ("h", 2, "1.00", "US")])), "avg_prior_amount")
    assert str(f["p2"][0]) == "0.02"            # (0.01 + 0.02) / 2 = 0.015 -> 0.02
