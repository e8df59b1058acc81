"""Rows behind the watermark of the stateful triage stream land in the table of late rows."""

from datetime import timedelta
from decimal import Decimal

from ledgerflow.schemas import RuleConfig
from ledgerflow.streaming.runs import stream_triage_run
from ledgerflow.streaming.triage_state import OUTPUT_SCHEMA

from helpers import PAYMENT_COLS, T0


def table(spark, spec):
    return spark.createDataFrame([(pid, int(pid[1:]), T0 + timedelta(seconds=s), c, Decimal("10.00"), "USD", None, country, "m")
                                  for pid, c, s, country in spec], PAYMENT_COLS)


def test_every_row_is_folded_or_late(spark):
    on_time = table(spark, [("p1", "c", 0, "US"), ("p2", "c", 5000, "US"), ("p3", "x", 20000, "US")])
    # behind the watermark: p4 also behind p2, p5 as late as p2, p6 and p7 of a customer without
    # folded rows (still in order), p8 after p2
    late = table(spark, [("p4", "c", 4000, "GB"), ("p5", "c", 5000, "GB"), ("p6", "d", 200, "US"),
                         ("p7", "d", 100, "GB"), ("p8", "c", 5010, "GB")])
    log = stream_triage_run(spark, on_time, RuleConfig(window_seconds=60), stragglers=late)
    feats = {r["payment_id"]: r for r in log.committed("features", OUTPUT_SCHEMA).collect()}
    kept = {r["payment_id"]: r for r in log.committed("late_rows", OUTPUT_SCHEMA).collect()}
    assert sorted(feats) == ["p1", "p2", "p3", "p6", "p7", "p8"]
    assert sorted(kept) == ["p4", "p5"]
    assert kept["p4"]["amount"] == Decimal("10.00") and kept["p4"]["country"] == "GB"
    assert feats["p6"]["previous_country"] == "GB" and feats["p7"]["previous_country"] is None
    assert feats["p8"]["velocity_count"] == 2 and feats["p8"]["previous_country"] == "US"


def test_the_number_of_micro_batches_follows_the_slices_not_the_files(spark):
    rows = table(spark, [(f"p{i}", f"c{i % 3}", i * 100, "US") for i in range(120)]).repartition(16)
    log = stream_triage_run(spark, rows, RuleConfig(window_seconds=60), state_partitions=2)
    assert log.committed("features", OUTPUT_SCHEMA).count() == 120
    assert log.last() < 12                                      # 4 slices in halves, and their ends
