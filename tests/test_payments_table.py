"""Payments as base and deltas: merge on read, compaction of touched buckets, a compaction that fails."""

import os
from datetime import timedelta
from decimal import Decimal

import pytest

from ledgerflow import schemas as S
from ledgerflow.streaming.payments_table import PaymentsTable
from ledgerflow.streaming.staging import run_folder

from helpers import T0, crash_once
from test_process_cases import stored

UPDATE = "payment_id string, status string, fraud_decision string, risk_score decimal(4,3), fraud_reasons string, updated_at timestamp"


def updates(spark, *rows):
    return spark.createDataFrame([(p, s, "BLOCK", Decimal("0.900"), "[]", T0 + timedelta(seconds=t)) for p, s, t in rows], UPDATE)


def status(table):
    return {r.payment_id: r.status for r in table.read().collect()}


def files(table):
    root = table.root.removeprefix("file:") + "/base"
    return {os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark):
    t = PaymentsTable(spark, run_folder(spark, "payments-test"), buckets=8)
    t.create(stored(spark, *[f"p{i}" for i in range(40)]))
    return t


def test_the_last_update_wins_across_batches_and_repeats(spark, table):
    assert set(status(table).values()) == {"RECEIVED"} and len(status(table)) == 40
    table.append(0, updates(spark, ("p1", "BLOCKED", 5), ("p1", "PROCESSED", 3), ("p2", "PROCESSED", 9), ("p99", "PROCESSED", 1)))
    table.append(1, updates(spark, ("p2", "BLOCKED", 8)), stored(spark, "new"))
    table.append(1, updates(spark, ("p2", "BLOCKED", 8)), stored(spark, "new"))              # run again
    table.append(2, updates(spark, ("new", "PROCESSED", 9)))
    want = {f"p{i}": "RECEIVED" for i in range(40)} | {"p1": "BLOCKED", "p2": "PROCESSED", "new": "PROCESSED"}
    assert status(table) == want
    assert table.compact() and status(table) == want
    assert table.compact() == []
    table.append(3, updates(spark, ("p2", "BLOCKED", 10)))
    assert status(table) == want | {"p2": "BLOCKED"}
    table.compact()
    table.vacuum()
    assert status(table) == want | {"p2": "BLOCKED"}
    assert table.read().columns == [f.name for f in S.PAYMENTS.fields]


def test_compaction_writes_touched_buckets_only(spark, table):
    before = files(table)
    table.append(0, updates(spark, ("p1", "BLOCKED", 5)))
    touched = table.compact()
    assert len(touched) == 1
    assert before < files(table) and {f.split("/")[1] for f in files(table) - before} == {f"bucket={touched[0]}"}
    table.vacuum()
    kept = {f for f in before if f"bucket={touched[0]}/" not in f}
    assert kept == before & files(table) and len(files(table)) == len(before)


def test_reads_scan_touched_buckets_by_join_and_the_rest_plainly(spark, table):
    table.append(0, updates(spark, ("p1", "BLOCKED", 5)))
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "generation" in line]
    assert len(scans) == 2 and all("PartitionFilters: [" in s and "bucket" in s.split("PartitionFilters")[1] for s in scans)


def test_a_compaction_that_fails_before_its_marker_changes_nothing(spark, table):
    table.append(0, updates(spark, ("p1", "BLOCKED", 5)))
    want = status(table)
    broken = PaymentsTable(spark, table.root, 8, manifests=crash_once(1)(spark, f"{table.root}/manifests"))
    with pytest.raises(RuntimeError):
        broken.compact()
    assert status(table) == want and table.manifest()[0] == 0
    assert table.compact() and status(table) == want
