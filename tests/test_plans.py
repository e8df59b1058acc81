"""Plan shape: what Catalyst is asked to do must stay scalable."""

import pytest

from ledgerflow.operators.features import activity_snapshot
from ledgerflow.plans.catalog import REGISTRY
from ledgerflow.schemas import RuleConfig

from conftest import SF_SMALL

STREAMING = {n for n in REGISTRY if n.startswith("stream_")} | {"effectively_once", "requested_stream", "outbox_relay_stream"}
ITERATIVE = {"accept_result", "accepted_by_result"}        # checkpointed jump tables


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - STREAMING - ITERATIVE))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = physical(REGISTRY[name].run(spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, plan


def test_triage_window_is_one_exchange_one_sort(spark, ds):
    df = activity_snapshot(ds.payments, RuleConfig(window_seconds=60, split_hot=False))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Window [") == 1


def test_scan_prunes_columns(spark, ds):
    plan = physical(ds.payments.select("payment_id", "customer_id"))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_filter_reaches_the_scan(spark, ds):
    plan = physical(ds.base.filter("event_id > 10").select("event_id"))
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,10)]" in plan
