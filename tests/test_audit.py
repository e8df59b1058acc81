"""Audit hand cases: the crash-soak verdict and run selection."""

from ledgerflow.operators import audit as A

PAY = "payment_id string, customer_id string, status string"
OUT = "aggregate_id string, event_id string, topic string"


def tables(spark):
    pays = spark.createDataFrame([("p1", "run-1", "PROCESSED"), ("p2", "run-1", "BLOCKED"),
                                  ("p3", "run-2", "RECEIVED"), ("p4", "other", "PROCESSED")], PAY)
    outs = spark.createDataFrame([("p1", "o1", "payments.processed"), ("p2", "o2", "payments.blocked"),
                                  ("p2", "o3", "payments.blocked"), ("p4", "o4", "payments.processed"),
                                  ("p1", "o5", "payments.requested")], OUT)
    return pays, outs


def test_verdict_flags_loss_and_duplicates(spark):
    pays, outs = tables(spark)
    v = {r["customer_id"]: r for r in A.audit_verdict(outs, pays).collect()}
    assert (v["run-1"]["created"], v["run-1"]["terminal"], v["run-1"]["outcome_events"],
            v["run-1"]["duplicated_payments"], v["run-1"]["passed"]) == (2, 2, 3, 1, False)
    assert v["run-2"]["passed"] is False and v["other"]["passed"] is True


def test_run_selection_by_prefix_and_equality(spark):
    pays, outs = tables(spark)
    assert sorted(r["customer_id"] for r in A.audit_counts(pays, customer_prefix="run-").collect()) == \
        ["run-1", "run-2"]
    assert [r["customer_id"] for r in A.audit_counts(pays, customer="other").collect()] == ["other"]
    dup = A.audit_duplicates(outs, pays, customer_prefix="run-").collect()
    assert [(r["customer_id"], r["duplicated_payments"]) for r in dup] == [("run-1", 1)]
