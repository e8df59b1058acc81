"""Loss / duplicate audits.

The crash-soak check of the original is a handful of SQL counts; here they are
grouped per run (= customer) so one pass answers every run at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S

TERMINAL = (S.STATUS_PROCESSED, S.STATUS_BLOCKED)
OUTCOME_TOPICS = (S.TOPIC_PROCESSED, S.TOPIC_BLOCKED)


def _runs(payments: DataFrame, customer_prefix: str | None, customer: str | None) -> DataFrame:
    """Optional run selection by customer id prefix or equality."""
    if customer_prefix is not None:
        payments = payments.filter(F.col("customer_id").startswith(customer_prefix))
    if customer is not None:
        payments = payments.filter(F.col("customer_id") == customer)
    return payments


def audit_counts(payments: DataFrame, customer_prefix: str | None = None,
                 customer: str | None = None) -> DataFrame:
    """A1 + P10: created and terminal payments per run."""
    p = _runs(payments, customer_prefix, customer)
    return p.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("created"),
        F.count_if(F.col("status").isin(*TERMINAL)).alias("terminal"))


def outcome_rows(outbox: DataFrame, payments: DataFrame, customer_prefix: str | None = None,
                 customer: str | None = None) -> DataFrame:
    """Outcome outbox rows joined to their payment (filters sit below the join)."""
    p = _runs(payments, customer_prefix, customer).select(F.col("payment_id").alias("aggregate_id"),
                                                          "customer_id")
    o = outbox.filter(F.col("topic").isin(*OUTCOME_TOPICS)).select("aggregate_id", "event_id")
    return o.join(p, "aggregate_id")


def audit_outcomes(outbox: DataFrame, payments: DataFrame, **runs) -> DataFrame:
    """Outcome events per run (``payments`` only supplies each payment's customer)."""
    return outcome_rows(outbox, payments, **runs).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("outcome_events"))


def audit_duplicates(outbox: DataFrame, payments: DataFrame, **runs) -> DataFrame:
    """A2: payments with more than one outcome event, per run (two-level aggregate)."""
    per_payment = (outcome_rows(outbox, payments, **runs)
                   .groupBy("customer_id", "aggregate_id").agg(F.count(F.lit(1)).alias("n")))
    return (per_payment.groupBy("customer_id")
            .agg(F.count_if(F.col("n") > 1).alias("duplicated_payments")))


def audit_verdict(outbox: DataFrame, payments: DataFrame, lookup: DataFrame | None = None,
                  **runs) -> DataFrame:
    """A3: per run, created = terminal = outcome events and no duplicate -> pass.

    ``payments`` gives status; ``lookup`` (default ``payments``) maps outcome rows
    to customers, so a plain table can stand in for a derived one. One shuffle
    per aggregate, joined on the (small) run key.
    """
    counts = audit_counts(payments, **runs)
    per_payment = (outcome_rows(outbox, lookup if lookup is not None else payments, **runs)
                   .groupBy("customer_id", "aggregate_id").agg(F.count(F.lit(1)).alias("n")))
    outs = per_payment.groupBy("customer_id").agg(
        F.sum("n").alias("outcome_events"), F.count_if(F.col("n") > 1).alias("duplicated_payments"))
    out = counts.join(outs, "customer_id", "left").fillna(0, ["outcome_events", "duplicated_payments"])
    ok = ((F.col("created") == F.col("terminal")) & (F.col("terminal") == F.col("outcome_events"))
          & (F.col("duplicated_payments") == 0))
    return out.withColumn("passed", ok)


def delete_by_key(rows: DataFrame, keys: DataFrame, row_key: str, key: str) -> DataFrame:
    """K10 + J5: ``DELETE FROM rows WHERE row_key IN (SELECT key FROM keys)`` as a left anti join."""
    return rows.join(keys.select(F.col(key).alias(row_key)), row_key, "left_anti")


def keep_by_key(rows: DataFrame, keys: DataFrame, row_key: str, key: str) -> DataFrame:
    """``WHERE row_key IN (SELECT key ...)`` as a left semi join."""
    return rows.join(keys.select(F.col(key).alias(row_key)), row_key, "left_semi")
