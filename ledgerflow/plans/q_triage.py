"""Registered queries: activity features, rules and triage decisions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import join_text
from ..operators.features import activity_snapshot
from ..operators.rules import rule_findings
from ..operators.triage import triage
from .registry import query

DAY = S.DAY_RULES
MINUTE = S.DEFAULT_RULES


def features_sql(window_s: int, source: str = "payments", tiebreak: str = "event_id",
                 hist: int = 50, retention: int = 10) -> str:
    """Oracle CTEs ``seq``/``feat``/``snap``: a bounded self-join on row numbers.

    Independent of the Spark formulation (which collects a frame array): each
    row is paired with the rows ``rn-H .. rn`` of its customer and the features
    are filtered counts and sums over those pairs.
    """
    keep = window_s * retention
    return f""",
seq AS (
  SELECT *, row_number() OVER w AS rn, lag(created_at) OVER w AS prev_t,
         lag(country) OVER w AS previous_country
  FROM {source} WINDOW w AS (PARTITION BY customer_id ORDER BY created_at, {tiebreak})),
pairs AS (
  SELECT a.payment_id, a.rn, a.created_at, a.prev_t, b.rn AS brn, b.created_at AS bt,
         CAST(b.amount * 10000 AS HUGEINT) AS bunits, b.country AS bc
  FROM seq a JOIN seq b ON a.customer_id = b.customer_id AND b.rn BETWEEN a.rn - {hist} AND a.rn),
feat AS (
  SELECT payment_id,
    count(*) FILTER (WHERE brn > rn - {hist} AND bt >= created_at - to_seconds({window_s})) AS velocity_count,
    count(DISTINCT bc) FILTER (WHERE brn > rn - {hist} AND bt >= created_at - to_seconds({window_s})) AS geo_distinct,
    count(*) FILTER (WHERE brn > rn - {hist} AND bt >= created_at - to_seconds({keep})) AS history_retained,
    count(*) FILTER (WHERE brn < rn AND bt >= prev_t - to_seconds({keep})) AS pn,
    sum(bunits) FILTER (WHERE brn < rn AND bt >= prev_t - to_seconds({keep})) AS ps
  FROM pairs GROUP BY payment_id),
snap AS (
  SELECT s.*, f.velocity_count, f.geo_distinct, f.history_retained,
    CASE WHEN f.pn > 0 THEN CAST(CAST((2 * f.ps + 100 * f.pn) // (200 * f.pn) AS DECIMAL(19,0))
                                 * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(19,2)) END AS avg_prior_amount
  FROM seq s JOIN feat f USING (payment_id))"""


def rules_sql(window_s: int, source: str = "payments", tiebreak: str = "event_id") -> str:
    """Oracle CTE ``rules`` over ``snap``."""
    amt = "CAST(CAST(amount AS DECIMAL(38,2)) AS VARCHAR)"
    return features_sql(window_s, source, tiebreak) + f""",
rules AS (
  SELECT *,
    CASE WHEN velocity_count >= 6 THEN 2 WHEN velocity_count >= 4 THEN 1 ELSE 0 END AS velocity_severity,
    CASE WHEN velocity_count >= 6 THEN 0.95::DOUBLE WHEN velocity_count >= 4 THEN 0.6::DOUBLE
         ELSE 0.0::DOUBLE END AS velocity_risk,
    CASE WHEN velocity_count >= 6
           THEN 'velocity: ' || velocity_count || ' charges in {window_s}s for this customer (card-testing pattern)'
         WHEN velocity_count >= 4 THEN 'velocity: ' || velocity_count || ' charges in {window_s}s (elevated)'
    END AS velocity_signal,
    CASE WHEN geo_distinct >= 2 THEN 2
         WHEN previous_country IS NOT NULL AND country IS NOT NULL
              AND lower(previous_country) <> lower(country) THEN 1 ELSE 0 END AS geo_severity,
    CASE WHEN geo_distinct >= 2 THEN 0.9::DOUBLE
         WHEN previous_country IS NOT NULL AND country IS NOT NULL
              AND lower(previous_country) <> lower(country) THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END AS geo_risk,
    CASE WHEN geo_distinct >= 2
           THEN 'geo-velocity: charges from ' || geo_distinct || ' countries within {window_s}s (impossible travel)'
         WHEN previous_country IS NOT NULL AND country IS NOT NULL
              AND lower(previous_country) <> lower(country)
           THEN 'geo-mismatch: country changed from ' || previous_country || ' to ' || country
    END AS geo_signal,
    CASE WHEN amount >= 20000 THEN 2 WHEN amount >= 5000 THEN 1
         WHEN avg_prior_amount IS NOT NULL AND amount >= 500 AND amount > avg_prior_amount * 10 THEN 1
         ELSE 0 END AS amount_severity,
    CASE WHEN amount >= 20000 THEN 0.9::DOUBLE WHEN amount >= 5000 THEN 0.5::DOUBLE
         WHEN avg_prior_amount IS NOT NULL AND amount >= 500 AND amount > avg_prior_amount * 10 THEN 0.5::DOUBLE
         ELSE 0.0::DOUBLE END AS amount_risk,
    CASE WHEN amount >= 20000 THEN 'amount: ' || {amt} || ' ' || currency || ' exceeds hard limit'
         WHEN amount >= 5000 THEN 'amount: ' || {amt} || ' ' || currency || ' is unusually large'
         WHEN avg_prior_amount IS NOT NULL AND amount >= 500 AND amount > avg_prior_amount * 10
           THEN 'amount: ' || {amt} || ' is >10x the customer''s average ('
                || CAST(avg_prior_amount AS VARCHAR) || ')'
    END AS amount_signal
  FROM snap),
findings AS (
  SELECT *,
    CASE greatest(velocity_severity, geo_severity, amount_severity)
      WHEN 2 THEN 'BLOCK' WHEN 1 THEN 'ESCALATE' ELSE 'APPROVE' END AS recommended,
    greatest(velocity_severity, geo_severity, amount_severity) AS severity,
    greatest(velocity_risk, geo_risk, amount_risk) AS rule_risk,
    coalesce(nullif(concat_ws('; ', velocity_signal, geo_signal, amount_signal), ''),
             '{S.NO_SIGNALS_TEXT}') AS signals_text
  FROM rules)"""


def _sev_name(col: str) -> str:
    return f"CASE {col} WHEN 2 THEN 'BLOCK' WHEN 1 THEN 'ESCALATE' ELSE 'APPROVE' END"


# ---------------------------------------------------------------- triage

def _triage_decisions(ds, cfg):
    out = triage(ds.payments, cfg)
    return out.select("payment_id", "customer_id", "decision", "risk_score",
                      join_text(F.col("reasons")).alias("reasons_text"))


def _triage_sql(window_s: int) -> str:
    return rules_sql(window_s) + f"""
SELECT payment_id, customer_id, recommended AS decision, rule_risk AS risk_score,
       signals_text || '; {S.RULES_ONLY_REASON}' AS reasons_text
FROM findings"""


@query("triage_decisions", _triage_sql(86400))
def triage_decisions(ds):
    """Decision, risk and reasons for every payment (window 86400 s)."""
    return _triage_decisions(ds, DAY)


@query("triage_decisions_60s", _triage_sql(60))
def triage_decisions_60s(ds):
    """Same as ``triage_decisions`` with the original 60 s window."""
    return _triage_decisions(ds, MINUTE)


# ---------------------------------------------------------------- features

_SNAP_COLS = ("velocity_count", "geo_distinct", "previous_country", "avg_prior_amount",
              "history_retained")


@query("activity_snapshot", features_sql(86400) + """
SELECT payment_id, customer_id, velocity_count, geo_distinct, previous_country,
       avg_prior_amount, history_retained FROM snap""", decimals=('avg_prior_amount',))
def q_activity_snapshot(ds):
    """All activity features for every payment."""
    return activity_snapshot(ds.payments, DAY).select("payment_id", "customer_id", *_SNAP_COLS)


@query("activity_snapshot_ranges", features_sql(86400) + """
SELECT payment_id, customer_id, velocity_count, geo_distinct, previous_country,
       avg_prior_amount, history_retained FROM snap""", decimals=('avg_prior_amount',))
def activity_snapshot_ranges(ds):
    """W0 with every customer of more than 8 payments cut at row quantiles, as hot ones are."""
    cfg = replace(DAY, hot_customer_rows=8, hot_bucket_rows=1000)
    return activity_snapshot(ds.payments, cfg).select("payment_id", "customer_id", *_SNAP_COLS)


def _single(col):
    def build(ds):
        return activity_snapshot(ds.payments, DAY).select("payment_id", col)
    build.__doc__ = f"Single feature ``{col}`` (window 86400 s)."
    return build


query("velocity_count", features_sql(86400) + "\nSELECT payment_id, velocity_count FROM snap")(
    _single("velocity_count"))
query("geo_distinct", features_sql(86400) + "\nSELECT payment_id, geo_distinct FROM snap")(
    _single("geo_distinct"))
query("previous_country", features_sql(86400) + "\nSELECT payment_id, previous_country FROM snap")(
    _single("previous_country"))
query("avg_prior_amount", features_sql(86400) + "\nSELECT payment_id, avg_prior_amount FROM snap",
      decimals=("avg_prior_amount",))(
    _single("avg_prior_amount"))
query("history_retained", features_sql(86400) + "\nSELECT payment_id, history_retained FROM snap")(
    _single("history_retained"))


# ---------------------------------------------------------------- rules

def _rule_query(prefix):
    def build(ds):
        out = rule_findings(activity_snapshot(ds.payments, DAY), DAY)
        return out.select("payment_id",
                          F.when(F.col(f"{prefix}_severity") == 2, "BLOCK")
                          .when(F.col(f"{prefix}_severity") == 1, "ESCALATE")
                          .otherwise("APPROVE").alias(f"{prefix}_decision"),
                          f"{prefix}_risk", f"{prefix}_signal")
    build.__doc__ = f"Rule ``{prefix}`` alone: decision, risk and signal per payment."
    sql = rules_sql(86400) + f"""
SELECT payment_id, {_sev_name(prefix + '_severity')} AS {prefix}_decision, {prefix}_risk, {prefix}_signal
FROM rules"""
    return sql, build


for _p, _key in (("velocity", "rule_velocity"), ("geo", "rule_geo"), ("amount", "rule_amount")):
    _sql, _build = _rule_query(_p)
    query(_key, _sql)(_build)


@query("rule_findings", rules_sql(86400) + """
SELECT payment_id, recommended, rule_risk, signals_text FROM findings""")
def q_rule_findings(ds):
    """Folded severity, risk and ordered signal list."""
    out = rule_findings(activity_snapshot(ds.payments, DAY), DAY)
    return out.select("payment_id", "recommended", "rule_risk",
                      join_text(F.col("signals")).alias("signals_text"))
