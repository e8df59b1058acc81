"""Registered queries: model verdict reconciliation and scorer prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import join_text
from ..operators.features import activity_snapshot
from ..operators.rules import rule_findings
from ..operators.triage import triage
from ..operators.verdict import prompt, verdict_reasoner
from .q_triage import rules_sql
from .registry import query

DAY = S.DAY_RULES

_RECONCILE_SQL = rules_sql(86400) + f""",
j AS (
  SELECT f.*, v.decision AS vd, v.risk_score AS vr, v.reasons AS vreasons,
         coalesce(v.decision IN ('APPROVE', 'ESCALATE', 'BLOCK')
                  AND NOT isnan(coalesce(v.risk_score, 0.0::DOUBLE)), false) AS model_used
  FROM findings f LEFT JOIN verdicts v USING (payment_id)),
k AS (
  SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, greatest(rule_risk, coalesce(vr, 0.0::DOUBLE)))) AS crisk,
         CASE vd WHEN 'BLOCK' THEN 2 WHEN 'ESCALATE' THEN 1 WHEN 'APPROVE' THEN 0 END AS msev
  FROM j),
m AS (
  SELECT *, greatest(severity, CASE WHEN crisk >= 0.8 THEN 2 WHEN crisk >= 0.4 THEN 1 ELSE 0 END) AS ceiling
  FROM k)
SELECT payment_id,
       CASE WHEN model_used THEN
         CASE greatest(severity, least(msev, ceiling)) WHEN 2 THEN 'BLOCK' WHEN 1 THEN 'ESCALATE' ELSE 'APPROVE' END
       ELSE recommended END AS decision,
       CASE WHEN model_used THEN crisk ELSE rule_risk END AS risk_score,
       CASE WHEN model_used
         THEN array_to_string(list_concat(coalesce(vreasons, []::VARCHAR[]),
                                          ['{S.RULE_SIGNALS_PREFIX}' || signals_text]), '; ')
         ELSE signals_text || '; {S.RULES_ONLY_REASON}' END AS reasons_text,
       model_used
FROM m"""


@query("verdict_reconcile", _RECONCILE_SQL)
def verdict_reconcile(ds):
    """R8-R10 + J7: rule floor reconciled with optional model verdicts, rule fallback."""
    out = triage(ds.payments, DAY, reasoner=verdict_reasoner(ds.verdicts))
    return out.select("payment_id", "decision", "risk_score",
                      join_text(F.col("reasons")).alias("reasons_text"), "model_used")


@query("verdict_prompt", rules_sql(86400) + """
SELECT payment_id,
       '{"transaction":{"amount":"' || CAST(CAST(amount AS DECIMAL(38,2)) AS VARCHAR) || '","currency":"' || currency
         || '","customer":"' || customer_id || '","country":"' || coalesce(country, 'unknown') || '","merchant":"'
         || coalesce(merchant, 'unknown') || '","card":"' || coalesce(card_last4, 'unknown')
         || '"},"rules":{"floor":"' || recommended || '","risk":"' || printf('%.2f', rule_risk)
         || '","signals":' || to_json(signals_text) || '}}' AS prompt
FROM findings""")
def verdict_prompt(ds):
    """The scorer's input for every payment (transaction, rule floor, risk, signals)."""
    f = rule_findings(activity_snapshot(ds.payments, DAY), DAY)
    return f.select("payment_id", prompt(f).alias("prompt"))
