"""Triage pipeline (R12): activity snapshot -> rules -> reasoner.

A reasoner (X1) is any callable ``DataFrame -> DataFrame`` that reads the rule
findings (``recommended``, ``severity``, ``rule_risk``, ``signals``) and adds
``decision``, ``risk_score`` and ``reasons``. The default is the rule-only
reasoner; ``verdict.verdict_reasoner(verdicts)`` reconciles external verdicts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..schemas import DEFAULT_RULES, RuleConfig
from .features import activity_snapshot
from .rules import rule_findings, rule_only_decision

Reasoner = Callable[[DataFrame], DataFrame]

EVAL_COLUMNS = ("payment_id", "amount", "currency", "customer_id", "card_last4", "country",
                "merchant", "created_at", "event_id")


def evaluation_input(events: DataFrame) -> DataFrame:
    """The fields the triage needs (ids used only for dedup are dropped)."""
    return events.select(*EVAL_COLUMNS)


def triage(payments: DataFrame, cfg: RuleConfig = DEFAULT_RULES,
           reasoner: Reasoner = rule_only_decision, tiebreak: str = "event_id") -> DataFrame:
    """Decision, risk and reasons for every payment, in one shuffle by customer."""
    return reasoner(rule_findings(activity_snapshot(payments, cfg, tiebreak), cfg))
