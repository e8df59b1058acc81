"""Deterministic fraud rules (R1-R7) as Column expressions.

Each rule yields a severity (0 APPROVE, 1 ESCALATE, 2 BLOCK), a risk and an
optional signal text. Within a rule the branches are an ``else if`` chain;
across rules severity and risk fold with ``greatest``. Built-in expressions only,
no Python on the row path; the signal list is a higher-order function, which
Spark interprets.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import decimal_text, severity_name


def _rule(branches: list[tuple[Column, int, float, Column]], prefix: str) -> dict[str, Column]:
    """Fold an ``if / else if`` chain into (severity, risk, signal) columns."""
    sev = risk = sig = None
    for cond, s, r, text in reversed(branches):
        sev = F.when(cond, F.lit(s)).otherwise(sev if sev is not None else F.lit(0))
        risk = F.when(cond, F.lit(r)).otherwise(risk if risk is not None else F.lit(0.0))
        sig = F.when(cond, text).otherwise(sig if sig is not None else F.lit(None).cast("string"))
    return {f"{prefix}_severity": sev, f"{prefix}_risk": risk, f"{prefix}_signal": sig}


def velocity_rule(count: Column, window_seconds: int = 60) -> dict[str, Column]:
    """Many charges for one customer inside the window."""
    c = count.cast("string")
    return _rule([
        (count >= S.VELOCITY_BLOCK, 2, S.RISK_VELOCITY_BLOCK,
         F.concat(F.lit("velocity: "), c, F.lit(f" charges in {window_seconds}s for this customer (card-testing pattern)"))),
        (count >= S.VELOCITY_ESCALATE, 1, S.RISK_VELOCITY_ESCALATE,
         F.concat(F.lit("velocity: "), c, F.lit(f" charges in {window_seconds}s (elevated)"))),
    ], "velocity")


def geo_rule(distinct: Column, previous: Column, country: Column, window_seconds: int = 60) -> dict[str, Column]:
    """R2: several countries inside the window, else a country change (ignoring case)."""
    changed = previous.isNotNull() & country.isNotNull() & (F.lower(previous) != F.lower(country))
    return _rule([
        (distinct >= 2, 2, S.RISK_GEO_BLOCK,
         F.concat(F.lit("geo-velocity: charges from "), distinct.cast("string"),
                  F.lit(f" countries within {window_seconds}s (impossible travel)"))),
        (changed, 1, S.RISK_GEO_ESCALATE,
         F.concat(F.lit("geo-mismatch: country changed from "), previous, F.lit(" to "), country)),
    ], "geo")


def amount_rule(amount: Column, currency: Column, avg_prior: Column) -> dict[str, Column]:
    """Hard limit, large amount, else an anomaly against the prior average."""
    amt = decimal_text(amount)
    anomaly = (avg_prior.isNotNull() & (amount >= F.lit(Decimal(S.ANOMALY_MIN_AMOUNT)))
               & (amount > avg_prior * S.ANOMALY_FACTOR))
    return _rule([
        (amount >= F.lit(Decimal(S.LARGE_AMOUNT_BLOCK)), 2, S.RISK_AMOUNT_BLOCK,
         F.concat(F.lit("amount: "), amt, F.lit(" "), currency, F.lit(" exceeds hard limit"))),
        (amount >= F.lit(Decimal(S.LARGE_AMOUNT_ESCALATE)), 1, S.RISK_AMOUNT_ESCALATE,
         F.concat(F.lit("amount: "), amt, F.lit(" "), currency, F.lit(" is unusually large"))),
        (anomaly, 1, S.RISK_AMOUNT_ESCALATE,
         F.concat(F.lit("amount: "), amt, F.lit(f" is >{S.ANOMALY_FACTOR}x the customer's average ("),
                  decimal_text(avg_prior), F.lit(")"))),
    ], "amount")


def rule_findings(df: DataFrame, cfg: S.RuleConfig) -> DataFrame:
    """R1-R6 on a frame that carries the activity features.

    Adds per-rule ``{velocity,geo,amount}_{severity,risk,signal}`` and the folds
    ``recommended`` (name), ``severity`` (0..2), ``rule_risk`` and ``signals``.
    """
    cols: dict[str, Column] = {}
    cols.update(velocity_rule(F.col("velocity_count"), cfg.window_seconds))
    cols.update(geo_rule(F.col("geo_distinct"), F.col("previous_country"), F.col("country"), cfg.window_seconds))
    cols.update(amount_rule(F.col("amount"), F.col("currency"), F.col("avg_prior_amount")))
    out = df.withColumns(cols)
    signals = F.array_compact(F.array("velocity_signal", "geo_signal", "amount_signal"))
    return out.withColumns({
        "severity": F.greatest("velocity_severity", "geo_severity", "amount_severity"),
        "rule_risk": F.greatest("velocity_risk", "geo_risk", "amount_risk"),
        "signals": F.when(F.size(signals) == 0, F.array(F.lit(S.NO_SIGNALS_TEXT))).otherwise(signals),
    }).withColumn("recommended", severity_name(F.col("severity")))


def rule_only_decision(df: DataFrame) -> DataFrame:
    """The rules' recommendation is the decision; a fixed reason is appended."""
    return df.withColumns({
        "decision": F.col("recommended"),
        "risk_score": F.col("rule_risk"),
        "reasons": F.concat(F.col("signals"), F.array(F.lit(S.RULES_ONLY_REASON))),
    })
