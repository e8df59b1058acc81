"""Payment board projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import decimal_text, reasons_from_json, text_or

MISSING = "—"          # fixed value: the dash shown for a missing decision / risk


def payments_board(payments: DataFrame) -> DataFrame:
    """One display row per payment, newest first (ties by id): short id, amount
    with currency, decision and risk (two decimals) or a dash when missing."""
    return payments.select(
        "payment_id",
        F.left("payment_id", F.lit(8)).alias("short_id"),
        F.concat(decimal_text(F.col("amount")), F.lit(" "), F.col("currency")).alias("amount_text"),
        "status",
        text_or(F.col("fraud_decision"), MISSING).alias("decision_text"),
        text_or(F.col("risk_score").cast("decimal(4,2)").cast("string"), MISSING).alias("risk_text"),
        "created_at",
    ).orderBy(F.desc("created_at"), "payment_id")


def payment_reasons(payments: DataFrame, keep_empty: bool = True) -> DataFrame:
    """F10 + F11: reasons JSON text -> one row per reason (position from 0);
    with ``keep_empty`` payments without reasons keep one row with nulls."""
    arr = reasons_from_json(F.col("fraud_reasons"))
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return payments.select("payment_id", explode(arr).alias("pos", "reason"))
