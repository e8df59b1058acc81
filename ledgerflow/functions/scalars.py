"""Scalar Column functions (F1-F20). All built-in expressions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DECISIONS


def severity_name(sev: Column) -> Column:
    """F16: severity int 0/1/2 -> APPROVE / ESCALATE / BLOCK."""
    return F.when(sev == 2, DECISIONS[2]).when(sev == 1, DECISIONS[1]).when(sev == 0, DECISIONS[0])


def severity_of(name: Column) -> Column:
    """F16: decision name -> severity int, null for anything else."""
    return (F.when(name == DECISIONS[0], 0).when(name == DECISIONS[1], 1)
            .when(name == DECISIONS[2], 2))


def decimal_text(amount: Column, scale: int = 2) -> Column:
    """Money as text with a fixed scale (HALF_UP), e.g. ``30000.00``."""
    return amount.cast(f"decimal(38,{scale})").cast("string")


def join_text(arr: Column, sep: str = "; ") -> Column:
    """``String.join(sep, list)``."""
    return F.concat_ws(sep, arr)


def equals_ignore_case(a: Column, b: Column) -> Column:
    """F2."""
    return F.lower(a) == F.lower(b)


def full_match(s: Column, pattern: str) -> Column:
    """the whole string matches (``\\z``, not ``$``, so a trailing newline fails)."""
    return s.rlike(r"\A(?:" + pattern + r")\z")


def not_blank(s: Column) -> Column:
    """not null and holds a character above U+0020 (Java ``trim`` semantics)."""
    return s.isNotNull() & s.rlike(r"[^\x00-\x20]")


def to_json_keep_nulls(struct: Column) -> Column:
    """F8: JSON object text that keeps null fields."""
    return F.to_json(struct, {"ignoreNullFields": "false"})


def reasons_json(arr: Column) -> Column:
    """JSON array text, ``[]`` when missing."""
    return F.to_json(F.coalesce(arr, F.array().cast("array<string>")))


def reasons_from_json(raw: Column) -> Column:
    """JSON array text back to an array; a non-array value becomes ``[raw]``,
    null or empty text becomes ``[]``."""
    parsed = F.from_json(raw, "array<string>")
    empty = F.array().cast("array<string>")
    return (F.when(raw.isNull() | (F.trim(raw) == ""), empty)
            .otherwise(F.coalesce(parsed, F.array(raw))))


def deterministic_uuid(*parts: Column) -> Column:
    """UUID-formatted SHA-256 of the parts, so a replayed row gets the same id."""
    h = F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def encode_cached(payment_id: Column, status: Column) -> Column:
    """``id|status`` cache value."""
    return F.concat_ws("|", payment_id, status)


def decode_cached(value: Column) -> tuple[Column, Column]:
    """``id|status`` -> (id, status)."""
    return F.substring_index(value, "|", 1), F.substring_index(value, "|", -1)


def risk_decimal(risk: Column) -> Column:
    """risk double -> DECIMAL(4,3) as stored on the payment row (null if it does not fit)."""
    return risk.try_cast("decimal(4,3)")


def text_or(value: Column, default: str) -> Column:
    """null default."""
    return F.coalesce(value, F.lit(default))


def any_reason_contains(reasons: Column, needle: str) -> Column:
    """some reason contains ``needle`` (case-insensitive)."""
    return F.exists(reasons, lambda r: F.lower(r).contains(needle.lower()))
