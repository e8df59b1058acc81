"""Request intake landing table (S7) and JSON decoding of bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import to_json_keep_nulls


def intake_bodies(requests: DataFrame) -> DataFrame:
    """Render request rows as landing rows ``(request_id, idempotency_key, body, received_at)``."""
    body = F.struct("amount", "currency", F.col("customer_id").alias("customerId"),
                    F.col("card_last4").alias("cardLast4"), "country", "merchant")
    return requests.select("request_id", "idempotency_key", to_json_keep_nulls(body).alias("body"),
                           "received_at")


def parse_intake(landing: DataFrame) -> DataFrame:
    """Decode ``body`` with the declared request schema. Unparseable bodies keep
    their text in ``_corrupt_record`` and null fields (they fail validation)."""
    schema = S.with_corrupt_column(S.REQUEST_BODY)
    parsed = F.from_json("body", schema, {"columnNameOfCorruptRecord": "_corrupt_record",
                                          "mode": "PERMISSIVE"})
    return landing.withColumn("_b", parsed).select(
        *[c for c in landing.columns if c != "body"],
        F.col("_b.amount").alias("amount"), F.col("_b.currency").alias("currency"),
        F.col("_b.customerId").alias("customer_id"), F.col("_b.cardLast4").alias("card_last4"),
        F.col("_b.country").alias("country"), F.col("_b.merchant").alias("merchant"),
        F.col("_b._corrupt_record").alias("_corrupt_record"))
