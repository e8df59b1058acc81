"""Outbox relay.

The outbox is append-only; publishing appends a stamp row per event to
``outbox_published``. "Pending" is the outbox minus the stamps (left anti), so
nothing is ever updated in place and a failed publish simply leaves no stamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def pending(outbox: DataFrame, published: DataFrame, topics: list[str] | None = None) -> DataFrame:
    """U3 + S6: outbox rows without a publish stamp, optionally for some topics."""
    rows = outbox if topics is None else outbox.filter(F.col("topic").isin(*topics))
    return rows.join(published.select("event_id"), "event_id", "left_anti")


def oldest_pending(outbox: DataFrame, published: DataFrame, topics: list[str],
                   batch_size: int = S.OUTBOX_BATCH_SIZE) -> DataFrame:
    """O1: the next relay batch, ``ORDER BY id LIMIT n`` (a top-k, planned as
    ``TakeOrderedAndProject``: each task keeps its n smallest, the driver merges)."""
    return pending(outbox, published, topics).orderBy("id").limit(batch_size)


def publish_records(rows: DataFrame) -> DataFrame:
    """K6 + T4: sink records ``(topic, key, value)``; key = payment id keeps per-payment order."""
    return rows.select("topic", F.col("message_key").alias("key"), F.col("payload").alias("value"),
                       "event_id")


def stamps(rows: DataFrame, batch_id: int, published_at: Column | None = None,
           keep: tuple[str, ...] = ()) -> DataFrame:
    """K7: publish stamps for rows acknowledged by the sink in batch ``batch_id``."""
    at = published_at if published_at is not None else F.current_timestamp()
    return rows.select("event_id", *keep, F.lit(batch_id).cast("bigint").alias("batch_id"),
                       at.alias("published_at"))


def write_records(records: DataFrame, target: str, fmt: str = "parquet", **options: str) -> None:
    """K6 sink: ``fmt="kafka"`` writes ``(topic, key, value)`` to the broker named in
    ``options`` (needs the Kafka connector jar); otherwise records are appended under
    ``target`` partitioned by topic."""
    if fmt == "kafka":
        (records.select("topic", "key", "value").write.format("kafka")
         .option("kafka.bootstrap.servers", target).options(**options).save())
    else:
        records.write.mode("append").partitionBy("topic").format(fmt).options(**options).save(target)
