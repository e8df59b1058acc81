"""Outbox relay as a stream.

Each micro-batch publishes the rows it sees that carry no publish stamp yet
(initial stamps plus stamps of committed batches), writes the sink records
partitioned by topic, then the stamps, then the commit marker. The poll
interval of the original becomes the trigger (``processingTime``); tests use
``availableNow``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import publish as PB
from .effectively_once import CommitLog


class RelaySink:
    """``foreachBatch`` target for an outbox stream."""

    def __init__(self, spark: SparkSession, root: str, published: DataFrame):
        self.log = CommitLog(spark, root)
        self.published = published

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            before = self.log.committed("stamps", "event_id string", exclude=batch_id).select("event_id")
            stamped = self.published.select("event_id").unionByName(before)
            stamped = stamped.join(batch.select("event_id").distinct(), "event_id", "left_semi")   # the batch's own
            rows = PB.pending(batch, stamped)
            self.log.write("records", PB.publish_records(rows), batch_id)
            self.log.write("stamps", PB.stamps(rows, batch_id, keep=("topic",)), batch_id)
            self.log.commit(batch_id)
        finally:
            batch.unpersist()


def relay_query(stream: DataFrame, sink: RelaySink, checkpoint: str, interval: str | None = "500 milliseconds"):
    """Start the relay; ``interval=None`` drains what is available and stops."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()
