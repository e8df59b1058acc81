"""Rates and increases as streams (T9, T10): watermarked windows in append mode.

A window's row leaves once, when the watermark has passed its end; the state holds open
windows only. Rows behind the watermark are not counted in their window: the progress
tells how many, and ``RateSink`` keeps the sum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scoped_conf
from .effectively_once import CommitLog
from .monitor import rows_dropped_by_watermark
from .staging import replay_in_order, run_folder
from .triage_state import FAR_FUTURE


def stream_counts(stream: DataFrame, ts: str, by: Sequence[str] = (), length: str = "1 minute", slide: str = "10 seconds",
                  delay: str = "10 minutes") -> DataFrame:
    """``window_start``, ``by`` and ``events`` of every window of a stream."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    counted = timed.groupBy(F.window(ts, length, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "events")


class RateRun:
    """Replays a table through ``stream_counts`` and keeps what leaves the stream."""

    def __init__(self, spark: SparkSession, rows: DataFrame, ts: str, by: Sequence[str] = (), length: str = "1 minute",
                 slide: str = "10 seconds", slices: int = 4):
        self.spark, self.ts, self.by, self.length, self.slide = spark, ts, list(by), length, slide
        self.root = run_folder(spark, "stream_rates")
        self.log, self.late = CommitLog(spark, f"{self.root}/out"), 0
        self.rows = rows.select(ts, *by)
        self.schema = ", ".join(["window_start timestamp", *[f"{c} {self.rows.schema[c].dataType.simpleString()}" for c in by], "events bigint"])
        # a slice's files have no order among themselves: the delay covers a slice
        self.delay = replay_in_order(self.rows, ts, f"{self.root}/input", slices) // 1_000_000 + 1

    def _sink(self, batch: DataFrame, batch_id: int) -> None:
        self.log.write("windows", batch, batch_id)
        self.log.commit(batch_id)

    def drain(self, files: int | None = 2) -> None:
        reader = self.spark.readStream.schema(self.rows.schema)
        reader = reader.option("maxFilesPerTrigger", files) if files else reader
        counts = stream_counts(reader.parquet(f"{self.root}/input"), self.ts, self.by, self.length, self.slide, f"{self.delay} seconds")
        with scoped_conf(self.spark, **{"spark.sql.shuffle.partitions": str(self.spark.sparkContext.defaultParallelism)}):
            query = (counts.writeStream.foreachBatch(self._sink).option("checkpointLocation", f"{self.root}/checkpoint")
                     .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
        self.late += rows_dropped_by_watermark(query)

    def add(self, rows: DataFrame) -> None:
        rows.select(self.ts, *self.by).write.mode("append").parquet(f"{self.root}/input")

    def close(self) -> DataFrame:
        """A row of the far future moves the watermark past every window; its own ones never leave."""
        self.add(self.rows.limit(1).withColumn(self.ts, F.lit(FAR_FUTURE).cast(self.rows.schema[self.ts].dataType)))
        self.drain()
        return self.windows()

    def windows(self) -> DataFrame:
        return self.log.committed("windows", self.schema).drop("batch_id")
