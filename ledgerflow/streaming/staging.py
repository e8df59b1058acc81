"""Stream inputs and run folders for file-based streams (tests and demos).

Production streams read a broker (``kafka_source``); without the connector
jar, tests replay a table as a sequence of time-sliced parquet files, which the
file source picks up in arrival order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialize


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location for one stream run."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


def replay_in_order(df: DataFrame, time_col: str, folder: str, slices: int,
                    drain: Callable[[], object] | None = None, files: int | None = None) -> int:
    """Append ``df`` to ``folder`` as ``slices`` consecutive time slices, oldest first.

    With ``drain`` (a function that runs the stream with ``availableNow`` from
    its checkpoint), the stream is drained after every slice, so a micro-batch
    never mixes slices and rows are seen in slice order however many files a
    slice is written as; every drain after the first is a restart. Returns the
    slice width in microseconds. Slice bounds come from one min/max aggregate;
    the rows are written once, cut by slice, and every slice is copied from there, so
    what makes ``df`` runs once and no slice passes through the driver. Rows without a
    time come with the first slice. ``files`` deals a slice over that many files.
    """
    t = F.unix_micros(F.col(time_col).cast("timestamp"))
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    slices = slices if lo is not None else 1                  # no times at all: one slice
    lo, hi = (lo, hi) if lo is not None else (0, 0)
    width = max(1, (hi - lo) // slices + 1)
    at = F.coalesce(sum(((t >= lo + i * width).cast("int") for i in range(1, slices)), F.lit(0)), F.lit(0))
    staged = materialize(df.withColumn("_slice", at), "replay", by="_slice")
    for i in range(slices):
        rows = staged.filter(F.col("_slice") == i).select(*df.columns)
        (rows.repartition(files) if files else rows).write.mode("append").parquet(folder)
        if drain is not None:
            drain()
    return width


def kafka_source(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """The broker topic as a stream of ``(key, value, topic, partition, offset, timestamp)``.

    Needs the Kafka connector on the classpath (not bundled here)."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", starting).load()
            .select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                    "topic", "partition", "offset", F.col("timestamp").alias("delivered_at")))


def file_source(spark: SparkSession, schema, pattern: str, files_per_trigger: int | None = None) -> DataFrame:
    """S1 in tests: parquet files under ``pattern`` (glob), in arrival order."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(pattern)
