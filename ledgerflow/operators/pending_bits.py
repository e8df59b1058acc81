"""Pending outbox ids as a bitmap complement.

The outbox has dense ids. Each batch of new rows and each batch of publish stamps leaves a
bitmap for every bucket of 32,768 ids that it touches (``bitmap_construct_agg``); a bucket's
bitmaps are merged by ``bitmap_or_agg``. A bucket is open while its created bits outnumber
its published ones. A poll reads the bitmaps, finds the lowest open bucket (the low-water
mark) and scans the outbox, which is partitioned by bucket, only from there on, and only
in open buckets; nothing that is published in full is ever read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.effectively_once import CommitLog

BITS = "bucket long, bits binary"


def bitmaps(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """``(bucket, bits)`` of the ids."""
    i = F.col(id_col)
    return ids.filter(i.isNotNull()).groupBy(F.bitmap_bucket_number(i).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(i)).alias("bits"))


def merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bit_is_set(bits: Column, id_col: Column) -> Column:
    """Whether an id's bit is set in its bucket's bitmap (null: no bitmap, so not)."""
    at = F.bitmap_bit_position(id_col)
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


class PendingIds:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.rows, self.stamps = CommitLog(spark, f"{root}/created"), CommitLog(spark, f"{root}/published")

    def append(self, outbox: DataFrame, batch_id: int) -> None:
        """New outbox rows: the rows by bucket, and their bits."""
        rows = outbox.withColumn("bucket", F.bitmap_bucket_number("id"))
        (rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/outbox/batch_id={batch_id}"))
        self.rows.write("bits", bitmaps(outbox), batch_id)
        self.rows.commit(batch_id)

    def publish(self, ids: DataFrame, batch_id: int) -> None:
        """Publish stamps: the bits of the ids that the sink has acknowledged."""
        self.stamps.write("bits", bitmaps(ids), batch_id)
        self.stamps.commit(batch_id)

    def open_buckets(self) -> DataFrame:
        """``(bucket, bits)`` of the buckets with pending ids, with their published bits."""
        created = merged(self.rows.committed("bits", BITS)).withColumnRenamed("bits", "_created")
        published = merged(self.stamps.committed("bits", BITS))
        left = F.bitmap_count("_created") - F.coalesce(F.bitmap_count("bits"), F.lit(0))
        return created.join(published, "bucket", "left").filter(left > 0).select("bucket", "bits")

    def low_water(self) -> int | None:
        """The first bucket with pending ids; null if there is none."""
        return self.open_buckets().agg(F.min("bucket")).first()[0]

    def pending(self, schema: str) -> DataFrame:
        """The outbox rows that no stamp covers."""
        low = self.low_water()
        if low is None:
            return self.spark.createDataFrame([], schema)
        marks = self.spark.read.schema("committed bigint, batch_id bigint").parquet(f"{self.rows.root}/_commits").select("batch_id")
        rows = self.spark.read.schema(f"{schema}, batch_id bigint, bucket bigint").parquet(f"{self.root}/outbox").filter(F.col("bucket") >= low)
        rows = rows.join(marks, "batch_id", "left_semi").join(self.open_buckets(), "bucket")
        return rows.filter(~bit_is_set(F.col("bits"), F.col("id"))).drop("bits", "bucket", "batch_id")
