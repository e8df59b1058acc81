"""Order per key on the way out (T4): sequence numbers, a sink that keeps them, and an audit.

A row's number is its place among its key's rows by time and id. It is counted in two
levels, so a key with a third of all rows is no single task: rows are range partitioned by
(key, time, id), a range adds the rows of its key in the ranges before. The sink puts a
key's rows into one of ``lanes`` by the key's hash (the partitions of a topic), each lane
in the order of keys and numbers, so what reads a lane in order meets each key in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _ranges(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``df`` with ``_k``, the number of its range of (key, order). The cuts come from a sample and would
    differ if computed again, so the rows are written once."""
    return materialize(df.repartitionByRange(key, *order).withColumn("_k", F.spark_partition_id()), "sequence")


def sequenced(df: DataFrame, key: str, order: Sequence[str], name: str = "seq") -> DataFrame:
    """``df`` with the number, from 1 on, of each row among its key's rows in ``order`` (a total one)."""
    cut = _ranges(df, key, order)
    ahead = Window.partitionBy(key).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    before = (cut.groupBy(key, "_k").agg(F.count(F.lit(1)).alias("_c"))                    # a row a key and range
              .withColumn("_before", F.coalesce(F.sum("_c").over(ahead), F.lit(0)))
              .select(F.col(key).alias("_key"), F.col("_k").alias("_range"), "_before"))
    inside = Window.partitionBy(key, "_k").orderBy(*order)
    joined = cut.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_k") == F.col("_range")))
    return joined.withColumn(name, F.col("_before") + F.row_number().over(inside)).drop("_k", "_key", "_range", "_before")


def write_lanes(rows: DataFrame, path: str, key: str, seq: str = "seq", lanes: int = 8) -> None:
    """A folder a lane; a lane's rows are written by one task, in order of key and number."""
    laned = rows.withColumn("lane", F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int"))
    laned.repartition(lanes, "lane").sortWithinPartitions("lane", key, seq).write.mode("overwrite").partitionBy("lane").parquet(path)


def order_audit(rows: DataFrame, key: str, order: Sequence[str], seq: str = "seq") -> DataFrame:
    """Per key: ``rows``, ``gaps`` (numbers up to the largest that are missing), ``repeats`` (rows beyond
    the first of a number) and ``inversions`` (rows whose number is not above that of the row before in time)."""
    cut = _ranges(rows, key, order)
    # the number before a range's first row is the last one of the key's range before
    ends = cut.groupBy(key, "_k").agg(F.max_by(seq, F.struct(*order)).alias("_end"))
    ahead = Window.partitionBy(key).orderBy("_k")
    ends = ends.select(F.col(key).alias("_key"), F.col("_k").alias("_range"), F.lag("_end").over(ahead).alias("_last"))
    inside = Window.partitionBy(key, "_k").orderBy(*order)
    joined = cut.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_k") == F.col("_range")))
    told = joined.withColumn("_down", F.col(seq) <= F.coalesce(F.lag(seq).over(inside), F.col("_last")))
    numbers = told.groupBy(key, seq).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_down").alias("_i"))
    return numbers.groupBy(key).agg(
        F.sum("_n").alias("rows"), (F.max(seq) - F.count(seq)).alias("gaps"),
        (F.sum("_n") - F.count(seq)).alias("repeats"), F.sum("_i").alias("inversions"))
