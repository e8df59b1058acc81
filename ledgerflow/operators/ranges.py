"""Range functions of the panels (A11-A13): sliding ranges by panes, and peaks by a sweep.

A panel evaluates a function over the last minutes, again every few seconds. Rows are
first counted into panes as wide as the step; a range is then the sum of its last panes,
in a bounded window frame. No row is copied into the ranges that it belongs to. The window
is cut into blocks of time, each with the panes before it that its first ranges need, so
a long series is many partitions and the steps without rows are filled in block by block.

A peak (how many records are in flight at once) is the largest running sum of +1 at each
start and -1 at each end, over time ranges with the sums of the ranges before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import materialize
from .metrics import LATENCY_BUCKETS_MS

#: Steps of a block; a block is never shorter than a range.
BLOCK_STEPS = 240


def panes(df: DataFrame, ts: str, counts: dict[str, Column], step_seconds: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts per pane: ``by``, ``step`` (its start, in seconds since 1970) and the sums of ``counts``."""
    seconds = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000 / step_seconds).cast("bigint") * step_seconds
    return (df.filter(F.col(ts).isNotNull()).groupBy(*by, seconds.alias("step"))
            .agg(*[F.sum(c.cast("bigint")).alias(n) for n, c in counts.items()]))


def sliding(panes: DataFrame, names: Sequence[str], range_seconds: int, step_seconds: int, by: Sequence[str] = (),
            any_of: str | None = None) -> DataFrame:
    """``by``, ``range_end`` and the sums of ``names`` over ``[range_end - range, range_end)``, at every
    step whose range has rows (``any_of`` names the count that tells, by default the first one)."""
    if range_seconds % step_seconds:
        raise ValueError("a range is a whole number of steps")
    block = step_seconds * max(BLOCK_STEPS, range_seconds // step_seconds)
    own = F.floor(F.col("step") / block).cast("bigint")
    reach = F.floor((F.col("step") + range_seconds - step_seconds) / block).cast("bigint")
    # a pane stands in its own block and, near the end, in the next one
    placed = panes.select(*by, "step", *names, F.explode(F.array_distinct(F.array(own, reach))).alias("block"))
    steps = F.sequence(F.col("block") * block, (F.col("block") + 1) * block - step_seconds, F.lit(step_seconds).cast("bigint"))
    grid = (placed.select(*by, "block").distinct().select(*by, "block", F.explode(steps).alias("step"))
            .select(*by, "step", *[F.lit(0).cast("bigint").alias(n) for n in names], "block", F.lit(True).alias("asked")))
    both = placed.withColumn("asked", F.lit(False)).unionByName(grid)
    frame = Window.partitionBy(*by, "block").orderBy("step").rangeBetween(-(range_seconds - step_seconds), 0)
    out = both.withColumns({n: F.sum(n).over(frame) for n in names}).filter(F.col("asked") & (F.col(any_of or names[0]) > 0))
    return out.select(*by, F.timestamp_seconds(F.col("step") + step_seconds).alias("range_end"), *names)


def sliding_quantiles(df: DataFrame, ts: str, value: str, qs: Sequence[float] = (0.5, 0.99), range_seconds: int = 300,
                      step_seconds: int = 15, by: Sequence[str] = (), bounds: Sequence[float] = LATENCY_BUCKETS_MS) -> DataFrame:
    """``histogram_quantile(q, rate(bucket[range]))`` at every step. Panes hold cumulative bucket
    counts, which add up; the quantile lies in the first bucket whose count reaches the rank, linearly
    between its bounds. Beyond the last bound the answer is that bound. Null values don't count."""
    names = ["total", *[f"le_{i}" for i in range(len(bounds))]]
    v = F.col(value)
    counts = {"total": v.isNotNull().cast("int")} | {f"le_{i}": F.coalesce(v <= b, F.lit(False)).cast("int") for i, b in enumerate(bounds)}
    sums = sliding(panes(df, ts, counts, step_seconds, by), names, range_seconds, step_seconds, by)
    for q in qs:
        rank, answer = F.col("total") * q, F.lit(float(bounds[-1]))
        for i in reversed(range(len(bounds))):
            low, below = (bounds[i - 1], F.col(f"le_{i - 1}")) if i else (0.0, F.lit(0))
            inside = F.lit(low) + F.lit(bounds[i] - low) * ((rank - below) / (F.col(f"le_{i}") - below))
            answer = F.when(F.col(f"le_{i}") >= rank, inside).otherwise(answer)
        sums = sums.withColumn(f"p{int(q * 100)}", answer)
    return sums.drop(*names[1:])


def sliding_error_rate(log: DataFrame, ts: str = "ts", status: str = "status", range_seconds: int = 60, step_seconds: int = 15) -> DataFrame:
    """``100 * rate(5xx[range]) / max(rate(all[range]), 1)`` at every step."""
    counts = {"requests": F.lit(1), "errors": F.coalesce(F.col(status) >= 500, F.lit(False)).cast("int")}
    sums = sliding(panes(log, ts, counts, step_seconds), ["requests", "errors"], range_seconds, step_seconds)
    return sums.withColumn("error_pct", 100 * (F.col("errors") / range_seconds) / F.greatest(F.col("requests") / range_seconds, F.lit(1.0)))


def sliding_events_rate(df: DataFrame, ts: str, range_seconds: int = 300, step_seconds: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """``rate(x[range])`` at every step."""
    sums = sliding(panes(df, ts, {"events": F.lit(1)}, step_seconds, by), ["events"], range_seconds, step_seconds, by)
    return sums.withColumn("rate_per_sec", F.col("events") / range_seconds)


def cause_of(reason: Column) -> Column:
    """The kind of a dead letter's reason, without the record's own values."""
    return (F.when(reason.startswith(S.PAYMENT_NOT_FOUND), "payment not found").when(reason.startswith(S.REASON_NO_DECISION), "no decision")
            .when(reason.startswith(S.REASON_LONG_ID), "long event id").otherwise("unparseable"))


def peak_in_flight(df: DataFrame, start: Column, end: Column, by: Sequence[str]) -> DataFrame:
    """``by``, ``peak`` (the most records in flight at once) and ``peak_at`` (the first instant of it).

    A record is in flight from its start up to its end, without the end itself; a null end never
    comes, a null start never was, and an end before the start counts as none. Changes are summed
    per instant first, then cut into ranges of (by, time); a range adds what the ranges before it
    have left in flight.
    """
    flights = df.select(*by, F.unix_micros(start.cast("timestamp")).alias("_s"), F.unix_micros(end.cast("timestamp")).alias("_e"))
    flights = flights.filter("_s is not null and (_e is null or _e > _s)")
    changes = flights.select(*by, F.explode(F.array(F.struct(F.col("_s").alias("t"), F.lit(1).alias("d")),
                                                    F.struct(F.col("_e").alias("t"), F.lit(-1).alias("d")))).alias("c"))
    net = changes.filter("c.t is not null").groupBy(*by, F.col("c.t").alias("t")).agg(F.sum("c.d").alias("d"))
    cut = materialize(net.repartitionByRange(*by, "t").withColumn("_k", F.spark_partition_id()), "sweep")
    ahead = Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    before = (cut.groupBy(*by, "_k").agg(F.sum("d").alias("_d"))                       # a row a range
              .withColumn("_before", F.coalesce(F.sum("_d").over(ahead), F.lit(0))).drop("_d"))
    inside = Window.partitionBy(*by, "_k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_k")]
    running = cut.alias("a").join(before.alias("b"), same).select(*[F.col(f"a.{c}").alias(c) for c in by], F.col("a._k").alias("_k"), "t", "d", "_before") \
        .withColumn("_n", F.col("_before") + F.sum("d").over(inside))
    return running.groupBy(*by).agg(F.max(F.struct(F.col("_n").alias("n"), (-F.col("t")).alias("t"))).alias("m")).select(
        *by, F.col("m.n").alias("peak"), F.timestamp_micros(-F.col("m.t")).alias("peak_at"))
