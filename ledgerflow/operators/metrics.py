"""Operational metrics (A4-A13, T9, T10) as aggregates over the event tables.

The original exports counters and histograms to a time-series store and draws
them with range queries; here each panel is a grouped aggregate over the same
facts (requests, processed events, dead letters), so it scales with the data
and needs no metric registry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Fixed latency histogram bounds (ms) used by the histogram quantile panel.
LATENCY_BUCKETS_MS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0)


def nearest_rank_percentiles(df: DataFrame, value: str, ps: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """A9 + O3: exact nearest-rank percentiles ``sorted[min(n-1, round_half_even(p/100*(n-1)))]`` and max.

    Distributed rank: values are reduced to ``(value, count)`` and range
    partitioned, as wide as the session's shuffles; prefix sums run over the
    partitions' totals (a row a partition) and inside each partition, and their
    sum is the exact running count of every distinct value. The partitioning is
    written once, so that both sums see the same one.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    ranged = materialize(counts.repartitionByRange(F.col(value)).withColumn("_k", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_k").agg(F.sum("_c").alias("_t"))
    before = (totals.withColumn("_before", F.sum("_t").over(
        Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_n", F.sum("_t").over(Window.partitionBy()))
        .fillna(0, ["_before"]).select("_k", "_before", "_n"))
    inside = Window.partitionBy("_k").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = (ranged.join(F.broadcast(before), "_k")                 # a row a partition
           .withColumn("_cum", F.col("_before") + F.sum("_c").over(inside)))
    aggs = []
    for p in ps:
        k = F.least(F.col("_n") - 1, F.bround((F.col("_n") - 1) * (p / 100.0), 0))
        aggs.append(F.min(F.when(F.col("_cum") > k, F.col(value))).alias(f"p{p}"))
    aggs += [F.max(value).alias("max"), F.max("_n").alias("n")]
    return cum.agg(*aggs)


def quantile_sketches(df: DataFrame, ts: str, value: str, every: str = "minute", k: int = 800) -> DataFrame:
    """A9 as a table that can be rolled up: a KLL sketch of the values of every minute (or other unit),
    ``bucket_start, sketch, n``. A larger ``k`` makes the ranks closer (800: within half a percent)."""
    return (df.filter(F.col(value).isNotNull()).groupBy(F.date_trunc(every, ts).alias("bucket_start"))
            .agg(F.kll_sketch_agg_double(value, k).alias("sketch"), F.count(F.lit(1)).alias("n")))


def rolled_up(sketches: DataFrame, to: str, qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles of any longer unit from stored sketches, without the values."""
    merged = sketches.groupBy(F.date_trunc(to, "bucket_start").alias("bucket_start")).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    return merged.select("bucket_start", "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"p{int(q * 100)}") for q in qs])


def rank_errors(df: DataFrame, ts: str, value: str, quantiles: DataFrame, unit: str, qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """How far the ranks of given quantiles are from those asked for: 0 where the rank asked for lies
    between the shares of values below and up to the answer."""
    rows = df.filter(F.col(value).isNotNull()).select(F.date_trunc(unit, ts).alias("bucket_start"), F.col(value).alias("_v"))
    joined = rows.join(quantiles, "bucket_start")
    aggs = []
    for q in qs:
        answer, n = F.col(f"p{int(q * 100)}"), F.count(F.lit(1))
        low, high = F.count_if(F.col("_v") < answer) / n, F.count_if(F.col("_v") <= answer) / n
        aggs.append(F.greatest(low - q, F.lit(q) - high, F.lit(0.0)).alias(f"p{int(q * 100)}_error"))
    return joined.groupBy("bucket_start").agg(F.count(F.lit(1)).alias("n"), *aggs)


def throughput(df: DataFrame, ts: str) -> DataFrame:
    """A10: rows, elapsed seconds between first and last row, rows per second."""
    secs = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6
    return df.agg(F.count(F.lit(1)).alias("rows"), secs.alias("seconds"),
                  (F.count(F.lit(1)) / secs).alias("rows_per_sec"))


def _bucket_bound(v: Column, bounds: tuple[float, ...]) -> Column:
    expr = F.lit(float("inf"))
    for b in reversed(bounds):
        expr = F.when(v <= b, F.lit(b)).otherwise(expr)
    return expr


def _lower_bound(le: Column, bounds: tuple[float, ...]) -> Column:
    expr = F.lit(bounds[-1])                    # the +Inf bucket starts at the last bound
    for prev, b in reversed(list(zip((0.0,) + bounds[:-1], bounds))):
        expr = F.when(le == b, F.lit(prev)).otherwise(expr)
    return expr


def histogram_quantiles(df: DataFrame, ts: str, value: str, qs: tuple[float, ...] = (0.5, 0.99),
                        window: str = "5 minutes",
                        bounds: tuple[float, ...] = LATENCY_BUCKETS_MS) -> DataFrame:
    """Quantiles by linear interpolation inside cumulative latency buckets, per window.

    Same rule as a Prometheus ``histogram_quantile``: rank = q * total, first
    bucket whose cumulative count reaches the rank, interpolate between its
    bounds (the first bucket starts at 0); a rank in the +Inf bucket answers
    the highest finite bound. The running sum is per window over at most
    ``len(bounds) + 1`` bucket rows.
    """
    buckets = (df.groupBy(F.window(ts, window).start.alias("window_start"),
                          _bucket_bound(F.col(value), bounds).alias("le"))
               .agg(F.count(F.lit(1)).alias("c")))
    w = Window.partitionBy("window_start").orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    cum = (buckets.withColumn("cum", F.sum("c").over(w))
           .withColumn("total", F.sum("c").over(Window.partitionBy("window_start"))))
    aggs = []
    for q in qs:
        hit = F.min(F.when(F.col("cum") >= F.col("total") * q, F.struct("le", "c", "cum")))
        aggs.append(hit.alias(f"_h{int(q * 100)}"))
    per_window = cum.groupBy("window_start").agg(F.max("total").alias("total"), *aggs)
    out = per_window
    for q in qs:
        h = F.col(f"_h{int(q * 100)}")
        lower = _lower_bound(h["le"], bounds)
        rank = F.col("total") * q
        interp = lower + (h["le"] - lower) * ((rank - (h["cum"] - h["c"])) / h["c"])
        out = out.withColumn(f"p{int(q * 100)}",
                             F.when(h["le"] == float("inf"), F.lit(bounds[-1])).otherwise(interp))
    return out.drop(*[f"_h{int(q * 100)}" for q in qs])


def error_rate(log: DataFrame, ts: str = "ts", status: str = "status", window: str = "1 minute",
               window_seconds: int = 60) -> DataFrame:
    """``100 * rate(5xx) / max(rate(all), 1)`` per window; no 5xx counts as 0 (Q26)."""
    g = log.groupBy(F.window(ts, window).start.alias("window_start")).agg(
        F.count_if(F.col(status) >= 500).alias("errors"), F.count(F.lit(1)).alias("requests"))
    return g.withColumn(
        "error_pct",
        100 * (F.col("errors") / window_seconds) / F.greatest(F.col("requests") / window_seconds, F.lit(1.0)))


def sliding_rate(df: DataFrame, ts: str, by: list[str] | None = None, length: str = "1 minute",
                 slide: str = "10 seconds", length_seconds: int = 60) -> DataFrame:
    """``rate(x[1m])`` sampled every slide, optionally ``by (status)``."""
    keys = [F.window(ts, length, slide).start.alias("window_start")] + [F.col(c) for c in by or []]
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))
            .withColumn("rate_per_sec", F.col("events") / length_seconds))


def sliding_increase(df: DataFrame, ts: str, length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """``increase(x[5m])``: events per sliding window."""
    return df.groupBy(F.window(ts, length, slide).start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("increase"))


def in_flight_lag(deliveries: DataFrame, finished_at: Column, every_seconds: int = 60) -> DataFrame:
    """Consumer lag per partition, sampled at each ``every_seconds`` boundary.

    A record counts towards the lag at boundary ``b`` when it arrived at or
    before ``b`` and finished after ``b``. Each record contributes to the
    boundaries inside its own ``[arrival, finish)`` interval, so no ordered pass
    over a partition is needed. Output: partition, max_lag.
    """
    step = every_seconds * 1_000_000
    arrive = F.unix_micros("delivered_at")
    finish = F.unix_micros(finished_at)
    first_b = F.ceil(arrive / step) * step
    last_b = F.ceil(finish / step) * step - step            # boundaries b with b < finish
    spans = deliveries.select("partition", first_b.alias("_lo"), last_b.alias("_hi"))
    points = (spans.filter(F.col("_lo") <= F.col("_hi"))
              .select("partition", F.explode(F.sequence("_lo", "_hi", F.lit(step))).alias("_b")))
    lag = points.groupBy("partition", "_b").agg(F.count(F.lit(1)).alias("lag"))
    parts = deliveries.select("partition").distinct()
    return (parts.join(lag.groupBy("partition").agg(F.max("lag").alias("max_lag")), "partition", "left")
            .fillna(0, ["max_lag"]))
