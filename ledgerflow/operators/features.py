"""Per-customer sliding-window features.

The original keeps, per customer, a deque of recent transactions: each new
transaction reads the deque (previous country, mean of prior amounts), is
appended, the deque is trimmed (last ``max_history`` rows, then rows older
than ``retention_windows`` windows), and the rows inside the window are
counted. Because both trims only cut a prefix of a time-ordered list, the
deque after row *i* is exactly

    rows i-(H-1) .. i  with  t >= t_i - R            (H = max_history, R = retention)

so all features are functions of the ``H + 1`` rows ending at *i* and come out
of one ROWS frame ``-H .. 0`` over ``(customer_id ORDER BY created_at, tiebreak)``:

* ``velocity_count``   rows of the last H with ``t >= t_i - W`` (current included)
* ``geo_distinct``     distinct non-null countries among those (case-sensitive)
* ``previous_country`` country of row i-1 (no expiry)
* ``avg_prior_amount`` mean amount of the deque *before* row i, i.e. rows
  ``i-H .. i-1`` with ``t >= t_{i-1} - R``; HALF_UP at scale 2, null if empty
* ``history_retained`` size of the deque after row i

One Exchange, one Sort, one Window for the whole feature set.

Skew: a window partition is one task. The rows of customers with more than
``hot_customer_rows`` are cut at quantiles of (customer, time, tiebreak) into ranges
of about ``hot_bucket_rows`` rows, a burst within a second too; each range gets a halo
of the customer's ``H`` rows that precede it, taken from the tails of earlier ranges,
so the frame sees exactly the rows it would see unsplit. Halo rows are dropped after
the window. A first, cheap job (partial count per customer) decides whether
any customer is hot; without one the plan is the plain single-shuffle window.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DEFAULT_RULES, RuleConfig
from ..session import materialize

FEATURE_COLUMNS = ("velocity_count", "geo_distinct", "previous_country",
                   "avg_prior_amount", "history_retained")

_MICROS = 1_000_000
# 1e-4 units of any DECIMAL(19,4) amount, and the sum of a frame of them
UNITS, SUM = "decimal(20,0)", "decimal(26,0)"
# Rows that a task cuts into ranges, where ranges are smaller than that
RANGE_TASK_ROWS = 50_000


def _prepare(df: DataFrame, tiebreak: str) -> DataFrame:
    return (df
            .withColumn("_t", F.unix_micros(F.col("created_at").cast("timestamp")))
            .withColumn("_a", (F.col("amount") * 10000).cast(UNITS)))


def _feature_columns(h: Column, prev_t: Column, t: Column, cfg: RuleConfig) -> dict[str, Column]:
    """Features from the collected frame ``h`` (rows i-H .. i, oldest first)."""
    hmax = cfg.max_history
    window_us = cfg.window_seconds * _MICROS
    retention_us = cfg.window_seconds * cfg.retention_windows * _MICROS
    n = F.size(h)
    last = F.slice(h, F.greatest(n - (hmax - 1), F.lit(1)), hmax)          # rows i-H+1 .. i
    in_window = F.filter(last, lambda x: x["t"] >= t - window_us)
    kept = F.filter(last, lambda x: x["t"] >= t - retention_us)
    prior = F.filter(F.slice(h, 1, n - 1), lambda x: x["t"] >= prev_t - retention_us)
    prior_n = F.size(prior).cast("bigint")
    prior_sum = F.aggregate(prior, F.lit(0).cast(SUM), lambda acc, x: (acc + x["a"]).cast(SUM))
    return {
        "_pn": prior_n,
        "_ps": prior_sum,
        "velocity_count": F.size(in_window).cast("bigint"),
        "geo_distinct": F.size(F.array_distinct(F.filter(F.transform(in_window, lambda x: x["c"]),
                                                         lambda c: c.isNotNull()))).cast("bigint"),
        "history_retained": F.size(kept).cast("bigint"),
    }


def _avg_prior() -> Column:
    # HALF_UP to cents on the exact sum S of 1e-4 units: floor((2S + 100n) / 200n), S > 0.
    return F.when(
        F.col("_pn") > 0,
        (F.expr("(_ps * 2 + _pn * 100) div (_pn * 200)").cast("decimal(19,0)")
         * F.lit(Decimal("0.01"))).cast("decimal(19,2)"))


def _windowed(df: DataFrame, part: list[str], tiebreak: str, cfg: RuleConfig) -> DataFrame:
    w = Window.partitionBy(*part).orderBy("_t", tiebreak)
    frame = w.rowsBetween(-cfg.max_history, 0)
    h = F.collect_list(F.struct(F.col("_t").alias("t"), F.col("_a").alias("a"),
                                F.col("country").alias("c"))).over(frame)
    out = (df.withColumn("_h", h)
           .withColumn("previous_country", F.lag("country").over(w))
           .withColumn("_pt", F.lag("_t").over(w)))
    out = out.withColumns(_feature_columns(F.col("_h"), F.col("_pt"), F.col("_t"), cfg))
    out = out.withColumn("avg_prior_amount", _avg_prior())
    return out.drop("_h", "_pt", "_pn", "_ps")


def _hot_customers(df: DataFrame, cfg: RuleConfig) -> DataFrame:
    """``(customer_id, _n)`` of the customers too big for one task: one partial aggregate."""
    counts = df.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > cfg.hot_customer_rows)


def _ranged(rows: DataFrame, tiebreak: str, ranges: int, per_range: int) -> DataFrame:
    """Hot customers' rows with ``_b``, the number of their range from 1 on, rising in the order of (customer,
    time, tiebreak): quantile cuts, so ranges have about the same number of rows however the rows lie in
    time. Small ranges share a task, so tasks, samples and files grow with the rows and not with the ranges: a
    task's rows are sorted and counted off. The cuts come from a sample and would differ if computed again,
    so the rows are written once."""
    order = ["customer_id", "_t", tiebreak]
    each = max(1, RANGE_TASK_ROWS // per_range)                         # ranges of a task
    cut = rows.repartitionByRange(-(-ranges // each), *order)
    if each == 1:
        numbered = cut.withColumn("_b", (F.spark_partition_id() + 1).cast("bigint"))
    else:                                                               # the task in the upper bits, the row of it below
        numbered = (cut.sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id())
                    .withColumn("_b", F.expr(f"shiftright(_i, 33) * {1 << 33} + (_i & {(1 << 33) - 1}) div {per_range} + 1")).drop("_i"))
    return materialize(numbered, "hot_rows")


def _with_halo(df: DataFrame, tiebreak: str, cfg: RuleConfig, hot: DataFrame, ranges: int) -> DataFrame:
    """Tag hot customers' rows with a range and add the halo rows; all others are in range 0."""
    names = hot.select("customer_id")                                   # broadcast or not by its size at run time
    cut = _ranged(df.join(names, "customer_id", "left_semi"), tiebreak, ranges, cfg.hot_bucket_rows)
    tagged = (df.join(names, "customer_id", "left_anti").withColumn("_b", F.lit(0).cast("bigint"))
              .unionByName(cut).withColumn("_halo", F.lit(False)))
    hmax = cfg.max_history
    hot_rows = cut.select("customer_id", "_b", "_t", tiebreak, "_a", "country")
    # Last H rows of every (customer, range): a per-group limit, computed before the shuffle.
    desc = Window.partitionBy("customer_id", "_b").orderBy(F.desc("_t"), F.desc(tiebreak))
    tails = (hot_rows.withColumn("_r", F.row_number().over(desc)).filter(F.col("_r") <= hmax)
             .groupBy("customer_id", "_b")
             .agg(F.collect_list(F.struct("_t", tiebreak, "_a", "country")).alias("_tail")))
    # Halo of range b: the last H rows of the (at most H) ranges before it that hold rows of the customer.
    prev = Window.partitionBy("customer_id").orderBy("_b").rowsBetween(-hmax, -1)
    halo = (tails.withColumn("_all", F.array_sort(F.flatten(F.collect_list("_tail").over(prev))))
            .select("customer_id", "_b",
                    F.explode(F.slice("_all", F.greatest(F.size("_all") - (hmax - 1), F.lit(1)), hmax))
                    .alias("_r"))
            .select("customer_id", "_b", "_r._t", F.col(f"_r.{tiebreak}").alias(tiebreak),
                    "_r._a", "_r.country", F.lit(True).alias("_halo")))
    return tagged.unionByName(halo, allowMissingColumns=True)


def activity_snapshot(df: DataFrame, cfg: RuleConfig = DEFAULT_RULES,
                      tiebreak: str = "event_id", hot_source: DataFrame | None = None) -> DataFrame:
    """Add the five activity features to every transaction row of ``df``.

    ``df`` needs ``customer_id``, ``created_at``, ``amount`` (decimal),
    ``country`` and the tie-break column. Row order within a customer is
    ``(created_at, tiebreak)``. ``hot_source`` (``customer_id``) is where hot customers are counted when ``df`` is expensive to compute
    twice; any superset of ``df``'s customers works (splitting a customer that
    is not hot is still exact).
    """
    prepared = _prepare(df, tiebreak)
    hot = _hot_customers(prepared if hot_source is None else hot_source, cfg)
    rows = hot.agg(F.sum("_n")).first()[0] if cfg.split_hot else None
    # The halo path is planned only when some customer is hot.
    if rows:
        staged = _with_halo(prepared, tiebreak, cfg, hot, -(-rows // cfg.hot_bucket_rows))
        out = _windowed(staged, ["customer_id", "_b"], tiebreak, cfg)
        out = out.filter(~F.col("_halo")).drop("_b", "_halo")
    else:
        out = _windowed(prepared, ["customer_id"], tiebreak, cfg)
    return out.drop("_t", "_a")
