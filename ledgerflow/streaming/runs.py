"""End-to-end stream runs over a staged copy of a table (tests, registered queries).

Each run gets its own folder under the shared checkpoint location; the stream
reads the staged files with ``Trigger.AvailableNow`` and writes through a commit
log, so reading the output back gives only committed results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DEFAULT_RULES, RuleConfig
from ..session import STATE_STORE, scoped_conf
from .effectively_once import CommitLog, TriageSink
from .staging import replay_in_order, run_folder
from .triage_state import FAR_FUTURE, OUTPUT_SCHEMA, stream_activity

_COLS = ["payment_id", "customer_id", "created_at", "event_id", "amount", "currency", "country"]


def stream_triage_run(spark: SparkSession, payments: DataFrame, cfg: RuleConfig = DEFAULT_RULES,
                      slices: int = 4, files_per_trigger: int = 2, delay_seconds: int = 600,
                      state_partitions: int | None = None, stragglers: DataFrame | None = None,
                      activity: Callable[[DataFrame, RuleConfig, str], DataFrame] | None = None) -> CommitLog:
    """Replay ``payments`` as a time-ordered stream through the stateful fold;
    the log holds the ``features`` and the ``late_rows`` tables.

    Slices are appended oldest first, so their files arrive in time order; the
    files of one slice have no order among themselves, so the watermark delay
    is at least one slice's time span (no row of a slice can fall behind the
    watermark). A far-future sentinel row closes the input: it moves the
    watermark past every real row, the event-time timeouts release what is
    still buffered, and the sentinel itself stays buffered (it is never
    emitted). ``stragglers`` arrive after that, in one micro-batch, so those not
    after their customer's last row are late. The state is split into
    ``state_partitions`` partitions (fixed by the checkpoint at the first start;
    default: the cluster's core count) and is kept by RocksDB, whatever the session's
    store is. A micro-batch takes ``files_per_trigger`` files, or half a slice of the
    replay where that is more. ``activity`` is another form of the stateful step (``triage_slices``).
    """
    root = run_folder(spark, "stream_triage")
    data = payments.select(*_COLS)
    width_us = replay_in_order(data, "created_at", f"{root}/input", slices)
    delay = max(delay_seconds, width_us // 1_000_000 + 1)
    sink = TriageSink(spark, f"{root}/out")
    # every micro-batch goes through the whole state for timers, so their number is that of the slices, not of the files
    def share() -> int:
        written = len(spark.read.schema(data.schema).parquet(f"{root}/input").inputFiles())
        return max(files_per_trigger, -(-written // (2 * slices)))

    parts = state_partitions or spark.sparkContext.defaultParallelism

    def drain(files: int | None) -> None:
        reader = spark.readStream.schema(data.schema)
        reader = reader.option("maxFilesPerTrigger", files) if files else reader
        source = reader.parquet(f"{root}/input")
        feats = (activity(source, cfg, f"{delay} seconds") if activity
                 else stream_activity(source, cfg, f"{delay} seconds", keep_late=True))
        with scoped_conf(spark, **STATE_STORE, **{"spark.sql.shuffle.partitions": str(parts)}):
            query = (feats.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint")
                     .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()

    sentinel = (data.limit(1)
                .withColumn("payment_id", F.lit("__end__")).withColumn("customer_id", F.lit("__end__"))
                .withColumn("created_at", F.lit(FAR_FUTURE).cast("timestamp")))
    sentinel.write.mode("append").parquet(f"{root}/input")
    drain(share())
    if stragglers is not None:
        stragglers.select(*_COLS).write.mode("append").parquet(f"{root}/input")
        drain(None)
    return sink.log


def stream_triage_features(spark: SparkSession, payments: DataFrame, cfg: RuleConfig = DEFAULT_RULES,
                           slices: int = 4, files_per_trigger: int = 2, delay_seconds: int = 600,
                           state_partitions: int | None = None) -> DataFrame:
    """The committed features of a replay (``stream_triage_run``)."""
    log = stream_triage_run(spark, payments, cfg, slices, files_per_trigger, delay_seconds, state_partitions)
    return log.committed("features", OUTPUT_SCHEMA)
