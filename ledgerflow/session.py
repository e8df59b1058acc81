"""SparkSession construction and the shared checkpoint location.

Cluster jobs get their session (and ``spark.checkpoint.dir``) from the
cluster. Only local runs (tests, bench) fill in defaults, and only for
settings that are not already set.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Defaults for local runs. Every one is applied with ``setIfMissing`` semantics.
LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "8g",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Keyed state with several variables needs this store, and a session may come with another one.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

# Joins whose sides all grow with the input: a side that fits a broadcast today goes through the driver.
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def get_spark(master: str | None = None, app: str = "ledgerflow", **conf: str) -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master or os.environ.get("LEDGERFLOW_MASTER", "local[8]"))
    settings = dict(LOCAL_DEFAULTS)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the cluster (a shared filesystem). Only a
    local-mode session without the setting gets a scratch folder of its own.
    """
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(current)
        return current
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerflow-ckpt-"))
    return context.getCheckpointDir()


def materialize(df, name: str = "stage", by: str | None = None):
    """Cut lineage by writing ``df`` as parquet under the shared checkpoint folder
    and reading it back (one job; survives executor loss, unlike a local checkpoint).
    ``by`` is a column with few values to write a folder for each of."""
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(path)
        return spark.read.parquet(path)
    df.write.partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scoped_conf(spark: SparkSession, **conf: str):
    """Set session options for the duration of a block, then restore them."""
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
