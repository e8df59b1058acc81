"""Exact deduplication as a stateful stream over a table's files.

The stream keeps one state row per text digest in RocksDB, on disk and in the shared
checkpoint, and never lets it expire: the digest, the largest document id, the place
of that document's row (file and row number in it) and the number of rows seen. Files
that arrive later go through the same state (``Deduplicator.take`` again), so a copy
of a text from any earlier run is a hit.

A digest that several rows have is a hit, and hits are compared byte by byte: the
rows' texts are fetched by their places, and each is compared with the text that the
state's place points to. Rows of one digest whose bytes differ are grouped by their
texts, so a clash of digests never joins two texts.

Of equal texts the row with the largest id stays, of rows that share that id too, the
one with the largest place. Null texts count as empty. Rows without an id take part
and stay only where no row of their text has one (``keep_id`` is then null). Every
row gives one row; an empty table gives none. Extra columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scoped_conf
from .common import Stages, named

#: The state store: on disk, with a bound on what its instances of an executor hold in memory;
#: small stores take no more room than they fill, and a micro-batch writes its changes only.
STORE = {"spark.sql.streaming.stateStore.providerClass":
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
         "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


class Deduplicator:
    """Dedup state of one table, which may grow by files.

    ``rounds`` is about the number of micro-batches that a first pass takes;
    ``digits`` shortens the digest (tests use it to make digests clash).
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                 rounds: int = 2, digits: int = 64):
        self.spark, self.path, self.rounds, self.digits = spark, path, rounds, digits
        self.id_col, self.text_col = id_col, text_col
        self.stages = Stages(spark, "exact-dedup")
        self.runs = 0

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _rows(self, source: DataFrame, *more) -> DataFrame:
        """``(id, digest, at)`` and more of each row; ``at`` is the row's place."""
        place = source.metadataColumn("_metadata")
        text = F.coalesce(source[f"`{self.text_col}`"].cast("string"), F.lit(""))
        return source.select(source[f"`{self.id_col}`"].cast("long").alias("id"),
                             F.left(F.sha2(text, 256), F.lit(self.digits)).alias("digest"),
                             F.struct(place["file_path"].alias("file"), place["row_index"].alias("row")).alias("at"),
                             *[text.alias(name) for name in more])

    def _source(self, reader):
        # a pattern, since a stream's path must else be a folder
        return reader.parquet(f"{self.path[:-1]}[{self.path[-1]}]")

    def take(self) -> None:
        """Bring the files that the state has not seen into it."""
        fs, hadoop = self._fs(self.path)
        size = max(1, -(-fs.getContentSummary(hadoop).getLength() // self.rounds))
        schema = self.spark.read.parquet(self.path).schema
        rows = self._rows(self._source(self.spark.readStream.schema(schema).option("maxBytesPerTrigger", size)))
        state = rows.groupBy("digest").agg(F.max(F.struct("id", "at")).alias("keep"), F.count(F.lit(1)).alias("n"))
        with scoped_conf(self.spark, **STORE):
            query = (state.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
                     .option("checkpointLocation", self.stages.path("state")).start())
        query.awaitTermination()

    def state(self) -> DataFrame:
        """``(digest, keep, n)``: the state as it stands, read from the store."""
        fs, commits = self._fs(self.stages.path("state/commits"))
        if not fs.exists(commits):
            return self.spark.createDataFrame([], "digest string, keep struct<id:long,at:struct<file:string,row:long>>, n long")
        self.runs += 1
        with scoped_conf(self.spark, **STORE):
            stored = self.spark.read.format("statestore").load(self.stages.path("state"))
            return self.stages.table(stored.select("key.digest", "value.*").toDF("digest", "keep", "n"), f"groups-{self.runs}")

    def result(self) -> DataFrame:
        """``(id, keep_id, group_size, kept, digest)`` of every row seen."""
        groups = self.state()
        run = self.runs
        alone = groups.where("n = 1").select("keep.id", F.col("keep.id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                             F.lit(True).alias("kept"), "digest")
        shared = groups.where("n > 1").select("digest", "keep", "n")
        source = self._source(self.spark.read)
        hits = self.stages.table(self._rows(source).join(shared, "digest"), f"hits-{run}")
        texts = self._rows(source, "text").select("at", "text")
        hits = self.stages.table(hits.join(texts, "at"), f"hit_texts-{run}")
        first = hits.where("at = keep.at").select("digest", F.col("text").alias("keep_text"))
        checked = self.stages.table(hits.join(first, "digest").select(
            "id", "digest", "at", "keep", "n", (F.col("text") == F.col("keep_text")).alias("same"),
            F.when(F.col("text") != F.col("keep_text"), F.col("text")).alias("text")), f"checked-{run}")
        self.stages.drop(f"hits-{run}", f"hit_texts-{run}")
        same, other = checked.where("same"), checked.where("not same")
        told = alone.unionByName(self._told(same.withColumn("size", F.col("n"))))
        if other.isEmpty():
            return told
        # digests that clash: the texts part their rows
        others = other.groupBy("digest").agg(F.count(F.lit(1)).alias("others"))
        rest = same.join(others, "digest", "left").withColumn("size", F.col("n") - F.coalesce("others", F.lit(0)))
        parts = other.groupBy("digest", "text").agg(F.max(F.struct("id", "at")).alias("keep"), F.count(F.lit(1)).alias("size"))
        apart = other.drop("keep").join(parts, ["digest", "text"])
        return alone.unionByName(self._told(rest)).unionByName(self._told(apart))

    @staticmethod
    def _told(rows: DataFrame) -> DataFrame:
        return rows.select("id", F.col("keep.id").alias("keep_id"), F.col("size").alias("group_size"),
                           (F.col("at") == F.col("keep.at")).alias("kept"), "digest")


def dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2,
          digits: int = 64) -> DataFrame:
    """``(id, keep_id, group_size, kept, digest)`` of every row of the parquet table at ``path``."""
    seen = Deduplicator(spark, path, id_col, text_col, rounds, digits)
    seen.take()
    return seen.result()
