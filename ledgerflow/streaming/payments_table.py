"""Payments as base and deltas (K5): updates never rewrite the table.

The base is parquet in hash buckets of the payment id. A batch appends its new payments
and its updates, under the commit log; readers merge them in by key, and only in the
buckets that they touch: all other buckets are plain scans, without a shuffle. Compaction
writes the touched buckets anew as the next generation and then commits a manifest that
tells which generation of each bucket counts, and up to which batch it holds the deltas.
Files are never changed in place, so a reader, or a compaction that fails half-way,
always sees the state of the last committed manifest; untouched buckets keep their files.

The manifest has a row a bucket, and ``buckets`` is a parameter: the driver may read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.process import apply_updates
from .effectively_once import UPDATES, CommitLog

ROWS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.PAYMENTS.fields)


class PaymentsTable:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, log: CommitLog | None = None,
                 manifests: CommitLog | None = None):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.log = log or CommitLog(spark, f"{self.root}/changes")
        self.manifests = manifests or CommitLog(spark, f"{self.root}/manifests")

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("payment_id"), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, generation: int) -> None:
        (rows.repartition("bucket").sortWithinPartitions("bucket", "payment_id").write.mode("overwrite")
         .partitionBy("bucket").parquet(f"{self.root}/base/generation={generation}"))

    def _commit(self, buckets: DataFrame, version: int) -> None:
        self.manifests.write("buckets", buckets.coalesce(1), version)
        self.manifests.commit(version)

    def create(self, payments: DataFrame) -> None:
        """The first generation of every bucket."""
        self._write(self._bucketed(payments.select(*[f.name for f in S.PAYMENTS.fields])), 0)
        self._commit(self.spark.range(self.buckets).select(
            F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("generation"), F.lit(-1).cast("long").alias("upto")), 0)

    def append(self, batch_id: int, updates: DataFrame | None = None, inserts: DataFrame | None = None) -> None:
        """Commit the changes of a batch; a batch that is run again replaces its own."""
        for name, df, schema in (("inserts", inserts, ROWS), ("updates", updates, UPDATES)):
            columns = [c.split()[0] for c in schema.split(", ")]
            df = self.spark.createDataFrame([], schema) if df is None else df.select(*columns)
            self.log.write(name, self._bucketed(df), batch_id)
        self.log.commit(batch_id)

    def manifest(self) -> tuple[int, dict[int, int], int]:
        """Version, generation of each bucket, and the last batch that the base holds."""
        version = self.manifests.last()
        rows = self.manifests.of_batch("buckets", "bucket int, generation long, upto long", version).collect()   # a row a bucket
        return version, {r.bucket: r.generation for r in rows}, rows[0].upto

    def _changes(self, upto: int) -> tuple[DataFrame, DataFrame, list[int]]:
        inserts, updates = (self.log.committed(name, f"{schema}, bucket int").filter(F.col("batch_id") > upto)
                            for name, schema in (("inserts", ROWS), ("updates", UPDATES)))
        touched = inserts.select("bucket").unionAll(updates.select("bucket")).distinct().collect()              # a row a bucket
        return inserts, updates, sorted(r.bucket for r in touched)

    def _base(self, generations: dict[int, int]) -> DataFrame:
        """The buckets' counting generations; partition filters, so no other file is read."""
        base = self.spark.read.schema(f"{ROWS}, generation long, bucket int").parquet(f"{self.root}/base")
        wanted = F.lit(False)
        for g in sorted(set(generations.values())):
            wanted |= (F.col("generation") == g) & F.col("bucket").isin([b for b, own in generations.items() if own == g])
        return base.filter(wanted).drop("generation")

    def _merged(self, generations: dict[int, int], inserts: DataFrame, updates: DataFrame) -> DataFrame:
        rows = self._base(generations).unionByName(inserts.drop("batch_id"))
        columns = [c for c in updates.columns if c not in ("payment_id", "batch_id", "bucket")]
        last = updates.groupBy("payment_id").agg(F.max_by(F.struct(*columns), F.struct("updated_at", "batch_id")).alias("u"))
        return apply_updates(rows, last.select("payment_id", "u.*"))

    def read(self) -> DataFrame:
        """The payments with every committed change."""
        _, generations, upto = self.manifest()
        inserts, updates, touched = self._changes(upto)
        plain = self._base({b: g for b, g in generations.items() if b not in touched})
        if touched:
            plain = plain.unionByName(self._merged({b: generations[b] for b in touched}, inserts, updates))
        return plain.drop("bucket")

    def compact(self) -> list[int]:
        """Fold the committed changes into the base; returns the buckets that were written anew."""
        version, generations, upto = self.manifest()
        inserts, updates, touched = self._changes(upto)
        if touched:
            last = self.log.last()
            self._write(self._merged({b: generations[b] for b in touched}, inserts, updates), version + 1)
            rows = [(b, version + 1 if b in touched else g, last) for b, g in sorted(generations.items())]
            self._commit(self.spark.createDataFrame(rows, "bucket int, generation long, upto long"), version + 1)
        return touched

    def vacuum(self) -> None:
        """Delete the files that the last manifest no longer counts; no reader may still use an older one."""
        _, generations, upto = self.manifest()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()

        def folders(path: str) -> list[tuple[str, str]]:
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            fs = hadoop.getFileSystem(conf)
            return [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(hadoop) if s.isDirectory()] if fs.exists(hadoop) else []

        def delete(path: str) -> None:
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(conf).delete(hadoop, True)

        for generation, folder in folders(f"{self.root}/base"):
            for bucket, path in folders(folder):
                if str(generations[int(bucket.split("=")[1])]) != generation.split("=")[1]:
                    delete(path)
        for name in ("inserts", "updates"):
            for batch, path in folders(f"{self.log.root}/{name}"):
                if int(batch.split("=")[1]) <= upto:
                    delete(path)
