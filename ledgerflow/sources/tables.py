"""Table scans with declared schemas (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import schemas

TABLE_SCHEMAS: dict[str, T.StructType] = {
    "events": schemas.EVENTS,
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a dataset folder.

    A declared schema is used where one exists, so the scan never infers types
    and the column list reaches the parquet reader for pruning.
    """
    reader = spark.read
    schema = TABLE_SCHEMAS.get(name)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_payments(spark: SparkSession, path: str) -> DataFrame:
    """Scan a stored ``payments`` table (system of record) with its declared schema."""
    return spark.read.schema(schemas.PAYMENTS).parquet(path)


def read_payments_jdbc(spark: SparkSession, url: str, table: str = "payments", partitions: int = 64,
                       **options: str) -> DataFrame:
    """S3 from a relational system of record. Rows are read in ``partitions``
    parallel ranges of the creation time (``partitionColumn``), then cast to the
    declared schema. Needs the database's JDBC driver on the classpath."""
    bounds = (spark.read.format("jdbc").option("url", url)
              .option("query", f"SELECT MIN(created_at) AS lo, MAX(created_at) AS hi FROM {table}")
              .options(**options).load().first())
    reader = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
              .option("partitionColumn", "created_at").option("lowerBound", str(bounds["lo"]))
              .option("upperBound", str(bounds["hi"])).option("numPartitions", partitions)
              .options(**options))
    df = reader.load()
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schemas.PAYMENTS.fields])
