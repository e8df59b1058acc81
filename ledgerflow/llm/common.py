"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scoped_conf

#: White space of the word rules: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: A vocabulary file that is broadcast may have this many bytes at most.
MAX_VOCABULARY_BYTES = 64 << 20


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)`` of every row; a null text counts as empty. Other columns,
    whatever their names, are left behind."""
    return df.select(named(id_col).cast("long").alias("id"),
                     F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))


def words_in(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read_vocabulary(path: str) -> bytes:
    """A vocabulary file, whose size is checked first."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return data


def broadcast_file(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_vocabulary(path))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, names: list[str],
                types: list[pa.DataType], setup: Callable[[], Callable] | None = None) -> DataFrame:
    """``mapInArrow`` with one output batch per input batch: ``fn(batch)`` (or the
    function that ``setup()`` makes once a task) gives the output columns by name."""
    out = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = setup() if setup else fn
        for batch in batches:
            if batch.num_rows:
                cols = each(batch)
                yield pa.RecordBatch.from_arrays([pa.array(cols[n], t) if not isinstance(cols[n], pa.Array)
                                                  else cols[n] for n, t in zip(names, types)], schema=out)

    return df.mapInArrow(run, schema)


class Stages:
    """Intermediate tables under the shared checkpoint folder.

    Each table cuts the lineage, so that a lost executor costs one stage. The
    shuffle files of a finished stage are dropped (its table is all that later
    ones read), and ``drop`` removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
            import tempfile
            root = tempfile.mkdtemp(prefix="stages-")     # a local session without the setting: tests
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.made: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        self.made.append(name)
        with scoped_conf(self.spark, **{"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Remove all tables but these."""
        self.drop(*[n for n in self.made if n not in names])
        self.made = [n for n in self.made if n in names]

    @contextmanager
    def step(self, *names: str):
        yield self
        self.drop(*names)
