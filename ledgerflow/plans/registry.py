"""Query registry: each entry pairs a Spark plan with its DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.views import Dataset
from .oracle_views import with_views

Builder = Callable[[Dataset], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None          # None: not SQL-expressible, checked against brute force in tests
    doc: str

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The query result as handed to the comparison. Decimal columns (money,
        risk) are presented as DOUBLE, the nearest double of the exact decimal,
        so both engines give identical float64 values; instants are presented as
        TIMESTAMP_NTZ, the type of the tables' own ``ts`` and of DuckDB's TIMESTAMP."""
        df = self.build(Dataset(spark, sf_dir))

        def shown(f: T.StructField):
            if isinstance(f.dataType, T.DecimalType):
                return F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.TimestampType):
                # the views read the naive ``ts`` in the session zone; this is its exact inverse
                return F.col(f.name).cast("timestamp_ntz").alias(f.name)
            return F.col(f.name)

        return df.select(*[shown(f) for f in df.schema.fields])


REGISTRY: dict[str, Query] = {}


def _as_double(sql: str, cols: tuple[str, ...]) -> str:
    if not cols:
        return sql
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({casts}) FROM (\n{sql}\n) AS q"


def query(name: str, sql: str | None = None, decimals: tuple[str, ...] = ()) -> Callable[[Builder], Builder]:
    """Register ``fn(Dataset) -> DataFrame`` under ``name`` with its oracle body.

    ``decimals`` names the DECIMAL output columns; the oracle presents them as
    DOUBLE like ``Query.run`` does.
    """

    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        oracle = _as_double(with_views(sql), decimals) if sql is not None else None
        REGISTRY[name] = Query(name, fn, oracle, (fn.__doc__ or "").strip())
        return fn

    return deco
