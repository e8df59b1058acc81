"""Run a registered query against its DuckDB oracle and compare results."""

from __future__ import annotations

import math
from decimal import Decimal

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    """A canonical text for one value, equal across engines for equal values."""
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, Decimal):
        return format(v.normalize(), "f")
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def sql_type(dt) -> str:
    """The DuckDB type name a Spark output type must meet."""
    from pyspark.sql import types as T

    names = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE",
             T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN", T.TimestampType: "TIMESTAMP",
             T.TimestampNTZType: "TIMESTAMP"}
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    return names.get(type(dt), dt.simpleString())


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    """(equal, message) for a Spark DataFrame against the oracle SQL: same column
    names and types, same rows in any order."""
    rows = spark_df.collect()
    cols = spark_df.columns
    rel = con.sql(sql)
    ocols, otypes = rel.columns, [str(t) for t in rel.types]
    orows = rel.fetchall()
    if sorted(cols) != sorted(ocols):
        return False, f"columns {sorted(cols)} != {sorted(ocols)}"
    stypes = {f.name: sql_type(f.dataType) for f in spark_df.schema.fields}
    wrong = {c: (stypes[c], t) for c, t in zip(ocols, otypes) if stypes[c] != t}
    if wrong:
        return False, f"types differ (spark, oracle): {wrong}"
    key = sorted(cols)
    a = sorted(tuple(norm(r[c]) for c in key) for r in rows)
    idx = {c: i for i, c in enumerate(ocols)}
    b = sorted(tuple(norm(r[idx[c]]) for c in key) for r in orows)
    if a == b:
        return True, f"{len(a)} rows"
    only_a = sorted(set(a) - set(b))[:2]
    only_b = sorted(set(b) - set(a))[:2]
    return False, f"spark {len(a)} rows, oracle {len(b)} rows; spark only {only_a}; oracle only {only_b}"
