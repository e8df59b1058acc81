"""Centroid clustering of integer vectors in JVM-native expressions.

Vectors are turned into integers once. A round is one pass over them: ``zip_with``
and ``aggregate`` give the squared distance to each literal centroid, ``array_min``
of (distance, number) structs chooses the cluster, and sums of the components per
cluster, partly summed up before the shuffle, give the next centroids. Only the
centroids pass through the driver: ``k`` rows of ``dims`` numbers, both parameters.

A vector takes part if it has exactly ``dims`` components, none of them null, NaN,
infinite or, times ``scale``, beyond 2**58; all others have no row in the result.
Arithmetic is exact: in 64 bits where no component passes 2**27, else in decimals
(a distance beyond 64 bits is then null). Every row that takes part has its own row
in the result, repeated ids and vectors too. A null id sorts last among the seeds.
With fewer vectors than ``k`` there are fewer centroids; an empty table gives an
empty result. Extra columns, whatever their names, are left behind.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, named

#: Components up to this size keep squared distances of 64 of them within 64 bits.
LONG_BOUND = 1 << 27
BOUND = 1 << 58


def integer_vectors(df: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)``: the vectors that take part, with components ``floor(scale * x)`` as longs."""
    scaled = F.transform(named(vector_col).cast("array<double>"), lambda x: x * float(scale))
    rows = df.select(named(id_col).cast("long").alias("id"), scaled.alias("x"))
    fits = F.forall("x", lambda x: x.isNotNull() & (F.abs(x) <= float(BOUND)))       # NaN is above all numbers
    return rows.where((F.size("x") == dims) & fits).select("id", F.transform("x", lambda x: F.floor(x)).alias("v"))


def nearest_centroid(v: Column, centroids: list[list[int]], kind: str) -> Column:
    """Struct of the least ``distance`` and the ``cluster`` that has it, the smaller number of equals."""
    def to(n: int, centroid: list[int]) -> Column:
        parts = F.zip_with(v.cast(f"array<{kind}>"), F.lit(centroid).cast(f"array<{kind}>"), lambda x, c: (x - c) * (x - c))
        distance = F.aggregate(parts, F.lit(0).cast(kind), lambda total, d: (total + d).cast(kind))
        return F.struct(distance.alias("distance"), F.lit(n).alias("cluster"))

    return F.array_min(F.array(*[to(n, c) for n, c in enumerate(centroids)]))


def seeds(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``salt`` and id, in that order."""
    key = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    return [list(r.v) for r in vectors.select("v", key.alias("key")).orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()]


def moved(vectors: DataFrame, centroids: list[list[int]], kind: str) -> list[list[int]]:
    """Floors of the componentwise means of each centroid's vectors; one without vectors stays."""
    best = vectors.select("v", nearest_centroid(F.col("v"), centroids, kind).alias("best"))
    sums = [F.sum(F.col("v")[i].cast(kind)) for i in range(len(centroids[0]))]
    rows = best.groupBy(F.col("best.cluster").alias("cluster")).agg(F.count(F.lit(1)), *sums).collect()   # k rows at most
    out = list(centroids)
    for cluster, count, *totals in rows:
        out[cluster] = [int(t) // count for t in totals]
    return out


def cluster(df: DataFrame, k: int = 40, dims: int = 64, rounds: int = 5, scale: int = 256, salt: str = "2:",
            id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector, and the centroids."""
    spark, stages = df.sparkSession, Stages(df.sparkSession, "centroids")
    vectors = stages.table(integer_vectors(df, dims, scale, id_col, vector_col), "vectors")
    largest = vectors.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()[0]
    kind = "bigint" if (largest or 0) <= LONG_BOUND else "decimal(38,0)"
    centroids = seeds(vectors, k, salt)
    if not centroids:
        return vectors.selectExpr(f"id as `{id_col}`", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia",
                                  "'' as centroid_sha256"), []
    for _ in range(rounds):
        centroids = moved(vectors, centroids, kind)
    best = vectors.select("id", nearest_centroid(F.col("v"), centroids, kind).alias("best"))
    placed = stages.table(best.select("id", "best.cluster", "best.distance"), "placed")
    inertia = {r[0]: int(r[1]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    stages.drop("vectors")
    about = [(n, str(inertia.get(n, 0)), str(sum(inertia.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
             for n, c in enumerate(centroids)]
    facts = spark.createDataFrame(about, "cluster int, cluster_inertia string, inertia string, centroid_sha256 string")
    out = placed.join(F.broadcast(facts), "cluster").select(                        # k rows
        F.col("id").alias(id_col), "cluster", F.col("distance").try_cast("long").alias("distance"),
        F.col("cluster_inertia").try_cast("long").alias("cluster_inertia"), F.col("inertia").try_cast("long").alias("inertia"),
        "centroid_sha256")
    return out, centroids
