"""Connected components by alternating large-star and small-star steps.

Distributed union-find: every step relinks the neighbours of each node to the
smallest node among them, in joins and aggregations keyed by node, until the
links form stars around each component's smallest node. Links are written to
the shared folder after every round. A node with a third of all links is summed
up before the shuffle, and its rows are split in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages


def components(edges: DataFrame, stages: Stages, name: str = "links") -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` (longs) that is linked to a
    smaller one; ``root`` is the smallest node of its component. Nodes that are
    roots themselves have no row. Nulls, loops and repeated links don't matter."""
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")) \
        .where("a is not null and b is not null and a != b").distinct()
    links = stages.table(links, f"{name}-0")
    seen, turn = state(links), 0
    while seen[0]:
        turn += 1
        links = stages.table(small_star(large_star(links)), f"{name}-{turn}")
        stages.drop(f"{name}-{turn - 1}")
        before, seen = seen, state(links)
        if before == seen:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def large_star(links: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to its smallest neighbour (or itself)."""
    both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(links.select("v", "u"))
    least = both.groupBy("x").agg(F.min("y").alias("m"))
    return (both.where("y > x").join(least, "x")
            .select(F.col("y").alias("u"), F.least("x", "m").alias("v")).distinct())


def small_star(links: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
