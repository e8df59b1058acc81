"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the mix by its weight, but no more than
``max_epochs`` times its own words; what is clamped off is shared again by
weight among the others until no target is above its cap. A source's target is
met by whole repetitions of all its documents and a seeded draw of some of them
once more. The draw orders a source's documents by a hash cell and takes cells
from the lowest up while that brings the words nearer to the target. The cut is
found from word sums by cell, in two levels, so that no source is ever sorted
or gathered in one task.

A null source is a source of its own, the last in order; null texts have no
words; a source without words has target 0. Rows repeated with the same id and
text are drawn together. An empty table gives an empty table. Extra columns
don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages, named, words_in

CELL_BITS = 12                       # cells: two levels of this many bits


def source_key(source: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def cell(seed: int, doc_id: Column, text: Column) -> Column:
    """Seeded hash cell of a document."""
    said = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")),
                       F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(said), 1, 2 * CELL_BITS // 4), 16, 10).cast("long")


def in_order(sources: DataFrame, stages: Stages) -> DataFrame:
    """``position`` (from 0) of each source by code point, null last: a range
    partitioning numbers its rows by partition, and partitions are offset by the
    rows before them."""
    order = F.col("source").asc_nulls_last()
    parts = stages.table(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # a row a partition
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return (parts.withColumn("own", own).join(offsets, "part")
            .withColumn("position", F.col("own") + F.col("offset")).drop("part", "own", "offset"))


def targets(sizes: DataFrame, stages: Stages, share: float, max_epochs: float, weights: tuple[int, ...]) -> DataFrame:
    """``(key, source_size, target)`` of each source from ``(key, source, size)`` of documents."""
    sources = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    sources = stages.table(in_order(sources, stages)
                           .select("key", "source_size", weight.cast("double").alias("weight"),
                                   (F.col("source_size") * F.lit(float(max_epochs))).alias("cap")), "weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = None                     # words a unit of weight
    while True:
        over = F.lit(False) if level is None else F.col("cap") < F.col("weight") * F.lit(level)
        clamped, weight_left = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if not weight_left or level == (level := (share * total - clamped) / weight_left):
            break
    if level is None:
        level = 0.0
    target = F.when(F.col("cap") < F.col("weight") * F.lit(level), F.col("cap")).otherwise(F.col("weight") * level)
    return sources.select("key", "source_size", target.alias("target"))


def cuts(sizes: DataFrame, goals: DataFrame, stages: Stages) -> DataFrame:
    """``(key, source_size, target, whole, cut)``: all documents ``whole`` times, and those
    of cells below ``cut`` once more."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = goals.withColumn("whole", whole.cast("long")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size"))
    high = F.shiftright("cell", CELL_BITS)
    upto = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    coarse = (sizes.groupBy("key", high.alias("at")).agg(F.sum("size").alias("n"))
              .withColumn("upto", F.sum("n").over(upto)).join(goals, "key")
              .where((F.col("rest") > 0) & (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
              .select("key", F.col("at").alias("edge"), (F.col("upto") - F.col("n")).alias("below"), "rest"))
    coarse = stages.table(coarse, "edges")
    fine = (sizes.withColumn("edge", high).join(coarse, ["key", "edge"])
            .groupBy("key", "below", "rest", F.col("cell").alias("at")).agg(F.sum("size").alias("n"))
            .withColumn("upto", F.col("below") + F.sum("n").over(upto)))
    nearer = (F.col("upto") <= F.col("rest")) | ((F.col("upto") - F.col("n") < F.col("rest"))
                                                 & (F.col("upto") - F.col("rest") < F.col("rest") - F.col("upto") + F.col("n")))
    inner = fine.groupBy("key").agg(F.max(F.when(nearer, F.col("at") + 1)).alias("last"))
    edge = coarse.select("key", F.shiftleft("edge", CELL_BITS).alias("start")).join(inner, "key", "left")
    cut = (F.when(F.col("rest") <= 0, F.lit(0))
           .when(F.col("start").isNull(), F.lit(1 << 2 * CELL_BITS))               # no cell reaches the target
           .otherwise(F.coalesce("last", "start")))
    return goals.join(edge, "key", "left").select("key", "source_size", "target", "whole", cut.cast("long").alias("cut"))


def mix(df: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = (3, 1, 2),
        seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """Returns ``(rows, plan)``. ``rows``: id, size, source_size, target, copies and taken of
    every row, without its text. ``plan``: the sources' repetitions, for ``repeat``."""
    stages = Stages(df.sparkSession, "mix")
    text = named(text_col).cast("string")
    sizes = stages.table(df.select(named(id_col).alias("id"), named(source_col).cast("string").alias("source"),
                                   source_key(named(source_col)).alias("key"), words_in(text).alias("size"),
                                   cell(seed, named(id_col), text).alias("cell")), "sizes")
    plan = stages.table(cuts(sizes, targets(sizes, stages, share, max_epochs, weights), stages), "plan")
    copies = (F.col("whole") + (F.col("cell") < F.col("cut")).cast("long")).alias("copies")
    rows = (sizes.join(plan, "key").select("id", "size", "source_size", "target", copies)
            .withColumn("taken", F.col("size") * F.col("copies")).withColumnRenamed("id", id_col))
    return rows, plan


def repeat(df: DataFrame, plan: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``df`` as often as ``plan`` takes it, with its own columns."""
    row = F.struct(*map(named, df.columns))
    keyed = df.select(row.alias("row"), source_key(named(source_col)).alias("key"),
                      cell(seed, named(id_col), named(text_col).cast("string")).alias("cell"))
    copies = F.col("whole") + (F.col("cell") < F.col("cut")).cast("long")
    times = keyed.join(plan.select("key", "whole", "cut"), "key").select("row", copies.cast("int").alias("copies"))
    return (times.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")))
            .select(*[F.col("row").getField(c).alias(c) for c in df.columns]))
