"""URL filters by a sort-merge range join.

A host is canonical as its labels in reverse, each followed by a dot
(``www.example.net`` -> ``net.example.www.``), so a rule's host and all its
subdomains are one interval of keys. URLs and rules are range partitioned and
sorted together; a sweep over a partition keeps a stack of the rules whose
intervals enclose the present key, nested from outside in, and a URL is judged
by the longest rule on the stack whose path begins the URL's path. A partition
also gets the rules that began before it and still enclose its first key. The
range partitioning goes on by path and id, so a host with a third of all URLs
spreads over many partitions.

The host of a URL is what stands between the first ``://`` and the next ``/``,
``?``, ``#`` or the end, with A-Z lower-cased; the path goes on up to ``?``,
``#`` or the end. A null URL or one without ``://`` has neither and fits no
rule. Of rules of equal length the one with the longer host wins, of the same
rule with both verdicts ``block``. Repeated rows are judged alike; empty tables
of URLs or of rules are fine; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, named

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE, URL = 0, 1
OUT = "id long, host string, path string, rule string, verdict string"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Judge the URLs of sorted rows ``(part, key, kind, path, id, host, verdict)``."""
    names = [f.split()[0] for f in OUT.split(", ")]
    types = [pa.int64()] + [pa.string()] * 4
    part, stack = None, []           # stack of (key, {path: (host + path, verdict)}, lengths of the paths)
    for batch in batches:
        out: list[tuple] = []
        for p, key, kind, path, doc, host, verdict in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == RULE:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                _, paths, lengths = stack[-1]
                if paths.get(path, ("", ""))[1] != "block":
                    paths[path] = (host + path, verdict)
                if len(path) not in lengths:
                    lengths.append(len(path))
                    lengths.sort(reverse=True)
                continue
            best = None
            for at, paths, lengths in stack:
                hit = next((paths[path[:n]] for n in lengths if n <= len(path) and path[:n] in paths), None)
                if hit and (best is None or len(hit[0]) >= len(best[0])):    # inner hosts are longer
                    best = hit
            out.append((doc, host, path, best and best[0], best[1] if best else default))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def judge_urls(df: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every row of ``df`` under ``rules(host, path,
    verdict)``; ``rule`` is null where none fits."""
    stages = Stages(df.sparkSession, "url")
    host, path = host_path(named(url_col).cast("string"))
    urls = df.select(host.alias("host"), path.alias("path"), named(id_col).cast("long").alias("id"))
    urls = urls.select(host_key(F.col("host")).alias("key"), F.lit(URL).alias("kind"), "path", "id", "host",
                       F.lit(None).cast("string").alias("verdict"))
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
                         "verdict").where(F.col("host").isNotNull())
    rules = rules.select(host_key(F.col("host")).alias("key"), F.lit(RULE).alias("kind"), "path",
                         F.lit(None).cast("long").alias("id"), "host", "verdict")
    order = ["key", "kind", "path", "id"]
    both = stages.table(urls.unionByName(rules).repartitionByRange(*order)
                        .withColumn("part", F.spark_partition_id()), "ranges")
    # rules that began in an earlier partition: those whose key begins the partition's first key
    first = both.groupBy("part").agg(F.min("key").alias("first"))
    labels = F.split(F.col("first"), r"\.", -1)
    begins = first.select("part", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1),
        lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("key"))
    carried = both.where(F.col("kind") == RULE).drop("part").join(begins, "key")
    columns = ["part", "key", "kind", "path", "id", "host", "verdict"]
    sorted_rows = (both.unionByName(carried).select(*columns).repartition("part")
                   .sortWithinPartitions("part", *order))
    judged = sorted_rows.mapInArrow(lambda batches: sweep(batches, default), OUT)
    return judged.withColumnRenamed("id", id_col)
