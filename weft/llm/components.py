"""Connected components of an edge table, by alternating large and small stars.

Each step joins a node's neighbours with their least neighbour, so long chains
shrink by halves; every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.shared import hot_keys, keyed_join, remove, staged


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    # the centre of a large star has as many edges as its component has nodes
    met = keyed_join(both.filter("v > u"), least, ["u"], hot_keys(least, ["u"]))
    return met.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = keyed_join(edges, least, ["u"], hot_keys(least, ["u"])).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of all nodes that stand in an edge; a component is
    its least node.  Loops and repeated edges don't matter; null ends are dropped."""
    spark = edges.sparkSession
    now = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} is not null and {b} is not null and u <> v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        last, now = now, staged(_small_star(staged(_large_star(now), "star")), "edges")
        before, mark = mark, _mark(now)
        remove(spark, last.staged_at)
        if mark == before:
            break
    # now each node points to its component's least node
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    out.staged_at = now.staged_at
    return out
