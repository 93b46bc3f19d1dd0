"""Utilities on messages (qid, id, w)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def numbered(rows: DataFrame, name: str, *by: str, within: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """``rows`` with numbers from 0 without gaps, in the order of a seeded hash
    of the columns ``by``, which tell rows apart; ``within`` starts anew.

    Rows are ranked in buckets of the hash, many of them, and each bucket
    starts where those before it end; so no task sorts more than a bucket.
    """
    h = F.xxhash64(F.lit(seed), *within, *by)
    rows = rows.withColumn("_hash", h).withColumn("_bucket", F.shiftright("_hash", 50))
    counts = rows.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))  # 16,384 rows for each start at most
    before = F.sum("_n").over(Window.partitionBy(*within, F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*within, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy("_hash", *by))
    ranked = rows.withColumn("_rank", rank).join(counts, [*within, "_bucket"])
    return ranked.withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_hash", "_bucket", "_rank", "_before")


def map_weights(message: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return message.withColumn("w", f(F.col("w")))


def altered(message: DataFrame, f: Callable[[Column, WindowSpec], Column]) -> DataFrame:
    """Each query's row changed as a whole: ``f`` gets the weight and the row as
    a window, as in ``lambda w, row: w / F.sum(w).over(row)``."""
    return message.withColumn("w", f(F.col("w"), Window.partitionBy("qid")))


def row_sum(message: DataFrame) -> DataFrame:
    """(qid, w): totals by query."""
    return message.groupBy("qid").agg(F.sum("w").alias("w"))


def column_mean(message: DataFrame, queries: int) -> DataFrame:
    """(id, w): means over all queries, also those without the symbol."""
    return message.groupBy("id").agg((F.sum("w") / queries).alias("w"))


def column_sum(message: DataFrame) -> DataFrame:
    return message.groupBy("id").agg(F.sum("w").alias("w"))


def repeat(message: DataFrame, n: int) -> DataFrame:
    """A message without query for each of n queries."""
    return message.withColumn("qid", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.col("qid").cast("long").alias("qid"), "id", "w")


def stack(messages: list[DataFrame]) -> DataFrame:
    """Queries of several messages one after another, as (qid, id, w); a query
    keeps its number plus that of the queries before it."""
    out, before = [], 0
    for m in messages:
        out.append(m.select((F.col("qid") + before).alias("qid"), "id", "w"))
        before += (m.agg(F.max("qid")).first()[0] or 0) + 1
    return reduce(DataFrame.unionByName, out)


def shuffled(message: DataFrame, seed: int = 0) -> DataFrame:
    """Queries renumbered in the order of a seeded hash."""
    order = numbered(message.select("qid").distinct(), "new", "qid", seed=seed)
    return message.join(order, "qid").select(F.col("new").alias("qid"), "id", "w")


def selected(message: DataFrame, low: int, high: int) -> DataFrame:
    """Queries low to high, high excluded, numbered from 0."""
    return message.filter((F.col("qid") >= low) & (F.col("qid") < high)).withColumn("qid", F.col("qid") - low)


def columns(message: DataFrame) -> DataFrame:
    """(id, entries, total, largest): what stands in each symbol's column."""
    return message.groupBy("id").agg(F.count(F.lit(1)).alias("entries"), F.sum("w").alias("total"), F.max("w").alias("largest"))


def summary(message: DataFrame) -> DataFrame:
    """(queries, symbols, entries, largest)."""
    return message.agg(F.countDistinct("qid").alias("queries"), F.countDistinct("id").alias("symbols"), F.count(F.lit(1)).alias("entries"), F.max("w").alias("largest"))
