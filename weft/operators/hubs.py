"""Joins in which symbols with very many rows are split.

A step brings a message's rows and a relation's facts together by symbol.  All
rows of a symbol meet in one task, however many there are; a symbol with more
than ``hub_rows`` of them on a side is a hub.  A hub's rows are cut into parts
on each side, by a hash of what else they hold, and each part of the one meets
each of the other in a place of its own.  Sums are taken within the places
first, as partial sums are.  All other symbols meet as ever, in the same join.

Hubs are told by the hash of the symbol, so that their table has a fixed size
(HUBS rows of three numbers); two symbols with one hash are split alike.
Estimates of rows decide how finely a hub is cut, never what is joined.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one symbol from which on it is split.
HUB_ROWS = 1_000_000
#: A symbol with under a share of one in so many of the rows is no hub: there are at most so many hubs.
HUBS = 10_000
#: A fact takes up at least so many bytes; a relation whose plan promises less than a hub's bytes isn't looked at.
FACT_BYTES = 4
#: Buckets of hashes that a column's rows are counted in first: a hub's bucket has at least the hub's rows.
BUCKETS = 1 << 16

#: Rows by hash of a symbol.
Rows = dict[int, float]


def promised_bytes(rows: DataFrame) -> int:
    """A plan's estimated bytes."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def may_have_hubs(rows: DataFrame, hub_rows: int) -> bool:
    """Whether a plan's estimated bytes leave room for one hub."""
    return promised_bytes(rows) >= FACT_BYTES * hub_rows


def _bucket(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def full_buckets(rows: DataFrame, columns: list[str], hub_rows: int) -> dict[str, list[int]]:
    """For each column the buckets with over ``hub_rows`` rows."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), _bucket(c).alias("b")) for i, c in enumerate(columns)))).alias("e")
    counted = rows.select(each).groupBy("e.c", "e.b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hub_rows)
    out: dict[str, list[int]] = {c: [] for c in columns}
    for r in counted.collect():
        out[columns[r.c]].append(r.b)
    return out


def hubs_at(rows: DataFrame, columns: list[str], hub_rows: int) -> dict[str, Rows]:
    """For each column the symbols with over ``hub_rows`` rows, and over one in
    HUBS of all.  Rows are first counted in buckets, in one job that reads them
    once and shuffles at most BUCKETS numbers a task and column; only rows of
    buckets with over ``hub_rows`` of them are counted by symbol, of which at
    most HUBS numbers a column come back, and a count of all where there are any."""
    out: dict[str, Rows] = {c: {} for c in columns}
    if not may_have_hubs(rows, hub_rows):
        return out
    full = full_buckets(rows, columns, hub_rows)
    if not any(full.values()):
        return out
    many = None
    for c in columns:
        if not full[c]:
            continue
        buckets = F.broadcast(rows.sparkSession.createDataFrame([(b,) for b in full[c]], "hub_bucket int"))
        looked = rows.withColumn("hub_bucket", _bucket(c)).join(buckets, "hub_bucket", "left_semi")
        n = looked.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hub_rows)
        n = n.select(F.lit(c).alias("c"), F.xxhash64("id").alias("h"), "n").orderBy(F.col("n").desc()).limit(HUBS)
        many = n if many is None else many.union(n)
    found = many.collect()
    total = rows.count() if found else 0  # most relations have none, and are counted once
    for r in found:
        if r.n * HUBS > total:
            out[r.c][r.h] = max(out[r.c].get(r.h, 0.0), float(r.n))
    return out


def met(left: DataFrame, right: DataFrame, on: str, left_rows: Rows, right_rows: Rows, hub_rows: int, tasks: int | None = None) -> DataFrame:
    """``left.join(right, on)``, with hubs of either side split; in a given
    number of ``tasks`` where the rows shuffled don't tell how many the join makes."""

    def joined(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
        return a.join(b, by) if tasks is None else a.repartition(tasks, *by).join(b.repartition(tasks, *by), by)

    parts = {h: (math.ceil(left_rows.get(h, 1.0) / hub_rows), math.ceil(right_rows.get(h, 1.0) / hub_rows)) for h in {*left_rows, *right_rows}}
    parts = {h: p for h, p in parts.items() if p != (1, 1)}
    if not parts:
        return joined(left, right, [on])
    table = F.broadcast(left.sparkSession.createDataFrame([(h, a, b) for h, (a, b) in parts.items()], "hub_hash long, hub_left long, hub_right long"))

    def placed(side: DataFrame, own: str, other: str, place) -> DataFrame:
        """Each row once for each part of the other side."""
        rest = [c for c in side.columns if c != on]
        found = side.withColumn("hub_hash", F.xxhash64(on)).join(table, "hub_hash", "left")
        part = F.pmod(F.xxhash64(*rest, F.lit(7)), F.col(own))
        places = F.when(F.col(own).isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col(other) - 1), lambda k: place(part, k)))
        return found.select(on, *rest, F.explode(places).alias("hub_place"))

    a = placed(left, "hub_left", "hub_right", lambda own, k: own * F.col("hub_right") + k)
    b = placed(right, "hub_right", "hub_left", lambda own, k: k * F.col("hub_right") + own)
    return joined(a, b, [on, "hub_place"]).drop("hub_place")
