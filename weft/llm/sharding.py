"""Sharding by sampled splitters.

Records are ordered by a hash of their text, so equal texts are neighbours.  A
size-weighted sample of keys gives quantile boundaries that cut the order into
many more ranges than shards; ranges that turn out overfull are subdivided.
What is left over is one key with many records: it stays together while it
fits, and is dealt in parts when it is larger than a shard.  Ranges and keys
are then put into shards so that the shards' bytes come out near equal.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.shared import own_names, staged

#: Bytes that a record takes besides its text.
OVERHEAD = 16
#: Keys in the sample, and ranges for each shard.
SAMPLE_KEYS, RANGES_A_SHARD = 100_000, 128
#: Ranges with over so many times the mean range's bytes are subdivided.
OVERFULL = 4.0
#: Records that one task numbers.
ROWS_A_PART = 4096
#: How far above the mean shard whole groups may fill one.
SLACK = 1.005


def sized_records(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, size, text_crc32, key): the key orders records, equal texts alike."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))


def sample_keys(records: DataFrame, total: int, most: int) -> np.ndarray:
    """A sorted, size-weighted sample of about ``most`` keys, with repeats.

    A record is drawn ``most * size / total`` times on average: the whole part
    for sure, the fraction by a hash of the record.
    """
    expected = F.col("size") * (most / max(1, total))
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit("splitter"), F.col("key"), F.col("doc_id")), 11) / float(1 << 53)
    times = F.floor(expected) + (drawn < expected - F.floor(expected)).cast("long")
    rows = records.select("key", times.alias("times")).filter("times > 0").groupBy("key").agg(F.sum("times").alias("times")).toPandas().sort_values("key")
    return np.repeat(rows.key.to_numpy(np.int64), rows.times.to_numpy(np.int64))


def quantile_bounds(sample: np.ndarray, ranges: int) -> np.ndarray:
    """Lower bounds of ranges with equal shares of the sample; a key that
    fills a share alone gets a range of its own."""
    if not len(sample):
        return np.zeros(0, np.int64)
    cuts = sample[(np.arange(1, max(2, ranges)) * len(sample)) // max(2, ranges)]
    keys, times = np.unique(cuts, return_counts=True)
    heavy = keys[times > 1]
    return np.unique(np.concatenate([keys, heavy, heavy[heavy < np.iinfo(np.int64).max] + 1]))


def in_range(records: DataFrame, bounds: np.ndarray) -> DataFrame:
    """With ``range``, the number of bounds up to the key."""

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), "right").astype(np.int32))

    return records.withColumn("range", place("key"))


def splitters(records: DataFrame, shards: int) -> tuple[np.ndarray, pd.DataFrame]:
    """(bounds, bytes, records and whether there is one key only, by range).

    Overfull ranges with more than one key are sampled again, more densely,
    and cut at the quantiles of that sample and halfway between their least and
    greatest key, until none is left; so at most 64 rounds.
    """
    total = int(records.agg(F.sum("size")).first()[0] or 0)
    ranges = shards * RANGES_A_SHARD
    bounds = quantile_bounds(sample_keys(records, total, SAMPLE_KEYS), ranges)
    while True:
        placed = in_range(records, bounds)
        found = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most"), (F.min("key") == F.max("key")).alias("one_key")).toPandas().set_index("range").sort_index()
        over = found[(found.bytes > OVERFULL * total / ranges) & ~found.one_key]
        if over.empty:
            break
        inside = placed.join(F.broadcast(records.sparkSession.createDataFrame([(int(r),) for r in over.index], "range int")), "range").select(*records.columns)
        denser = int(over.bytes.sum())
        parts = max(2, int(np.ceil(2 * denser / (total / ranges))))
        halves = np.array([(int(a) + int(b)) // 2 + 1 for a, b in zip(over.least, over.most)], np.int64)  # above the least, up to the greatest
        bounds = np.unique(np.concatenate([bounds, halves, quantile_bounds(sample_keys(inside, denser, max(SAMPLE_KEYS // 4, 16 * parts)), parts)]))
    return bounds, found


def assign(found: pd.DataFrame, split: dict[int, np.ndarray], shards: int) -> dict[tuple[int, int], int]:
    """Shard of each (range, part); part -1 stands for the whole range.

    ``split`` has the bytes of the parts of keys that don't fit a shard.
    Groups that are larger than a range are placed first, the largest on the
    emptiest shard; the rest follows in order of keys and fills the shards up.
    """
    mean = found.bytes.sum() / shards
    load = [(0.0, s) for s in range(shards)]
    out: dict[tuple[int, int], int] = {}
    large = found[(found.bytes > mean / RANGES_A_SHARD * OVERFULL) & ~found.index.isin(list(split))]
    for r, b in large.bytes.sort_values(ascending=False, kind="stable").items():
        at, s = heapq.heappop(load)
        out[(int(r), -1)] = s
        heapq.heappush(load, (at + b, s))
    used = np.zeros(shards)
    for at, s in load:
        used[s] = at
    rest: list[tuple[int, int, float]] = []
    for r, b in found.bytes.items():
        if r in split:
            rest += [(int(r), i, float(x)) for i, x in enumerate(split[r])]
        elif (int(r), -1) not in out:
            rest.append((int(r), -1, float(b)))
    room = np.maximum(0.0, mean - used)
    ends = np.cumsum(room) * (sum(x[2] for x in rest) / max(1e-9, room.sum()))
    upto = 0.0
    for r, part, b in rest:
        s = int(np.searchsorted(ends, upto + b / 2, "right"))
        out[(r, part)] = min(s, shards - 1)
        upto += b
    return out


def too_large(found: pd.DataFrame, shards: int) -> list[int]:
    """Ranges that can't stay whole without overfilling a shard."""
    mean = found.bytes.sum() / shards
    load, out = [0.0] * shards, []
    for r, b in found.bytes[found.bytes > mean / RANGES_A_SHARD * OVERFULL].sort_values(ascending=False, kind="stable").items():
        at = heapq.heappop(load)
        if at + b > SLACK * mean:
            out.append(int(r))
            b = 0.0
        heapq.heappush(load, at + b)
    return out


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: shards' sizes come out near equal, by more than that
    only where one record is larger than its share.  Equal texts share a shard
    while their group fits one.  Slots number a shard's records from 0 without
    gaps, in the order of (range, part, key, id).  Null text has no bytes; null
    ids come first.  An empty table gives an empty result; other columns are
    not read.
    """
    records = staged(sized_records(docs, id_col, text_col), "records")
    bounds, found = splitters(records, shards)
    n_ranges = len(bounds) + 1
    mean = found.bytes.sum() / shards
    parts = np.ones(n_ranges, np.int64)
    parts[found.index] = -(-found.n // ROWS_A_PART)
    whole_not = too_large(found, shards)
    for r in whole_not:
        parts[r] = max(parts[r], int(np.ceil(found.bytes[r] / (mean / RANGES_A_SHARD))))

    @F.pandas_udf("int")
    def part_of(rng: pd.Series, draw: pd.Series) -> pd.Series:
        return pd.Series((draw.to_numpy().astype(np.uint64) % parts[rng.to_numpy()].astype(np.uint64)).astype(np.int32))

    placed = in_range(records, bounds).withColumn("part", part_of("range", F.xxhash64(F.lit("part"), F.col("doc_id"))))
    split: dict[int, np.ndarray] = {r: np.zeros(parts[r]) for r in whole_not}
    if split:  # as many rows as the parts of keys that fill shards
        for r in placed.filter(F.col("range").isin(whole_not)).groupBy("range", "part").agg(F.sum("size").alias("bytes")).collect():
            split[r.range][r.part] = r.bytes
    where = assign(found, split, shards)
    start = np.zeros(n_ranges, np.int64)  # of a range's shards in the flat list below
    flat: list[int] = []
    several = np.zeros(n_ranges, bool)
    for r in found.index:
        start[r] = len(flat)
        several[r] = r in split
        flat += [where[(r, i)] for i in range(parts[r])] if r in split else [where[(r, -1)]]
    flat_shards = np.array(flat, np.int32)

    @F.pandas_udf("int")
    def shard_of(rng: pd.Series, part: pd.Series) -> pd.Series:
        r = rng.to_numpy()
        return pd.Series(flat_shards[start[r] + np.where(several[r], part.to_numpy(), 0)])

    placed = placed.withColumn("shard", shard_of("range", "part"))
    counts = placed.groupBy("shard", "range", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "range", "part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "range", "part").orderBy("key", "doc_id"))
    numbered = placed.withColumn("rank", rank).join(counts, ["shard", "range", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as one Parquet folder for each shard, all rows and columns
    kept, with ``shard`` and ``slot``; where ``docs`` has columns of these
    names, they stay and the new ones get a trailing underscore.  Rows are told
    apart by a key of their own, so ids may be null or shared."""
    key, placed_key = own_names("row", "placed")
    rows = staged(docs.withColumn(key, F.monotonically_increasing_id()), "sharded-rows")
    names = {}
    for name in ("shard", "slot"):
        names[name] = name
        while names[name].lower() in {c.lower() for c in docs.columns}:
            names[name] += "_"
    by_row = docs.sparkSession.read.parquet(rows.staged_at).select(F.col(key).alias("doc_id"), F.col(text_col).alias("text"))
    placed = shard(by_row, shards).select(F.col("doc_id").alias(placed_key), *(F.col(c).alias(n) for c, n in names.items()))
    out = rows.join(placed, F.col(key) == F.col(placed_key)).drop(key, placed_key)
    out.repartition(names["shard"], F.floor(F.col(names["slot"]) / 65536)).sortWithinPartitions(*names.values()).write.partitionBy(names["shard"]).parquet(path)
