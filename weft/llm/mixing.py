"""Mixing sources to target weights by subset-sum budget fitting.

Sources share the whole corpus' words by weight; no source is asked for more
than ``max_repeats`` times what it has, and the excess goes to the others.
Within a source, documents are counted by exact length.  Whole copies of the
source come first; the remaining budget is met by a number of documents of
each length, found by a proportional share, a greedy step and a bounded
knapsack over the last words; see ``fit_source`` for what then is left over.  Which documents of a length are taken is decided
by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.shared import own_names, staged

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Source names and totals are small, and fit the driver up to this many.
MAX_SOURCES = 1_000_000
#: Words that the exact knapsack fits at most.
KNAPSACK_WORDS = 1 << 16
#: Documents of one length that one task orders.
ROWS_A_BUCKET = 2048


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, max_repeats: float) -> list[float]:
    """Targets in proportion to weight, none above max_repeats times its size;
    the excess is reshared by weight until none is above."""
    targets, open_ = [0.0] * len(sizes), [i for i in range(len(sizes)) if sizes[i]]
    left = float(total)
    while open_:
        by = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / by >= max_repeats * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / by
            break
        for i in over:
            targets[i] = float(max_repeats * sizes[i])
        left -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def bounded_knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the sum is as near ``budget``
    from below as any choice comes."""
    parts = []  # (weight, item, number), counts split into powers of two
    for i in np.flatnonzero((lengths <= budget) & (lengths > 0) & (counts > 0)):
        n, step = min(int(counts[i]), budget // int(lengths[i])), 1
        while n > 0:
            k = min(step, n)
            parts.append((int(lengths[i]) * k, int(i), k))
            n -= k
            step *= 2
    # the part that first reaches each sum: sums come in the order of parts, so one number a sum is enough
    first = np.full(budget + 1, -1, np.int64)
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    for j, (weight, _, _) in enumerate(parts):
        new = np.flatnonzero(reach[: budget + 1 - weight] & ~reach[weight:]) + weight
        reach[new], first[new] = True, j
        if reach[budget]:
            break
    at, out = int(np.flatnonzero(reach)[-1]), np.zeros(len(lengths), np.int64)
    while at:
        weight, i, k = parts[first[at]]
        out[i] += k
        at -= weight
    return out


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length make up ``budget`` words, in three
    steps: a proportional share, greedily from the longest, then a knapsack."""
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((take * lengths).sum())
    order = np.argsort(-lengths, kind="stable")
    for keep in (KNAPSACK_WORDS, 0):  # below the second step only lengths above what is left remain
        for i in order if left > 2 * KNAPSACK_WORDS else ():
            k = min(int(counts[i] - take[i]), (left - keep) // int(lengths[i])) if lengths[i] else 0
            take[i] += max(0, k)
            left -= max(0, k) * int(lengths[i])
    return take + bounded_knapsack(lengths, counts - take, left)


def fit_source(lengths: np.ndarray, counts: np.ndarray, words: int, target: float, max_repeats: int) -> tuple[int, np.ndarray]:
    """(whole copies of a source, copies of documents of each length besides).

    Each document comes at most ``max_repeats`` times.  Second copies are used
    only where single ones leave words to fill, and where documents are too
    long for what is left, one of them is taken if that comes nearer.
    """
    whole = int(target // words) if words else 0
    none = np.zeros(len(lengths), np.int64)
    if not words:
        return 0, none
    budget, room = int(round(target - whole * words)), counts * (max_repeats - whole)
    below = fit_budget(lengths, np.minimum(counts, room), budget)
    gap = budget - int((below * lengths).sum())
    if gap:
        below = below + fit_budget(lengths, room - below, gap)
    choices = [below]
    some = np.flatnonzero((lengths > 0) & (below < room))
    if len(some):
        choices.append(below + (np.arange(len(lengths)) == some[lengths[some].argmin()]))
    longer = np.flatnonzero((lengths > budget) & (room > 0))
    if len(longer):
        choices.append((np.arange(len(lengths)) == longer[lengths[longer].argmin()]).astype(np.int64))
    return whole, min(choices, key=lambda c: abs(budget - int((c * lengths).sum())))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeats: int) -> list[tuple]:
    """(source, source_size, target) in code point order, null last."""
    rows = sizes.groupBy("source").agg(F.sum("n_words").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    words = [int(r.words) for r in rows]
    targets = water_fill(words, [weights[i % len(weights)] for i in range(len(rows))], share * sum(words), max_repeats)
    return [(r.source, w, t) for r, w, t in zip(rows, words, targets)]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.0, max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    ``size`` counts words (null text: 0); ``copies`` is how often the mix takes
    the document and ``taken`` its words in all.  Sources rank by code point,
    null last; ``weights`` repeat over them.  Ties of the seeded hash go to the
    smaller id, and repeated rows share copies in no fixed order but with equal
    results.  Documents without words cost nothing: they come with every whole
    copy, and with the last one in their length's proportion.  An
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = staged(sized, "sizes")
    by_length = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = source_targets(by_length.select("source", (F.col("size") * F.col("n")).alias("n_words")), weights, share, max_repeats)

    def fit(pdf):
        pdf = pdf.sort_values("size")
        n = pdf.n.to_numpy(np.int64)
        whole, extra = fit_source(pdf["size"].to_numpy(np.int64), n, int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0]), max_repeats)
        return pdf.assign(whole=whole + extra // n, extra=extra % n)[["source", "size", "n", "source_size", "target", "whole", "extra"]]

    plan_schema = "source string, size long, n long, source_size long, target double, whole long, extra long"
    per_source = F.broadcast(spark.createDataFrame(targets, "t_source string, source_size long, target double"))
    by_length = by_length.join(per_source, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    plan = staged(by_length.groupBy("source").applyInPandas(fit, plan_schema), "mix-plan").withColumn("buckets", F.ceil(F.col("n") / ROWS_A_BUCKET).cast("int"))
    # all of a length, or none: no order is needed; else buckets of the hash are taken whole up to one that is cut
    p = plan.withColumnsRenamed({"source": "p_source", "size": "p_size"})
    drawn = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = sized.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))).drop("p_source", "p_size").withColumn("draw", drawn).withColumn("bucket", F.pmod(F.shiftrightunsigned("draw", 20), F.col("buckets")).cast("int"))
    cut = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    counted = rows.filter(cut).groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counted = counted.withColumn("before", F.coalesce(before, F.lit(0))).select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"), "before")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("draw", F.col("doc_id").asc_nulls_last()))
    ordered = rows.filter(cut).withColumn("rank", rank).join(counted, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b_bucket")))
    ordered = ordered.withColumn("more", (F.col("before") + F.col("rank") <= F.col("extra")).cast("int"))
    plain = rows.filter(~cut).withColumn("more", (F.col("extra") > 0).cast("int"))
    cols = ["doc_id", "size", "source_size", "target", "whole", "more"]
    out = plain.select(*cols).unionByName(ordered.select(*cols)).withColumn("copies", F.col("whole") + F.col("more"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("int").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all columns kept.

    Rows that share an id come as often as the one of them that is taken most;
    rows with a null id are one such group.  An empty table stays empty.
    """
    mixed_id, copies, copy = own_names("id", "copies", "copy")
    counts = mix(docs, id_col, **options).groupBy(F.col("doc_id").alias(mixed_id)).agg(F.max("copies").alias(copies)).filter(F.col(copies) > 0)
    taken = docs.join(counts, F.col(id_col).eqNullSafe(F.col(mixed_id)))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
