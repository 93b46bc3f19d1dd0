"""Ranked search with block-max WAND over blocks of varying length.

Documents are put into shards, each with the posting lists of the terms asked
for.  Once the corpus' counts are known, a list's impacts are, and dynamic
programming cuts each list into blocks: it minimises how far the blocks'
greatest impacts lie above the impacts of the documents they span, those
without the term included, where a further block costs as much as some
documents that are off by the list's mean impact.

A shard is searched in the order of its documents.  The greatest impacts of the
blocks over a document bound its score; documents whose bound is below the
tenth best score so far are passed over without reading postings, the next ones
that reach it are the pivots, whose scores are worked out exactly.  The best
scores are carried from shard to shard within a task.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.bpe import word_hashes
from weft.llm.shared import arrow_map, clear_scratch, lowered, mapped, slices, staged, staged_so_far, text_bytes

#: Documents and bytes of text in a shard.
SHARD_DOCS, SHARD_BYTES = 4096, 16 << 20
#: Postings in a block at most, and documents off by the list's mean impact that a further block costs.
LONGEST_BLOCK, BLOCK_COST = 64, 8.0
#: Pivots whose scores are worked out at once.
PIVOTS_AT_ONCE = 64
#: Bytes of item texts that are searched for in one go over the documents.
ITEM_BYTES = 8 << 20

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[97:123] = _TERM[128:] = True
_IS_TERM = _TERM.tobytes()


def term_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of all texts: runs of ASCII digits, letters
    (lower-cased before) and anything beyond ASCII."""
    term = mapped(raw, _IS_TERM).view(bool)
    before = np.zeros(len(raw) + 1, bool)  # whether a term goes on over the place before each byte
    before[1:-1] = term[:-1] & term[1:]
    before[offsets[(offsets > 0) & (offsets < len(raw))]] = False
    return np.flatnonzero(term & ~before[:-1]), np.flatnonzero(term & ~before[1:]) + 1


class Vocabulary:
    """Numbers of the terms asked for, found by two hashes of a word."""

    def __init__(self, words: list[bytes]):
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        h0, h1 = word_hashes(raw, ends - np.array([len(w) for w in words], np.int64), ends)
        order = np.argsort(h0)
        self.h0, self.h1, self.number = h0[order], h1[order], order

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span's term, -1 for terms not asked for."""
        if not len(self.h0) or not len(starts):
            return np.full(len(starts), -1)
        h0, h1 = word_hashes(raw, starts, ends)
        at = np.minimum(np.searchsorted(self.h0, h0), len(self.h0) - 1)
        return np.where((self.h0[at] == h0) & (self.h1[at] == h1), self.number[at], -1)


def item_terms(text: str | None) -> Counter:
    raw = lowered(np.frombuffer((text or "").encode(), np.uint8))
    view = raw.tobytes()
    return Counter(view[a:b] for a, b in zip(*(x.tolist() for x in term_spans(raw, np.array([0, len(raw)])))))


# -- shards --------------------------------------------------------------------

SHARD = "n_docs long, n_terms long, ids array<long>, lengths binary, terms array<int>, dfs array<int>, docs binary, tfs binary"


def _sharded(words: list[bytes]):
    """Shards of (doc_id, text): documents with some term, and their postings of the terms asked for."""

    def run(batches):
        known = Vocabulary(words)
        ids: list = []
        lengths: list[np.ndarray] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_docs = size = 0

        def shard():
            term, doc, tf = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = np.argsort(term, kind="stable")  # documents ascend already
            term, doc, tf = term[order], doc[order], tf[order]
            terms, dfs = np.unique(term, return_counts=True)
            n = np.concatenate(lengths)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int((n > 0).sum())]),
                    pa.array([int(n.sum())]),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([n.astype(np.int64).tobytes()], pa.binary()),
                    pa.array([terms.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([dfs.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([doc.astype(np.int32).tobytes()], pa.binary()),
                    pa.array([tf.astype(np.int64).tobytes()], pa.binary()),
                ],
                [c.split()[0] for c in SHARD.split(", ")],
            )

        for part in slices(batches, "text", 1 << 20):
            raw, offsets = text_bytes(part.column(1))
            raw = lowered(raw)
            starts, ends = term_spans(raw, offsets)
            doc = np.searchsorted(offsets, starts, "right") - 1
            lengths.append(np.bincount(doc, minlength=part.num_rows))
            number = known.find(raw, starts, ends)
            some = number >= 0
            pair, tf = np.unique(doc[some] * max(1, len(words)) + number[some], return_counts=True)
            found.append((pair % max(1, len(words)), pair // max(1, len(words)) + n_docs, tf))
            ids += part.column(0).to_pylist()
            n_docs, size = n_docs + part.num_rows, size + len(raw)
            if n_docs >= SHARD_DOCS or size >= SHARD_BYTES:
                yield shard()
                ids, lengths, found, n_docs, size = [], [], [], 0, 0
        if n_docs:
            yield shard()

    return run


# -- blocks --------------------------------------------------------------------


def cut_blocks(docs: np.ndarray, impacts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the blocks of consecutive lists end (list i ends before ``ends[i]``).

    For each list: the least sum over its blocks of documents spanned times
    greatest impact, plus a cost a block, over all cuts into blocks of at most
    LONGEST_BLOCK postings.  Lists of like length are worked on together, posting by
    posting.
    """
    begins = np.concatenate([[0], ends[:-1]])
    sizes = ends - begins
    out = [np.zeros(0, np.int64)]
    grade = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    for g in np.unique(grade[sizes > 0]).tolist():
        lists = np.flatnonzero((grade == g) & (sizes > 0))
        n, most = sizes[lists], int(sizes[lists].max())
        inside = np.arange(most) < n[:, None]
        place = np.minimum(begins[lists][:, None] + np.arange(most), len(impacts) - 1)
        values, at_doc = np.where(inside, impacts[place], 0).astype(np.float64), docs[place]
        price = BLOCK_COST * values.sum(1) / n
        best = np.zeros((len(lists), most + 1))
        came = np.zeros((len(lists), most + 1), np.int32)
        greatest = np.zeros((len(lists), most))
        for j in range(most):
            low = max(0, j + 1 - LONGEST_BLOCK)
            held = greatest[:, low : j + 1]
            np.maximum(held, values[:, j : j + 1], out=held)
            total = best[:, low : j + 1] + held * (at_doc[:, j : j + 1] - at_doc[:, low : j + 1] + 1)
            least = total.argmin(1)
            best[:, j + 1] = total[np.arange(len(lists)), least] + price
            came[:, j + 1] = low + least
        at, left = n.copy(), np.arange(len(lists))
        while len(left):
            out.append(begins[lists[left]] + at[left])
            at[left] = came[left, at[left]]
            left = left[at[left] > 0]
    return np.sort(np.concatenate(out))


class Shard:
    """Posting lists with impacts and blocks, ready to be searched."""

    def __init__(self, ids: list, lengths: np.ndarray, terms: np.ndarray, dfs: np.ndarray, docs: np.ndarray, tfs: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.docs = ids, docs.astype(np.int64)
        m = 25 + (75 * lengths * n_docs) // max(1, n_terms)
        self.impacts = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[self.docs])
        self.ends = np.cumsum(dfs, dtype=np.int64)
        self.begins = self.ends - dfs
        self.place = {t: i for i, t in enumerate(terms.tolist())}
        cuts = cut_blocks(self.docs, self.impacts, self.ends)
        begin = np.concatenate([[0], cuts[:-1]]).astype(np.int64)
        self.block_first, self.block_last = (self.docs[begin], self.docs[cuts - 1]) if len(cuts) else (begin[:0], begin[:0])
        self.block_most = np.maximum.reduceat(self.impacts, begin) if len(cuts) else begin[:0]
        self.block_ends = np.searchsorted(cuts, self.ends, "right")
        self.block_begins = np.concatenate([[0], self.block_ends[:-1]]).astype(np.int64)
        self.keys = np.repeat(np.arange(len(dfs)), dfs) * len(ids) + self.docs

    def search(self, terms: dict[int, int], best: list[tuple], k: int) -> list[tuple]:
        """The k best of ``best`` and this shard's documents, each (-score, id is null, id)."""
        lists = np.array([self.place[t] for t in terms if t in self.place], np.int64)
        weights = np.array([w for t, w in terms.items() if t in self.place], np.float64)
        if not len(lists):
            return best
        n = len(self.ids)
        blocks, owner = _runs(self.block_begins[lists], self.block_ends[lists])
        most = weights[owner] * self.block_most[blocks]
        # sums of whole numbers below 2**53 are exact in doubles
        bound = np.cumsum(np.bincount(self.block_first[blocks], most, n + 1) - np.bincount(self.block_last[blocks] + 1, most, n + 1))[:n]
        at = 0
        while True:
            least = -best[-1][0] if len(best) >= k else 1
            pivots = np.flatnonzero(bound[at:] >= least)[:PIVOTS_AT_ONCE] + at
            if not len(pivots):
                return best
            edges = np.flatnonzero(np.diff(pivots) > 1)  # neighbouring pivots are one range of each list
            low, high = pivots[np.concatenate([[0], edges + 1])], pivots[np.concatenate([edges, [len(pivots) - 1]])] + 1
            begin, end = np.searchsorted(self.keys, (lists[:, None] * n + np.stack([low, high])[:, None]).reshape(2, -1))
            postings, owner = _runs(begin, end)
            score = np.bincount(np.searchsorted(pivots, self.docs[postings]), weights[owner // len(low)] * self.impacts[postings], len(pivots))
            at = pivots[-1] + 1
            good = np.flatnonzero(score >= least)
            if len(good):
                new = [(-int(s), self.ids[d] is None, self.ids[d]) for s, d in zip(score[good].tolist(), pivots[good].tolist())]
                best = sorted(best + new, key=lambda r: (r[0], r[1], r[2] or 0))[:k]


def _runs(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all places of some ranges, the number of each place's range)."""
    sizes = ends - begins
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes), owner


def _searched(items: list[dict[int, int]], n_docs: int, n_terms: int, k: int):
    """The k best documents of each item among a task's shards."""

    def run(batches):
        best: list[list[tuple]] = [[] for _ in items]
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, terms, dfs, docs, tfs = (batch.column(i)[row] for i in range(6))
                ints = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
                shard = Shard(ids.as_py(), ints(lengths, np.int64), terms.values.to_numpy(), dfs.values.to_numpy(), ints(docs, np.int32), ints(tfs, np.int64), n_docs, n_terms)
                best = [shard.search(terms, own, k) for terms, own in zip(items, best)]
        rows = [(i, r[2], -r[0]) for i, own in enumerate(best) for r in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["item", "doc_id", "score"])

    return run


def _block_of_items(texts: DataFrame, items: list, k: int) -> list[DataFrame]:
    """Ranked rows of some items: none, or one table of (item_id, rank, doc_id, score)."""
    spark = texts.sparkSession
    since = staged_so_far(spark)
    asked = [item_terms(r.text) for r in items]
    words = sorted(set().union(*asked))
    number = {w: i for i, w in enumerate(words)}
    shards = staged(texts.transform(arrow_map, _sharded(words), SHARD), "shards")
    n_docs, n_terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not words or not n_docs:
        return []
    listed = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df"))
    weight = {r.terms: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1))) for r in listed.collect()}  # a row a term asked for
    wanted = [{number[w]: n * weight[number[w]] for w, n in a.items() if weight.get(number[w])} for a in asked]
    found = shards.select("ids", "lengths", "terms", "dfs", "docs", "tfs").transform(arrow_map, _searched(wanted, n_docs, n_terms, k), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = staged(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "ranked")
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], ranked.select("item", F.col("doc_id").alias("item_id")).schema)
    clear_scratch(spark, since, [ranked])
    return [ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")]


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k best documents of each row of ``items``: item_id, rank, doc_id, score.

    Terms are runs of ASCII digits, letters and anything beyond ASCII, A-Z
    lower-cased.  N documents with a term hold L terms, a document n, of which
    tf are the term that df documents hold.  A term weighs ``w = floor(1000 *
    ln((2N+2) / (2df+1)))``, and a document scores ``w * (10**9 * tf div (1000
    * tf + 8 * (25 + 75nN div L)))`` summed over the item's terms, repeats
    included.  Scores are over 0; equal ones go by ascending id, null last, and
    rows that share an id rank in no fixed order.  Null or empty texts have no
    terms; items without any, or with none that a document has, give no rows;
    items that repeat are ranked each for itself.  An empty table gives an empty
    result; other columns are not read.  Items are searched for in blocks of
    ITEM_BYTES of their texts, each of which reads ``docs`` once.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    asked = staged(asked.withColumn("number", F.monotonically_increasing_id()), "items")
    total = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-int(total) // ITEM_BYTES))
    out: list[DataFrame] = []
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).collect()
        out += _block_of_items(texts, rows, k) if rows else []
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
