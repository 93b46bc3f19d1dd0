"""Ranked search against scores worked out for every document."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from plain import ascii_lower

from weft.llm import ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(ascii_lower(text))


def plain(docs, items, k=10):
    """For each (item_id, text): the k best (doc_id, score) of (doc_id, text) rows."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (i, c), length in zip(counts, lengths):
            m = 100 - 75 + 75 * length * n // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("docs_a_shard,pivots", [(4096, 64), (7, 3)])
def test_ranked(docs, messy, spark, monkeypatch, docs_a_shard, pivots):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", docs_a_shard)
    monkeypatch.setattr(ranked_search, "PIVOTS_AT_ONCE", pivots)
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(messy)[1] or "x" for _ in range(2))[:300]) for i in range(25)]
    items += [(30, None), (31, ""), (32, "!!"), (33, "nowhere-at-all"), (34, "SAME Text same"), (34, "the the é"), (None, "der die le")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = Counter(plain([(i, t) for i, t, *_ in messy], items))
    assert Counter(map(tuple, ranked_search.ranked(docs, table).collect())) == want
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 2000)  # several goes
    assert Counter(map(tuple, ranked_search.ranked(docs, table).collect())) == want


def test_empty(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "the")], "item_id long, text string")
    for got in (ranked_search.ranked(empty, one), ranked_search.ranked(docs, none)):
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_blocks_have_the_least_error(monkeypatch):
    monkeypatch.setattr(ranked_search, "LONGEST_BLOCK", 4)
    monkeypatch.setattr(ranked_search, "BLOCK_COST", 1.5)
    rng = np.random.default_rng(6)
    sizes = [1, 2, 7, 0, 9, 5, 8]
    impacts = rng.integers(1, 50, sum(sizes))
    docs = np.concatenate([np.sort(rng.choice(12, n, replace=False)) for n in sizes])
    ends = np.cumsum(sizes)
    cuts = ranked_search.cut_blocks(docs, impacts, ends).tolist()
    for size, end in zip(sizes, ends.tolist()):
        own, at = impacts[end - size : end].tolist(), docs[end - size : end].tolist()
        price = 1.5 * sum(own) / max(1, size)

        def cost(edges, own=own, at=at, price=price):
            return sum((at[b - 1] - at[a] + 1) * max(own[a:b]) + price for a, b in zip(edges, edges[1:]))

        choices = [[0, *c, size] for k in range(size) for c in itertools.combinations(range(1, size), k)] if size else []
        choices = [c for c in choices if all(b - a <= 4 for a, b in zip(c, c[1:]))]
        if size:
            made = [0, *[c - (end - size) for c in cuts if end - size < c <= end]]
            assert math.isclose(cost(made), min(map(cost, choices))) and made[-1] == size


def test_few_postings_are_read():
    """With a good tenth score, documents below it are passed over."""
    n = 4000
    docs = np.concatenate([np.arange(n), np.arange(0, n, 400)]).astype(np.int32)
    tfs = np.ones(len(docs), np.int64)
    shard = ranked_search.Shard(list(range(n)), np.full(n, 20), np.array([0, 1]), np.array([n, n // 400]), docs, tfs, n, 20 * n)
    read = []
    runs, ranked_search._runs = ranked_search._runs, lambda a, b: (read.append(int((b - a).sum())), runs(a, b))[1]
    try:
        best = shard.search({0: 1, 1: 9000}, [], 10)
        before = sum(read)
        assert [b[2] for b in best] == list(range(0, n, 400))
        shard.search({0: 1, 1: 9000}, best, 10)
    finally:
        ranked_search._runs = runs
    blocks = len(shard.block_most)
    assert sum(read) - before <= blocks + 20 and blocks < n / 10, (sum(read) - before, blocks)
