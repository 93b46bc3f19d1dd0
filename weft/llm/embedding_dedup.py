"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are linked when their squared distance is at most ``2 - 2 * cos``.
A rotation spreads them over blocks of few dimensions; a pair within the limit
lies, in one block at least, within that block's share of the limit.  In each
block a range join over sampled slabs of its first coordinate finds the pairs
within the share; a pair is reported only by its first such block, and is
checked on the vectors themselves, in double precision.

Tasks count links and keep only edges that join parts not joined yet, so a
large group of near copies never leaves a task as pairs.  Identical vectors are
one node with a multiplicity.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.components import components
from weft.llm.shared import arrow_map, clear_scratch, hot_keys, keyed_join, staged, staged_so_far

#: Dimensions of a block, home vectors of a task, vectors in the sample that fixes slabs.
BLOCK_DIMS, HOME_ROWS, SAMPLE_VECTORS = 8, 8192, 20_000
#: Visitors compared at once, and pairs checked at once.
TILE, PAIRS_AT_ONCE = 1024, 1 << 15
#: What rounding may add to a squared distance.
ROUNDING = 1e-9


@lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(4242).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[tuple[int, int]]:
    return [(a, min(dims, a + BLOCK_DIMS)) for a in range(0, dims, BLOCK_DIMS)]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their norms, in double precision; scaled first, so that no square over- or underflows."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _nodes(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, dims, data) of the usable vectors: all components present and finite, one not zero."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            keep, keys, dims, data = [], [], [], []
            for i, v in enumerate(lists.to_pylist()):
                if v and None not in v:
                    a = np.array(v, np.float64) + 0.0  # -0.0 as 0.0
                    if np.isfinite(a).all() and a.any():
                        keep.append(i)
                        data.append(a.tobytes())
                        keys.append(blake2b(data[-1], digest_size=16).digest())
                        dims.append(len(a))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "key", "dims", "data"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.transform(arrow_map, run, f"vec_id {kind}, key binary, dims int, data binary")


def _rotated(data: list[bytes], dims: int) -> tuple[np.ndarray, np.ndarray]:
    x = unit(np.frombuffer(b"".join(data), np.float64).reshape(-1, dims))
    return x, x @ rotation(dims)


def _slabs(nodes: DataFrame, dims: int, n: int) -> list[np.ndarray]:
    """Boundaries of the slabs of each block's first coordinate: quantiles of a bounded sample."""
    slabs = max(1, -(-n // HOME_ROWS))
    if slabs == 1:
        return [np.zeros(0) for _ in blocks_of(dims)]
    share = min(1.0, 2 * SAMPLE_VECTORS / n)
    rows = nodes.filter(F.col("dims") == dims).filter(F.shiftrightunsigned(F.xxhash64("key"), 11) / float(1 << 53) < share).select("data").limit(4 * SAMPLE_VECTORS).collect()
    _, y = _rotated([bytes(r.data) for r in rows], dims)
    return [np.quantile(y[:, a], np.arange(1, slabs) / slabs) for a, _ in blocks_of(dims)]


def _placed(cuts: dict[int, list[np.ndarray]], limit: float):
    """Rows for the tasks: a vector at home in one slab of each block (role 0),
    and a visitor (role 1) there and in each lower slab within its reach."""

    def run(batches):
        for batch in batches:
            dims_col = batch.column(2).to_numpy()
            for dims in np.unique(dims_col).tolist():
                part = batch.filter(pa.array(dims_col == dims))
                _, y = _rotated(part.column(3).to_pylist(), dims)
                for b, (lo, hi) in enumerate(blocks_of(dims)):
                    c = y[:, lo]
                    reach = np.sqrt(limit * (hi - lo) / dims) + 1e-6
                    home = np.searchsorted(cuts[dims][b], c, "right")
                    least = np.searchsorted(cuts[dims][b], c - reach, "right")
                    n = home - least + 1
                    row = np.repeat(np.arange(len(c)), n)
                    slab = home[row] - (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
                    for role, rows, slabs in ((0, np.arange(len(c)), home), (1, row, slab)):
                        k = len(rows)
                        at = pa.array(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, dims, np.int32)), pa.array(np.full(k, b, np.int32)), pa.array(slabs.astype(np.int32)), pa.array(np.full(k, role, np.int32)), pa.array(home[rows].astype(np.int32)), part.column(0).take(at), part.column(1).take(at), part.column(3).take(at)], _PLACED)

    return run


_PLACED = ["dims", "block", "slab", "role", "home", "node", "times", "data"]


class _Home:
    """The home vectors of a task, and what is counted for them."""

    def __init__(self, dims: int, block: int, limit: float, cosine: float):
        self.dims, self.block, self.limit, self.cosine = dims, block, limit, cosine
        self.rows: list = []
        self.ready = False

    def add(self, nodes, times, data, homes):
        self.rows.append((nodes, times, data, homes))

    def prepare(self) -> None:
        self.node = np.concatenate([r[0] for r in self.rows]) if self.rows else np.zeros(0, np.int64)
        self.times = np.concatenate([r[1] for r in self.rows]) if self.rows else np.zeros(0, np.int64)
        if len(self.node):
            self.x, self.y = _rotated([d for r in self.rows for d in r[2]], self.dims)
            lo, hi = blocks_of(self.dims)[self.block]
            order = np.argsort(self.y[:, lo + (hi - lo > 1)], kind="stable")
            self.node, self.times, self.x, self.y = self.node[order], self.times[order], self.x[order], self.y[order]
            self.sort_key = self.y[:, lo + (hi - lo > 1)]
            self.part = self.y[:, lo:hi].astype(np.float32)
            self.norm = (self.part.astype(np.float64) ** 2).sum(1).astype(np.float32)
        self.links = np.zeros(len(self.node), np.int64)
        self.root = np.arange(len(self.node))
        self.rows, self.ready = [], True

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def visit(self, node, times, data, home, slab: int):
        """(counts of the visitors, edges) of one batch of visitors."""
        counts = np.zeros(len(node), np.int64)
        edges: list[tuple[int, int]] = []
        if not len(self.node) or not len(node):
            return counts, edges
        x, y = _rotated(data, self.dims)
        lo, hi = blocks_of(self.dims)[self.block]
        share = self.limit * (hi - lo) / self.dims + ROUNDING
        reach = np.sqrt(share) + 1e-6
        key = y[:, lo + (hi - lo > 1)]
        order = np.argsort(key, kind="stable")
        for t in range(0, len(order), TILE):
            tile = order[t : t + TILE]
            a, z = np.searchsorted(self.sort_key, [key[tile[0]] - reach, key[tile[-1]] + reach])
            if a == z:
                continue
            v = y[tile, lo:hi].astype(np.float32)
            square = (v.astype(np.float64) ** 2).sum(1).astype(np.float32)
            near = self.norm[None, a:z] - 2 * (v @ self.part[a:z].T) <= (np.float32(share + 1e-5) - square)[:, None]
            vi, hi_ = np.nonzero(near)
            vi, hi_ = tile[vi], hi_ + a
            first = (home[vi] > slab) | (node[vi] > self.node[hi_])  # a pair of one slab once
            vi, hi_ = vi[first], hi_[first]
            for p in range(0, len(vi), PAIRS_AT_ONCE):
                u, h = vi[p : p + PAIRS_AT_ONCE], hi_[p : p + PAIRS_AT_ONCE]
                for b, (c, d) in enumerate(blocks_of(self.dims)[: self.block + 1]):  # found by this block, and no earlier one
                    inside = ((y[u, c:d] - self.y[h, c:d]) ** 2).sum(1) <= self.limit * (d - c) / self.dims + ROUNDING
                    if b < self.block:
                        inside = ~inside
                    u, h = u[inside], h[inside]
                same = np.einsum("ij,ij->i", x[u], self.x[h]) >= self.cosine
                u, h = u[same], h[same]
                np.add.at(counts, u, self.times[h])
                np.add.at(self.links, h, times[u])
                if len(u):
                    edges += self._edges(node, u, h)
        return counts, edges

    def _edges(self, node, u, h) -> list[tuple[int, int]]:
        """One edge for each visitor, and one wherever it joins homes that weren't joined."""
        out = []
        order = np.lexsort((h, u))
        u, h = u[order], h[order]
        new = np.concatenate([[True], u[1:] != u[:-1]])
        heads = h[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        out += list(zip(node[u[new]].tolist(), self.node[h[new]].tolist()))
        pairs = np.unique(np.stack([heads[~new], h[~new]], 1), axis=0) if (~new).any() else np.zeros((0, 2), np.int64)
        for i, j in pairs.tolist():
            ri, rj = self.find(i), self.find(j)
            if ri != rj:
                self.root[max(ri, rj)] = min(ri, rj)
                out.append((int(self.node[i]), int(self.node[j])))
        return out


def _joined(limit: float, cosine: float):
    """Links (other null) and edges from rows sorted by task, homes first."""

    def run(batches):
        task, home = None, None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(5)]
            chunk = batch.column(5).to_numpy()
            change = np.zeros(batch.num_rows, bool)
            for c in (*cols[:4], chunk):
                change[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(change).tolist()] if batch.num_rows else []
            for s, e in zip(starts, [*starts[1:], batch.num_rows]):
                now = (int(cols[0][s]), int(cols[1][s]), int(cols[2][s]), int(chunk[s]))
                if now != task:
                    if home is not None and home.ready:
                        yield _result(home.node, home.links, [])
                    task, home = now, _Home(now[0], now[1], limit, cosine)
                nodes, times = batch.column(6).slice(s, e - s).to_numpy(), batch.column(7).slice(s, e - s).to_numpy()
                data = batch.column(8).slice(s, e - s).to_pylist()
                if cols[3][s] == 0:
                    home.add(nodes, times, data, None)
                    continue
                if not home.ready:
                    home.prepare()
                counts, edges = home.visit(nodes, times, data, cols[4][s:e], now[2])
                yield _result(nodes, counts, edges)
        if home is not None and home.ready:
            yield _result(home.node, home.links, [])

    return run


def _result(nodes, counts, edges) -> pa.RecordBatch:
    some = counts > 0
    k = int(some.sum())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([nodes[some], np.array([a for a, _ in edges], np.int64)])), pa.array([None] * k + [b for _, b in edges], pa.int64()), pa.array(np.concatenate([counts[some], np.zeros(len(edges), np.int64)]))], ["node", "other", "links"]
    )


def similar_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with a cosine of at least ``cosine`` are linked; ``n_links`` counts
    the other vectors linked directly, ``component_id`` is the smallest id that
    links reach (null where there is none).  Vectors that are null, empty or
    zero, or hold null or non-finite components, link with nothing, and so do
    vectors of different lengths.  Repeated rows link with each other.  An
    empty table gives an empty result; other columns are not read.
    """
    limit, spark = 2 - 2 * cosine, vectors.sparkSession
    since = staged_so_far(spark)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    usable = staged(_nodes(rows), "vectors")
    nodes = usable.groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("times"), F.first("dims").alias("dims"), F.first("data").alias("data"))
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("node"), "times", "dims", "data", "key", "vec_id"), "vector-nodes")
    sizes = {r["dims"]: r["count"] for r in nodes.groupBy("dims").count().collect()}  # as many rows as there are lengths
    cuts = {d: _slabs(nodes, d, n) for d, n in sizes.items()}
    kind = "dims int, block int, slab int, role int, home int, node long, times long, data binary"
    placed = staged(nodes.select("node", "times", "dims", "data").transform(arrow_map, _placed(cuts, limit), kind), "placed")
    # a slab with many home vectors is shared out; its visitors go to every share
    shares = placed.filter("role = 0").groupBy("dims", "block", "slab").agg(F.ceil(F.count(F.lit(1)) / (2 * HOME_ROWS)).cast("int").alias("shares"))
    placed = placed.join(F.broadcast(shares) if len(sizes) * max(sizes.values(), default=0) < 10_000_000 else shares, ["dims", "block", "slab"])
    chunk = F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("shares") - 1))
    placed = placed.withColumn("chunk", F.explode(chunk)).select("dims", "block", "slab", "role", "home", "chunk", "node", "times", "data")
    tasks = placed.repartition("dims", "block", "slab", "chunk").sortWithinPartitions("dims", "block", "slab", "chunk", "role")
    found = staged(tasks.transform(arrow_map, _joined(limit, cosine), "node long, other long, links long"), "vector-links")
    comps = components(found.filter("other is not null"), "node", "other")
    links = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    clear_scratch(spark, since, [usable, nodes, found, comps])
    named = nodes.select("node", "key", "times", "vec_id").join(links, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = keyed_join(named, ids, ["component"], hot_keys(named.groupBy("component").agg(F.count(F.lit(1)).alias("n")), ["component"]))
    named = named.select("key", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    linked = keyed_join(usable.select("vec_id", "key"), named, ["key"], hot_keys(nodes.select("key", F.col("times").alias("n")), ["key"])).select("vec_id", "n_links", "component_id")
    odd = F.col("embedding").isNull() | (F.size("embedding") == 0) | F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | F.forall("embedding", lambda v: v == 0)
    alone = rows.filter(F.coalesce(odd, F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
