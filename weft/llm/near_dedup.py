"""Near-duplicate documents by b-bit MinHash.

Each document's set of word shingles has HASHES minima.  Bands of minima give
candidates; of each minimum only the low BITS are kept, packed into a few
64-bit words, and the similarity of a candidate pair is estimated from the bits
that agree, corrected for chance.  Pairs whose estimate comes near the
threshold are confirmed on their full sets.

Equal sets are one node.  In each bucket all nodes are first compared with one
pivot, the node that meets most others.  What then still lies in different
components is compared pair by pair: in small buckets with the estimate as part
of the join, in large ones block by block within tasks that only give the links
that join components.  So neither a large group of near copies nor a passage
that many documents share gives all pairs.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.bpe import word_hashes, word_spans
from weft.llm.components import components
from weft.llm.shared import arrow_map, clear_scratch, fits_broadcast, hot_keys, keyed_join, lowered, own_names, salts, slices, staged, staged_so_far, text_bytes

HASHES, BITS = 128, 4
WORDS = HASHES * BITS // 64
#: Chance of missing a pair at the threshold in all bands, at most.
MISS = 1e-6
#: Standard errors that an estimate may lie below the threshold.
ERRORS = 5.0
#: Nodes in a block of a large bucket, shingles in it, and how many nodes a small one has.
NODES_A_BLOCK, SHINGLES_A_BLOCK, SMALL_BUCKET = 512, 1 << 20, 24
#: A list of wanted documents of up to so many rows is broadcast, if it has few bytes too.
BROADCAST_ROWS = 250_000

_rng = np.random.default_rng(77)
_MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def rows_a_band(threshold: float) -> int:
    """The longest bands that miss a pair at the threshold with a chance of MISS at most."""
    fit = [r for r in range(1, 17) if (1 - threshold**r) ** (HASHES // r) <= MISS]
    return max(fit, default=1)


def lowest_estimate(threshold: float) -> float:
    return threshold - ERRORS * math.sqrt(threshold * (1 - threshold) / HASHES) / (1 - 2.0**-BITS)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the distinct shingles, sorted for each text; where each text's end).

    A text with fewer words than ``width`` has its whole sequence as its one
    shingle; one without words has none.
    """
    raw = lowered(raw)
    begin, end = word_spans(raw, offsets, marks=False)
    n_docs = len(offsets) - 1
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    h0, h1 = word_hashes(raw, begin, end)
    h = h0 ^ (h1 << np.uint64(1)) ^ (h1 >> np.uint64(63))
    doc = np.searchsorted(offsets, begin, "right") - 1
    first = np.searchsorted(begin, offsets[:-1], "left")
    n_words = np.diff(np.concatenate([first, [len(begin)]]))
    with np.errstate(over="ignore"):
        mixed = np.zeros(len(h), np.uint64)
        left = n_words[doc] - (np.arange(len(h)) - first[doc])  # words from here to the text's end
        for j in range(width):
            part = np.zeros(len(h), np.uint64)
            part[: len(h) - j] = h[j:]
            mixed = np.where(left > j, (mixed ^ part) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1), mixed)
            mixed ^= mixed >> np.uint64(31)
    whole = (left >= width) | (n_words[doc] < width) & (left == n_words[doc])
    mixed, doc = mixed[whole], doc[whole]
    order = np.argsort(mixed)
    order = order[np.argsort(doc[order].astype(np.int16 if n_docs < 1 << 15 else np.int64), kind="stable")]
    mixed, doc = mixed[order], doc[order]
    new = np.ones(len(mixed), bool)
    new[1:] = (mixed[1:] != mixed[:-1]) | (doc[1:] != doc[:-1])
    return mixed[new], np.searchsorted(doc[new], np.arange(n_docs), "right")


def minima(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """HASHES minima (columns) of each non-empty set (rows)."""
    begin = np.concatenate([[0], ends[:-1]])
    out = np.zeros((len(ends), HASHES), np.uint32)
    some = np.flatnonzero(ends > begin)
    if len(some):
        for k in range(HASHES):
            out[some, k] = np.minimum.reduceat((((sets ^ _XOR[k]) * _MULTIPLY[k]) >> np.uint64(32)).astype(np.uint32), begin[some])
    return out


def packed(values: np.ndarray) -> np.ndarray:
    """The low BITS of all minima of a row, in WORDS 64-bit words."""
    low = (values & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(values), WORDS, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64).view(np.int64)


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band, which holds the band's number too."""
    bands = HASHES // rows
    out = np.zeros((len(values), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(values), np.uint64((b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1), np.uint64)
        for r in range(rows):
            key = (key ^ values[:, b * rows + r].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
        out[:, b] = key
    return out.view(np.int64)


_SIG = [f"s{i}" for i in range(WORDS)]


def signatures(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_hash, s0.., bands) of each row of (doc_id, text)."""

    def run(batches):
        for part in slices(batches, "text"):
            sets, ends = shingle_sets(*text_bytes(part.column(2)), width)
            begin = np.concatenate([[0], ends[:-1]])
            values = minima(sets, ends)
            view = memoryview(sets.view(np.uint8)) if len(sets) else b""
            hashes = [blake2b(view[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(begin.tolist(), ends.tolist())]
            sig, keys = packed(values), band_keys(values, rows)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ends - begin), pa.array(hashes, pa.binary()), *(pa.array(np.ascontiguousarray(sig[:, i])) for i in range(WORDS)), bands], ["doc_id", "text_key", "n_shingles", "set_hash", *_SIG, "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key long, n_shingles long, set_hash binary, {', '.join(f'{s} long' for s in _SIG)}, bands array<long>"
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").transform(arrow_map, run, schema)


def estimate(left: str, right: str):
    """Collision-corrected similarity from the packed bits of two nodes."""
    differ = F.lit(0)
    for s in _SIG:
        x = F.col(f"{left}{s}").bitwiseXOR(F.col(f"{right}{s}"))
        for shift in (1 << i for i in range(BITS.bit_length() - 1)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(sum(1 << i for i in range(0, 64, BITS))).cast("long")))
    chance = 2.0**-BITS
    return (1 - differ / float(HASHES) - chance) / (1 - chance)


def _confirm(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (node, pivot) whose full sets have a similarity of ``percent`` at least.

    A pivot and the nodes to be compared with it meet in one stream, pivot
    first; a pivot with many nodes is repeated as :func:`salts` says.
    """
    counts = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    pivots = counts.select("pivot", salts(F.col("n")).alias("salts"))
    members = keyed_join(pairs, pivots, ["pivot"], hot_keys(counts, ["pivot"])).select("pivot", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), "node")
    pivots = pivots.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("pivot").alias("node"))
    wanted = staged(members.union(pivots).join(nodes.select("node", F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"), "set_hash"), "node"), "wanted")
    if fits_broadcast(wanted, BROADCAST_ROWS):
        wanted = F.broadcast(wanted)
    text = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = text.join(wanted, (F.col("text_key") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("pivot", "salt", "role", "node", "set_hash", "text")

    def run(batches):
        now, pivot_set = None, None
        for part in slices(batches, "text"):
            sets, ends = shingle_sets(*text_bytes(part.column(5)), width)
            out_node, out_pivot = [], []
            begin = 0
            for pivot, salt, role, node, want, end in zip(*(part.column(i).to_pylist() for i in range(5)), ends.tolist()):
                own, begin = sets[begin:end], end
                if blake2b(own.tobytes(), digest_size=16).digest() != want:
                    continue  # another text under the same id and key
                if role == 0:
                    now, pivot_set = (pivot, salt), own.copy()
                    continue
                if now != (pivot, salt):
                    raise ValueError("a pivot's text is missing")
                both = len(np.intersect1d(own, pivot_set, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(pivot_set) - both):
                    out_node.append(node)
                    out_pivot.append(pivot)
            yield pa.RecordBatch.from_arrays([pa.array(out_node, pa.int64()), pa.array(out_pivot, pa.int64())], ["node", "pivot"])

    ordered = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role")
    return ordered.transform(arrow_map, run, "node long, pivot long")


def _with_signature(pairs: DataFrame, nodes: DataFrame, column: str, prefix: str, hot: DataFrame | None = None) -> DataFrame:
    sig = nodes.select(F.col("node").alias(column), *(F.col(s).alias(prefix + s) for s in _SIG))
    return keyed_join(pairs, sig, [column], hot)


def _star(nodes: DataFrame, buckets: DataFrame, least: float) -> DataFrame:
    """(node, pivot): each node with a pivot of each of its buckets, estimated
    near enough.  The pivot is the node whose buckets are largest in all: in a
    group of near copies, the text that most of them come from."""
    large = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hot = hot_keys(large, ["key"])
    met = staged(keyed_join(buckets, large, ["key"], hot), "met")
    weight = met.groupBy("node").agg(F.sum("n").alias("met"))
    pivot = met.join(weight, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("best")).select("key", F.col("best.node").alias("pivot"))
    pairs = staged(keyed_join(met.select("key", "node"), pivot, ["key"], hot).filter("node <> pivot").select("node", "pivot").distinct(), "met-pivots")
    hot = hot_keys(pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")), ["pivot"])
    pairs = _with_signature(_with_signature(pairs, nodes, "pivot", "b_", hot), nodes, "node", "a_")
    return pairs.filter(estimate("a_", "b_") >= least).select("node", "pivot")


def _mixed(nodes: DataFrame, buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, node, component, n) of buckets that still hold more than one component."""
    placed = buckets.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key", "n")
    return keyed_join(placed, mixed, ["key"], hot_keys(mixed, ["key"])).select("key", "node", "component", "n")


def _small_pairs(nodes: DataFrame, mixed: DataFrame, tested: DataFrame, least: float) -> DataFrame:
    """(node, pivot): pairs of small buckets in different components, estimated
    near enough and not tested yet."""
    rows = _with_signature(mixed.filter(F.col("n") <= SMALL_BUCKET), nodes, "node", "")
    left = rows.select("key", F.col("node").alias("a"), F.col("component").alias("a_comp"), *(F.col(s).alias("a_" + s) for s in _SIG))
    right = rows.select(F.col("key").alias("r_key"), F.col("node").alias("b"), F.col("component").alias("b_comp"), *(F.col(s).alias("b_" + s) for s in _SIG))
    near = (F.col("a_comp") != F.col("b_comp")) & (F.col("a") < F.col("b")) & (estimate("a_", "b_") >= least)
    met = left.join(right, (F.col("key") == F.col("r_key")) & near)
    return met.select(F.col("b").alias("node"), F.col("a").alias("pivot")).distinct().join(tested, ["node", "pivot"], "left_anti")


def _large_links(docs: DataFrame, nodes: DataFrame, mixed: DataFrame, width: int, percent: int, least: float) -> DataFrame:
    """(node, pivot): links found in large buckets, enough of them to join what belongs together.

    A bucket's nodes are dealt into blocks, and each two blocks meet in one
    task with their texts: pairs in different components that are estimated
    near enough are counted on their full sets there, each pair in the first
    bucket that holds both.  Pairs never leave the task, only links that join
    components not joined yet.
    """
    large = mixed.filter(F.col("n") > SMALL_BUCKET)
    wanted = staged(large.select("node").distinct().join(nodes.select("node", F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"), "set_hash", "n_shingles", "bands", *_SIG), "node"), "large")
    found = F.broadcast(wanted.select("node", "w_id", "w_key")) if fits_broadcast(wanted, BROADCAST_ROWS) else wanted.select("node", "w_id", "w_key")
    text = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(found, (F.col("text_key") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("node", "text")
    full = staged(wanted.drop("w_id", "w_key", "n_shingles").join(text, "node").dropDuplicates(["node"]), "texts")
    # the largest component's nodes needn't meet each other: they are dealt into blocks after all others
    sized = large.join(wanted.select("node", "n_shingles"), "node")
    shares = sized.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n_shingles").alias("s"), F.first("n").alias("n"))
    major = shares.groupBy("key").agg(F.max(F.struct("k", "component", "s")).alias("m"), F.first("n").alias("n"), F.sum("s").alias("s"))

    def blocks(nodes_in, shingles_in):
        return F.ceil(F.greatest(nodes_in / NODES_A_BLOCK, shingles_in / SHINGLES_A_BLOCK)).cast("int")

    major = major.select("key", F.col("m.component").alias("major"), blocks(F.col("n") - F.col("m.k"), F.col("s") - F.col("m.s")).alias("others"), blocks(F.col("m.k"), F.col("m.s")).alias("majors"))
    placed = large.drop("n").join(F.broadcast(major) if fits_broadcast(major, BROADCAST_ROWS) else major, "key").withColumn("in_major", F.col("component") == F.col("major"))
    own = F.when(F.col("in_major"), F.col("others") + F.pmod(F.xxhash64("node"), F.col("majors"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others")))
    placed = placed.withColumn("block", own.cast("int"))
    last = F.when(F.col("in_major"), F.col("others") - 1).otherwise(F.col("others") + F.col("majors") - 1)
    meets = F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    rows = placed.withColumn("meet", F.explode(meets)).join(full, "node")
    rows = rows.select("key", F.col("meet.i").alias("i"), F.col("meet.j").alias("j"), "block", "node", "component", "set_hash", F.array(*_SIG).alias("sig"), "bands", "text")
    percent_least = (percent, least)

    def run(batches):
        task: tuple | None = None
        held: list = []
        for part in slices(batches, "text"):
            sets, ends = shingle_sets(*text_bytes(part.column(9)), width)
            cols = [part.column(c).to_pylist() for c in range(9)]
            begin = 0
            for k, end in enumerate(ends.tolist()):
                own, begin = sets[begin:end], end
                now = (cols[0][k], cols[1][k], cols[2][k])
                if now != task:
                    if held:
                        yield _links(held, task, *percent_least)
                    task, held = now, []
                if blake2b(own.tobytes(), digest_size=16).digest() == cols[6][k]:
                    held.append((cols[3][k], cols[4][k], cols[5][k], cols[7][k], cols[8][k], own.copy()))
        if held:
            yield _links(held, task, *percent_least)

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").transform(arrow_map, run, "node long, pivot long").distinct()


def _links(held: list, task: tuple, percent: int, least: float) -> pa.RecordBatch:
    """Links between the two blocks of one task, or within its one block."""
    key, i, j = task
    left = [r for r in held if r[0] == i]
    right = [r for r in held if r[0] == j]
    bands = np.array([r[4] for r in right], np.int64).reshape(len(right), -1)
    sig = np.array([r[3] for r in right], np.int64).reshape(len(right), WORDS).view(np.uint64)
    comp = np.array([r[2] for r in right], np.int64)
    node = np.array([r[1] for r in right], np.int64)
    size = np.array([len(r[5]) for r in right], np.int64)
    values, place = np.unique(np.concatenate([r[5] for r in held]), return_inverse=True)
    at = np.cumsum([0] + [len(r[5]) for r in held])
    ids = [place[at[k] : at[k + 1]] for k in range(len(held))]
    left_ids = [ids[k] for k, r in enumerate(held) if r[0] == i]
    all_right = np.concatenate([ids[k] for k, r in enumerate(held) if r[0] == j]) if right else np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    mask = np.uint64(sum(1 << b for b in range(0, 64, BITS)))
    chance = 2.0**-BITS
    out: list[tuple[int, int]] = []
    flag = np.zeros(len(values), np.int64)
    for k, (_, own, c, s, bd, shingles) in enumerate(left):
        x = sig ^ np.array(s, np.int64).view(np.uint64)
        for shift in (1 << b for b in range(BITS.bit_length() - 1)):
            x |= x >> np.uint64(shift)
        differ = np.bitwise_count(x & mask).sum(1)
        near = ((1 - differ / HASHES - chance) / (1 - chance) >= least) & (comp != c)
        if i == j:
            near &= node > own
        some = np.flatnonzero(near)
        if len(some):  # only in the first bucket that both are in
            same = bands[some] == np.array(bd, np.int64)
            some = some[bands[some, same.argmax(1)] == key]
        some = np.array([t for t in some.tolist() if find(int(comp[t])) != find(c)], np.int64)
        if not len(some):
            continue
        flag[left_ids[k]] = 1
        both = np.add.reduceat(flag[all_right], first) if len(all_right) else np.zeros(len(right), np.int64)
        flag[left_ids[k]] = 0
        linked = some[100 * both[some] >= percent * (len(shingles) + size[some] - both[some])]
        for t in linked.tolist():
            a, b = find(c), find(int(comp[t]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((max(own, int(node[t])), min(own, int(node[t]))))
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["node", "pivot"])


def _components(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(signatures of (doc_id, text), nodes with their component and least row)."""
    threshold, since = percent / 100, staged_so_far(docs.sparkSession)
    sig = staged(signatures(docs, words, rows_a_band(threshold)), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("rep")
    nodes = sig.filter("n_shingles > 0").groupBy("set_hash").agg(first, *(F.first(c).alias(c) for c in ["n_shingles", *_SIG, "bands"]), F.count(F.lit(1)).alias("n_rows"))
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("node"), F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_key").alias("text_key"), "set_hash", "n_shingles", "n_rows", *_SIG, "bands"), "nodes")
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    least = lowest_estimate(threshold)
    star = staged(_star(nodes, buckets, least), "star")
    links = staged(_confirm(docs, nodes, star, words, percent), "links")
    comps = staged(components(links, "node", "pivot"), "components")
    mixed = staged(_mixed(nodes, buckets, comps), "mixed")
    if mixed.filter(F.col("n") > SMALL_BUCKET).head(1):
        links = links.unionByName(staged(_large_links(docs, nodes, mixed, words, percent, least), "large-links"))
    rest = staged(_small_pairs(nodes, mixed, star, least), "residual")
    if rest.head(1):
        links = links.unionByName(_confirm(docs, nodes, rest, words, percent))
    comps = staged(components(links, "node", "pivot"), "components")
    clear_scratch(docs.sparkSession, since, [sig, nodes, comps])
    named = nodes.select("node", "doc_id", "text_key", "set_hash", "n_rows").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return sig, named


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a
    document's set holds its distinct shingles of ``words`` words, or its whole
    sequence where it has fewer.  Sets with ``100 * intersection >= percent *
    union`` are linked; a component is what links reach, and its id the
    smallest document id in it (null where it has none).  ``kept`` is whether
    the row has that id.  Null or empty texts link with nothing.  Repeated rows
    share their node.  An empty table gives an empty result; other columns are
    not read.  ``docs`` is read again to confirm pairs, so it should be stored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sig, named = _components(docs, words, percent)
    ids = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    hot = hot_keys(named.select("set_hash", F.col("n_rows").alias("n")), ["set_hash"])
    named = keyed_join(named, ids, ["component"], hot_keys(ids, ["component"])).select("set_hash", "component_id")
    linked = keyed_join(sig.filter("n_shingles > 0"), named, ["set_hash"], hot).select("doc_id", "n_shingles", "component_id")
    alone = sig.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, all columns kept.

    The row with the least id stays, null ids last, and of rows that share it
    the one with the least hash of its text; of rows that share both one stays.
    Rows without words are in no component and all stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sig, named = _components(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")), words, percent)
    rep_id, rep_key, worded, key = own_names("id", "rep_key", "worded", "key")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("rep")
    reps = named.groupBy("component").agg(least).select(F.col("rep.doc_id").alias(rep_id), F.col("rep.text_key").alias(rep_key), F.lit(True).alias(worded))
    alone = sig.filter("n_shingles = 0").select(F.col("doc_id").alias(rep_id), F.col("text_key").alias(rep_key), F.lit(False).alias(worded)).distinct()
    found = docs.withColumn(key, F.xxhash64(text)).join(reps.union(alone), F.col(id_col).eqNullSafe(F.col(rep_id)) & (F.col(key) == F.col(rep_key)))
    if sig.filter("n_shingles > 0").groupBy("doc_id", "text_key").count().filter("count > 1").head(1):
        found = found.filter(F.col(worded)).dropDuplicates([id_col, key]).union(found.filter(~F.col(worded)))
    return found.select(*docs.columns)
