"""Merkle manifest of a dataset, with a proof for each row.

Rows are leaves in groups; within a group they stand in order, and while there
are several nodes each ARITY consecutive ones become their digest.  What is
left of the groups is put together in the same way.

Trees grow by events: a node that comes in is put with its parent's children,
and the parent, once it has as many as its place and its level's size call for,
is a node that comes in itself.  Tasks take stretches of leaves in order, so
nearly all parents are complete within one; the children of those that aren't,
a task's frontier, meet again by stretches of the frontier, until each group has
one node.  A round keeps which stretch each of its nodes came from.  Proofs go
these links back: a stretch takes the siblings above its frontier, builds its
trees again and hands each of its own nodes the siblings on the way up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weft.llm.shared import arrow_map, clear_scratch, fits_broadcast, staged, staged_so_far

ARITY = 2
#: Leaves of a stretch, and how many times as many leaves a stretch of the next round spans.
LEAVES_A_STRETCH, WIDER = 1 << 14, 1 << 10
#: Offsets of so many stretches are broadcast, if they have few bytes too.
BROADCAST_ROWS = 250_000


def node_digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


class Trees:
    """Partial trees of one task: (group, level, index) to a digest.

    A group's ``size`` is its number of leaves, from which each level's size
    follows, and so how many children a parent waits for.
    """

    def __init__(self) -> None:
        self.waiting: dict[tuple, dict[int, str]] = {}
        self.done: dict[tuple, str] = {}  # resolved parents
        self.sizes: dict = {}

    def level_size(self, group, level: int) -> int:
        n = self.sizes[group]
        for _ in range(level):
            n = -(-n // ARITY)
        return n

    def add(self, group, size: int, level: int, index: int, digest: str) -> None:
        """A node comes in; its parent may be complete then, and so on upwards."""
        self.sizes[group] = size
        here = self.level_size(group, level)
        while here > 1:
            parent = index // ARITY
            held = self.waiting.setdefault((group, level + 1, parent), {})
            held[index] = digest
            if len(held) < min(ARITY, here - ARITY * parent):
                return
            level, index, here = level + 1, parent, -(-here // ARITY)
            digest = node_digest([held[i] for i in sorted(held)])
            self.done[(group, level, index)] = digest
        self.waiting.setdefault((group, level + 1, 0), {})[index] = digest  # the group's last node

    def frontier(self) -> Iterator[tuple]:
        """(group, level, index, digest) of the nodes whose parent isn't complete here."""
        for (group, level, parent), held in self.waiting.items():
            if (group, level, parent) not in self.done:
                for index, digest in held.items():
                    yield group, level - 1, index, digest

    def siblings(self, group, level: int, index: int, above: dict[tuple, str]) -> str:
        """The digests beside a node's way up, to the frontier by what stands here and from there on by ``above``."""
        out = []
        while (group, level, index) not in above:
            parent = index // ARITY
            held = self.waiting[(group, level + 1, parent)]
            out += [held[i] for i in sorted(held) if i != index]
            level, index = level + 1, parent
        return "".join(out) + above[(group, level, index)]


# -- rounds --------------------------------------------------------------------

#: ``stretch`` is where a node comes in, ``origin`` the stretch of the round before whose frontier it was.
NODE = "stretch long, group long, size long, level int, index long, digest string, origin long"
_NODE_NAMES = [c.split()[0] for c in NODE.split(", ")]
_NODE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
BESIDE = "origin long, group long, level int, index long, siblings string"
_BESIDE_NAMES = [c.split()[0] for c in BESIDE.split(", ")]
_BESIDE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]


def _batches(rows: Iterator[tuple], types: list, names: list[str], most: int = 4096):
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names)


def _by_stretch(batches) -> Iterator[tuple[int, list[tuple]]]:
    """(stretch, its rows), from rows that come sorted by it, their first column."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != now and held:
                yield now, held
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield now, held


def _grown(rows: list[tuple]) -> tuple[Trees, dict[tuple, str]]:
    """The trees of a stretch's nodes, and what stands above its frontier."""
    trees, above = Trees(), {}
    for _, group, size, level, index, digest, _, siblings in rows:
        if siblings is not None:
            above[(group, level, index)] = siblings
        else:
            trees.add(group, size, level, index, digest)
    return trees, above


def _fold(batches):
    """The frontier of each stretch, its own number as ``origin``."""

    def rows():
        for stretch, nodes in _by_stretch(batches):
            trees = Trees()
            for _, group, size, level, index, digest in nodes:
                trees.add(group, size, level, index, digest)
            for group, level, index, digest in trees.frontier():
                yield None, group, trees.sizes[group], level, index, digest, stretch

    yield from _batches(rows(), _NODE_TYPES, _NODE_NAMES)


def _climb(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(the nodes that came into each round, the nodes that are left: one a group)."""
    rounds, span = [leaves], LEAVES_A_STRETCH
    while True:
        nodes = rounds[-1].select(*_NODE_NAMES[:6]).repartition("stretch").sortWithinPartitions("stretch", "group", "level", "index")
        front = staged(nodes.transform(arrow_map, _fold, NODE), "frontier")
        if not front.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").head(1):
            return rounds, front
        span *= WIDER
        first_leaf = F.col("index") * F.pow(F.lit(float(ARITY)), "level")
        rounds.append(front.withColumn("stretch", F.xxhash64("group", F.floor(first_leaf / span))))


def _with_above(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes of a round, and with them the siblings above their stretches' frontiers."""
    none = F.lit(None)
    down = above.select(F.col("origin").alias("stretch"), "group", none.cast("long").alias("size"), "level", "index", none.cast("string").alias("digest"), none.cast("long").alias("origin"), "siblings")
    both = nodes.withColumn("siblings", none.cast("string")).unionByName(down, allowMissingColumns=True)
    return both.repartition("stretch").sortWithinPartitions("stretch", "group", "level", "index")


def _hand_down(batches):
    """From a stretch's nodes and the siblings above its frontier to the siblings of each node."""

    def rows():
        for _, nodes in _by_stretch(batches):
            trees, above = _grown(nodes)
            for _, group, _, level, index, _, origin, siblings in nodes:
                if siblings is None:
                    yield origin, group, level, index, trees.siblings(group, level, index, above)

    yield from _batches(rows(), _BESIDE_TYPES, _BESIDE_NAMES)


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """From what stands above the last frontier to what stands above the first round's, by the links back."""
    for nodes in reversed(rounds):
        above = staged(_with_above(nodes.select(*_NODE_NAMES), above).transform(arrow_map, _hand_down, BESIDE), "siblings")
    return above


# -- the operator --------------------------------------------------------------


def field(value: Column) -> Column:
    """A value as it goes into a leaf: ``-`` if null, else its bytes in UTF-8, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def fold(digest: str, index: int, size: int, siblings: str) -> tuple[str, str]:
    """(root over a node's digest, siblings that are left), from the digests
    beside its way up, level by level and left to right."""
    while size > 1:
        first = ARITY * (index // ARITY)
        others = min(ARITY, size - first) - 1
        beside = [siblings[64 * i : 64 * (i + 1)] for i in range(others)]
        siblings = siblings[64 * others :]
        digest = node_digest([*beside[: index - first], digest, *beside[index - first :]])
        index, size = index // ARITY, -(-size // ARITY)
    return digest, siblings


def _numbered(batches):
    """Rows, sorted by group (their first column), with the number of their stretch
    and their place among the stretch's rows of the group."""
    part, seen, now, n = TaskContext.get().partitionId(), 0, None, 0
    for batch in batches:
        stretches, places = [], []
        for group in batch.column(0).to_pylist():
            if seen % LEAVES_A_STRETCH == 0 or group != now:
                n = 0
            stretches.append(part << 32 | seen // LEAVES_A_STRETCH)
            places.append(n)
            now, n, seen = group, n + 1, seen + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stretches, pa.int64()), pa.array(places, pa.int64())], [*batch.schema.names, "stretch", "place"])


def _in_order(rows: DataFrame, by: list[str], schema: str) -> DataFrame:
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return staged(ordered.transform(arrow_map, _numbered, f"{schema}, stretch long, place long"), "in-order")


def _offsets(rows: DataFrame, group: str) -> DataFrame:
    """(stretch, group, before, size): the rows of a group before a stretch, and all of them."""
    counts = rows.groupBy("stretch", group).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy(group)
    before = F.sum("n").over(within.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("stretch", group, F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(within).alias("size"))


def _answers(root: str, n_groups: int, id_type: pa.DataType):
    """Proofs and folded roots of a stretch's leaves."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    types = [id_type, *[pa.string()] * 5, pa.bool_()]

    def run(batches):
        def rows():
            for _, nodes in _by_stretch(batches):
                trees, above = _grown([r[:8] for r in nodes])
                for _, group, size, _, index, leaf, _, siblings, doc_id, changed in nodes:
                    if siblings is not None:
                        continue
                    beside = trees.siblings(group, 0, index, above)
                    subroot, rest = fold(leaf, index, size, beside)
                    folded = fold(subroot if changed == leaf else fold(changed, index, size, beside)[0], group, n_groups, rest)[0]
                    yield doc_id, leaf, subroot, root, hashlib.sha256(beside.encode()).hexdigest(), folded, folded == root

        yield from _batches(rows(), types, names)

    return run


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tamper_col: str = "n_chars", tamper_every: int = 7) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of the row's ``fields``.  Groups' leaves ascend by id,
    null first; of rows that share an id the one with the least leaf comes
    first, and rows that are the same throughout stand in no fixed order but
    with different places, so different proofs.  Subroots ascend by group, null
    first, bytewise.  ``proof_sha256`` is the digest of the siblings on the way
    up.  Where ``tamper_every`` divides the CRC-32 of an id, ``folded_root`` is
    folded from the leaf that the row would have with one more in
    ``tamper_col`` (null stays null, so does a row with a null id); elsewhere
    from its own.  An empty table gives an empty result; columns outside
    ``fields`` are not read.
    """
    spark = docs.sparkSession
    since = staged_so_far(spark)
    tampered = F.crc32(F.col(id_col).cast("string").cast("binary")) % tamper_every == 0
    changed = leaf_digest([F.col(c) + 1 if c == tamper_col else F.col(c) for c in fields])
    leaf = leaf_digest([F.col(c) for c in fields])
    base = docs.select(F.col(group_col).cast("string").alias("name"), F.col(id_col).alias("doc_id"), leaf.alias("leaf"), F.when(tampered, changed).otherwise(leaf).alias("changed"), F.monotonically_increasing_id().alias("row"))
    id_kind = docs.schema[id_col].dataType
    rows = _in_order(staged(base, "digests"), ["name", "doc_id", "leaf", "row"], f"name string, doc_id {id_kind.simpleString()}, leaf string, changed string, row long")
    offsets = staged(_offsets(rows, "name"), "offsets")
    groups = _in_order(offsets.groupBy("name").agg(F.first("size").alias("size")).select(F.lit(0).alias("all"), "name", "size"), ["all", "name"], "all int, name string, size long")
    n_groups = groups.count()
    if not n_groups:
        return docs.select(F.col(id_col).alias("doc_id"), *(F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), F.lit(True).alias("verified")).limit(0)
    places = groups.join(_offsets(groups, "all"), "stretch").select("name", (F.col("before") + F.col("place")).alias("group"))
    offsets = staged(offsets.join(places.withColumnRenamed("name", "g_name"), F.col("name").eqNullSafe(F.col("g_name"))).select(F.col("stretch").alias("o_stretch"), "g_name", "group", "before", "size"), "places")
    listed = F.broadcast(offsets) if fits_broadcast(offsets, BROADCAST_ROWS) else offsets
    found = rows.join(listed, (F.col("stretch") == F.col("o_stretch")) & F.col("name").eqNullSafe(F.col("g_name")))
    leaves = staged(found.select("stretch", "group", "size", F.lit(0).alias("level"), (F.col("before") + F.col("place")).alias("index"), F.col("leaf").alias("digest"), F.lit(None).cast("long").alias("origin"), "doc_id", "changed"), "leaves")
    rounds, subroots = _climb(leaves)
    tops = subroots.select(F.xxhash64(F.floor(F.col("group") / LEAVES_A_STRETCH)).alias("stretch"), F.lit(0).cast("long").alias("group"), F.lit(n_groups).cast("long").alias("size"), F.lit(0).alias("level"), F.col("group").alias("index"), "digest", F.lit(None).cast("long").alias("origin"))
    top_rounds, top = _climb(staged(tops, "subroots"))
    root = top.first().digest
    beside = _descend(top_rounds, top.select("origin", "group", "level", "index", F.lit("").alias("siblings"))).select(F.col("index").alias("group"), "siblings")
    above = staged(_descend(rounds[1:], subroots.join(beside, "group").select("origin", "group", "level", "index", "siblings")), "above")
    joined = _with_above(leaves, above).select(*_NODE_NAMES, "siblings", "doc_id", "changed")
    out = joined.transform(arrow_map, _answers(root, n_groups, to_arrow_type(id_kind)), f"doc_id {id_kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    clear_scratch(spark, since, [leaves, above])
    return out
