"""Candidate rules from triples (head, relation, tail)."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.hubs import HUB_ROWS, hubs_at, met
from weft.scratch import written


def _score(n: str, of: str):
    return F.log(F.col(n) / F.col(of))


def links(triples: DataFrame) -> DataFrame:
    """(loop, links, pairs): how many pairs of entities have the same triples
    between them.  ``links`` has (up, relation, k): k triples of a relation, up
    from the entity first by name to the other; loops are one entity's own.
    Its length is twice the number of relations at most.  Triples move once, to
    their pair, and are counted there; then only different lists are shuffled."""
    t = triples.filter("head is not null AND tail is not null")
    rows = t.select(F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b"), (F.col("head") <= F.col("tail")).alias("up"), "relation")
    k = rows.repartition("a", "b").groupBy("a", "b", "up", "relation").agg(F.count(F.lit(1)).alias("k"))
    lists = k.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("up", "relation", "k"))).alias("links"))
    several = F.col("loop") | (F.size("links") > 1)  # a link alone, but for a loop's, has nothing to meet
    return lists.select((F.col("a") == F.col("b")).alias("loop"), "links").filter(several).groupBy("loop", "links").agg(F.count(F.lit(1)).alias("pairs"))


def _meetings(found: DataFrame, when: str) -> DataFrame:
    """(p, q, n): how many triples of p meet ones of q, over the two links of a pair."""
    both = found.select("loop", "pairs", F.explode("links").alias("a"), "links").select("loop", "pairs", "a", F.explode("links").alias("b")).filter(when)
    return both.groupBy(F.col("a.relation").alias("p"), F.col("b.relation").alias("q")).agg(F.sum(F.col("pairs") * F.col("a.k") * F.col("b.k")).alias("n"))


def entailments(triples: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(p, q, n, score): pairs of relations between the same two entities,
    counted, against the number of q's triples.  ``found`` are the triples'
    :func:`links`, where they are stored."""
    return _scored(_meetings(links(triples) if found is None else found, "a.up = b.up AND a.relation <> b.relation"), triples)


def inversions(triples: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(p, q, n, score): p from head to tail where q runs back; p may be q."""
    return _scored(_meetings(links(triples) if found is None else found, "loop OR a.up <> b.up"), triples)


def _scored(n: DataFrame, triples: DataFrame) -> DataFrame:
    of = triples.groupBy(F.col("relation").alias("q")).agg(F.count(F.lit(1)).alias("of"))
    return n.join(of, "q").select("p", "q", "n", _score("n", "of").alias("score"))


def _named_edges(triples: DataFrame) -> DataFrame:
    """(a, b, ab, ba): entities that triples link, each pair once, with the
    relations from the one to the other and back.  The lists are as long as
    there are relations at most."""
    up = F.col("head") < F.col("tail")
    pairs = triples.filter("head <> tail").select(F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b"), F.when(up, F.col("relation")).alias("ab"), F.when(~up, F.col("relation")).alias("ba"))
    return pairs.groupBy("a", "b").agg(F.collect_set("ab").alias("ab"), F.collect_set("ba").alias("ba"))


def oriented(edges: DataFrame, hub_rows: int = HUB_ROWS) -> DataFrame:
    """(u, v, rank, out, back): each edge from the entity with fewer edges to
    that with more, ties by name; ``rank`` is v's place in that order.  No
    entity has over sqrt(2m) of m edges going out."""
    ends = edges.select(F.col("a").alias("at")).union(edges.select(F.col("b").alias("at")))
    hubs = hubs_at(ends, ["at"], hub_rows)["at"]
    degrees = written(ends.groupBy("at").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    for end in ("a", "b"):
        edges = met(edges, degrees.select(F.col("at").alias(end), F.col("degree").alias(f"of_{end}")), end, hubs, {}, hub_rows)
    a, b = F.struct(F.col("of_a").alias("degree"), F.col("a").alias("at")), F.struct(F.col("of_b").alias("degree"), F.col("b").alias("at"))
    rows = edges.select(F.when(a < b, F.struct(F.col("a").alias("u"), F.col("b").alias("v"), b.alias("rank"), F.col("ab").alias("out"), F.col("ba").alias("back"))).otherwise(F.struct(F.col("b").alias("u"), F.col("a").alias("v"), a.alias("rank"), F.col("ba").alias("out"), F.col("ab").alias("back"))).alias("e"))
    return written(rows.select("e.*"), "oriented")


def wedges(edges: DataFrame) -> DataFrame:
    """Two edges out of one entity, from :func:`oriented` ones: at most m * sqrt(2m)."""
    one = edges.select("u", "v", F.col("rank").alias("rank_v"), F.col("out").alias("uv"), F.col("back").alias("vu"))
    two = edges.select("u", F.col("v").alias("w"), F.col("rank").alias("rank_w"), F.col("out").alias("uw"), F.col("back").alias("wu"))
    return one.join(two, "u").filter("rank_v < rank_w").drop("rank_v", "rank_w")


def _closed(edges: DataFrame, hub_rows: int) -> DataFrame:
    """(x, y, p, q, r) with lists of relations: p from x to y, q from x to
    another entity, r from there to y."""
    pair = F.struct(F.col("v").alias("v"), F.col("w").alias("w"))
    open_ = wedges(edges).withColumn("pair", pair).drop("v", "w")
    third = edges.select(F.struct(F.col("u").alias("v"), F.col("v").alias("w")).alias("pair"), F.col("out").alias("vw"), F.col("back").alias("wv"))
    full = met(open_, third, "pair", hubs_at(open_, ["pair"], hub_rows)["pair"], {}, hub_rows)
    at = {"u": F.col("u"), "v": F.col("pair.v"), "w": F.col("pair.w")}
    roles = [F.struct(at[x].alias("x"), at[y].alias("y"), F.col(x + y).alias("p"), F.col(x + z).alias("q"), F.col(z + y).alias("r")) for x, y, z in permutations("uvw")]
    return full.select(F.explode(F.array(*roles)).alias("t")).select("t.*").filter("size(p) > 0 AND size(q) > 0 AND size(r) > 0")


def _with_loops(triples: DataFrame, edges: DataFrame, hub_rows: int) -> DataFrame:
    """The same, where two or all of the three entities are one."""
    loops = triples.filter("head = tail").groupBy(F.col("head").alias("x")).agg(F.collect_set("relation").alias("own"))
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("ab").alias("out"), F.col("ba").alias("back"))
    both = both.union(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), F.col("ba").alias("out"), F.col("ab").alias("back")))
    found = met(both, loops, "x", hubs_at(both, ["x"], hub_rows)["x"], {}, hub_rows)

    def as_(x: str, y: str, p: str, q: str, r: str) -> DataFrame:
        return found.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(p).alias("p"), F.col(q).alias("q"), F.col(r).alias("r"))

    once = as_("x", "y", "out", "own", "out").union(as_("y", "x", "back", "back", "own")).union(as_("x", "x", "own", "out", "back"))
    every = loops.select("x", F.col("x").alias("y"), F.col("own").alias("p"), F.col("own").alias("q"), F.col("own").alias("r"))
    return once.union(every)


def chains(triples: DataFrame, hub_rows: int = HUB_ROWS) -> DataFrame:
    """(p, q, r, n, score): p(X,Y) where q(X,Z) and r(Z,Y); distinct (X,Y)
    against all paths of q and r.  Triples with a null are left out.

    Paths are counted from degrees, never made.  What p closes is a triangle,
    and all triangles are listed from their entity with the fewest edges: for m
    linked pairs that makes m * sqrt(2m) rows at most, whatever the hubs.
    Relations that no chain can hold, by common heads and tails, are left out.
    """
    return _chains(written(triples.select("head", "relation", "tail").dropna(), "triples"), hub_rows)


def _chains(triples: DataFrame, hub_rows: int = HUB_ROWS) -> DataFrame:
    """The same, of stored triples without nulls."""
    heads = written(triples.groupBy("head", "relation").agg(F.count(F.lit(1)).alias("k")), "heads")
    tails = written(triples.groupBy("tail", "relation").agg(F.count(F.lit(1)).alias("k")), "tails")

    def meeting(a: DataFrame, b: DataFrame, on: str, to: str, first: str, second: str) -> DataFrame:
        """(first, second, n): relations that meet, and how many rows do."""
        a = a.select(F.col(on).alias("at"), F.col("relation").alias(first), "k")
        b = b.select(F.col(to).alias("at"), F.col("relation").alias(second), F.col("k").alias("k2"))
        return a.join(b, "at").groupBy(first, second).agg(F.sum(F.col("k") * F.col("k2")).alias("n"))

    of = written(meeting(tails, heads, "tail", "head", "q", "r").withColumnRenamed("n", "of"), "paths")
    can = of.join(meeting(heads, heads, "head", "head", "p", "q").drop("n"), "q").join(meeting(tails, tails, "tail", "tail", "p", "r").drop("n"), ["p", "r"])
    used = written(can.select(F.explode(F.array("p", "q", "r")).alias("relation")).distinct(), "used")
    kept = triples.join(used, "relation", "left_semi")
    edges = written(_named_edges(kept), "edges")
    found = _closed(oriented(edges, hub_rows), hub_rows).union(_with_loops(kept, edges, hub_rows))
    for c in "pqr":
        found = found.withColumn(c, F.explode(c))
    n = found.distinct().groupBy("p", "q", "r").agg(F.count(F.lit(1)).alias("n"))
    return n.join(of, ["q", "r"]).select("p", "q", "r", "n", _score("n", "of").alias("score"))


def rule_text(triples: DataFrame) -> DataFrame:
    """(value): rules of all three kinds, each with its score as a comment."""
    triples = written(triples.select("head", "relation", "tail"), "triples")
    found = written(links(triples), "links")
    e = entailments(triples, found).select(F.format_string("%s(X,Y):-%s(X,Y) {if_%s_%s}.\t#score %.3f", "p", "q", "p", "q", "score").alias("value"))
    i = inversions(triples, found).select(F.format_string("%s(X,Y):-%s(Y,X) {ifInv_%s_%s}.\t#score %.3f", "p", "q", "p", "q", "score").alias("value"))
    c = _chains(triples.dropna()).select(F.format_string("%s(X,Y):-%s(X,Z),%s(Z,Y) {chain_%s_%s_%s}.\t#score %.3f", "p", "q", "r", "p", "q", "r", "score").alias("value"))
    return e.union(i).union(c)
