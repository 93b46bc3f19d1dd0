"""A logical plan as lazy DataFrames.

A message is (qid, id, w), unique on (qid, id); one that doesn't depend on the
query is (id, w).  Relations are (src, dst, w) and (id, w).  What runs here: a
count of rows and symbols where an order is to be chosen, tables of called
predicates, and very deep plans, whose levels are written out every CUT steps
so that no level recomputes the ones below it.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.hubs import HUB_ROWS, Rows, hubs_at, met, promised_bytes
from weft.plans.nodes import Node, in_order
from weft.plans.order import DOUBLED_FROM, TABLE_GAIN, Size, Tree, best_order, doubled_cost, joined, shown, unrolled_cost
from weft.plans.planner import Linear, Program
from weft.plans.terms import Mode
from weft.scratch import written

#: Steps of a recursive plan that stay lazy.
CUT = 5
#: Estimated bytes of a batch up to which relations are cut to its symbols first.
SMALL_BATCH = 1 << 20
#: Symbols of a unary relation up to which facts are cut to those that end at them, before a step that only it filters.
FEW_SYMBOLS = 200_000
#: Rows by estimate, and times the message's, from which on a step's message is written first, so that queries with one symbol need no sum.
LARGE_STEP, LARGE_GAIN = 1e7, 8.0
#: Rows by estimate that a task of such a step makes, and the most tasks.
ROWS_A_TASK, MOST_TASKS = 2e6, 10_000
#: Facts by estimate up to which such a step's relation goes to every task, so that the message alone is dealt out.
SMALL_FACTS = 500_000
#: Estimated bytes of a table up to which it goes to every task, and the share of a step's rows that its sum leaves from which on it isn't worth a shuffle of its own.
SMALL_TABLE, FEW_SUMMED = 1 << 20, 0.5
#: Queries from which on parts by query are even, where none has very many rows.
MANY_QUERIES = 10_000
#: A relation's possible pairs for each fact from which on few facts can be repeated: they are summed after a step, not before it.
SPARSE = 16.0
#: A table holds only the inputs that are asked for where all are so many times as many.
DEMAND_GAIN = 2.0
NULL = "__NULL__"
#: Score of the entity that stands for no answer.
NULL_SCORE = -10.0


class Plugin(Protocol):
    """A predicate computed by a function; see :mod:`weft.operators.plugins`."""

    def value(self, message: DataFrame | None, pattern: str) -> DataFrame: ...


class Relations(Protocol):
    spark: SparkSession
    hub_rows: int

    def binary(self, functor: str) -> DataFrame: ...

    def unary(self, functor: str) -> DataFrame: ...

    def symbols(self, type_name: str | None) -> DataFrame: ...

    def statistics(self, names: set[tuple[str, int]], batch: DataFrame | None) -> dict[tuple[str, int], Size]: ...

    def hubs(self, functor: str) -> dict[str, Rows]: ...

    def as_added(self, functor: str) -> DataFrame: ...

    def is_summed(self, functor: str) -> bool: ...


def keys_of(df: DataFrame) -> list[str]:
    return [c for c in ("qid", "id") if c in df.columns]


@dataclass(frozen=True)
class Split:
    """Hubs of the two sides of a join."""

    left: Rows
    right: Rows
    rows: int  #: of a part


NONE = Split({}, {}, HUB_ROWS)


def multiplied(message: DataFrame, relation: DataFrame, forward: bool, split: Split = NONE) -> DataFrame:
    """A step's rows before they are summed: joined on the near end."""
    near, far = ("src", "dst") if forward else ("dst", "src")
    rel = relation.select(F.col(near).alias("id"), F.col(far).alias("to"), F.col("w").alias("rw"))
    by = [c for c in keys_of(message) if c != "id"]
    return met(message, rel, "id", split.left, split.right, split.rows).select(*by, F.col("to").alias("id"), (F.col("w") * F.col("rw")).alias("w"))


def summed(rows: DataFrame) -> DataFrame:
    by = keys_of(rows)
    return rows.groupBy(*by).agg(F.sum("w").alias("w")).select(*by, "w")


def step(message: DataFrame, relation: DataFrame, forward: bool, split: Split = NONE) -> DataFrame:
    """Join on the near end, multiply, sum by the far end."""
    return summed(multiplied(message, relation, forward, split))


def small_step(rows: DataFrame, table: DataFrame) -> DataFrame:
    """A step along a small table.  Rows, which needn't be summed yet, are dealt
    out by query; the table goes to every task, so that sums by query and far
    end are taken where the rows are, however many the table makes of them."""
    return step(summed(rows.repartition("qid")), F.broadcast(table), True)


def even_parts(left: float, right: float, rows: float) -> tuple[int, int]:
    """Into how many parts the rows of a hub are cut on each side, so that two
    parts that meet make about ``rows`` rows, and as few rows as can be are
    repeated: as many of the one side as of the other."""
    places = max(1.0, left * right / rows)
    a = min(max(1.0, math.sqrt(places * left / right)), max(1.0, left))
    return math.ceil(a), math.ceil(min(max(1.0, places / a), max(1.0, right)))


def unsummed_step(message: DataFrame, relation: DataFrame, forward: bool, split: Split = NONE, tasks: int | None = None, small: bool = False) -> DataFrame:
    """The same, along a relation without repeated facts, for a written message
    that makes many times its rows: what a query with one symbol makes differs
    in the far end, so that it comes as the join makes it, and only what other
    queries make, if there are any, is shuffled to be summed.  A ``small``
    relation goes to every task, and no row of the message is repeated."""
    each = message.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "w")).alias("one"))
    single = each.filter("n = 1").select("qid", "one.id", "one.w")
    rest = message.join(each.filter("n > 1").select("qid"), "qid", "left_semi")
    near, far = ("src", "dst") if forward else ("dst", "src")
    rel = relation.select(F.col(near).alias("id"), F.col(far).alias("to"), F.col("w").alias("rw"))
    both = single.repartition(tasks or 1).join(F.broadcast(rel), "id") if small else met(single, rel, "id", split.left, split.right, split.rows, tasks)
    made = both.select("qid", F.col("to").alias("id"), (F.col("w") * F.col("rw")).alias("w"))
    return made.unionByName(step(rest, relation, forward, split)) if rest.head(1) else made


def composed(a: DataFrame, b: DataFrame, split: Split = NONE) -> DataFrame:
    """Two relations as one: joined where a ends and b begins, summed by the outer ends."""
    b = b.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("w").alias("bw"))
    both = met(a.select("src", "dst", "w"), b, "dst", split.left, split.right, split.rows)
    return both.groupBy("src", "to").agg(F.sum(F.col("w") * F.col("bw")).alias("w")).withColumnRenamed("to", "dst")


def doubled(message: DataFrame, relation: DataFrame, terms: int, split: Split = NONE) -> DataFrame:
    """The sum of ``message . relation**k`` over k below ``terms``.

    With S(n) for the sum of n levels, ``S(2n) = S(n) + S(n) . A**n`` and
    ``S(2n+1) = S(2n) + A**2n``: twice as many levels with each bit of
    ``terms``.  Powers and sums are written, as each is used more than once.
    The relation's hubs are taken for those of its powers and of the sums.
    """

    def plus(a: DataFrame, b: DataFrame) -> DataFrame:
        return written(a.unionByName(b).groupBy(*keys_of(a)).agg(F.sum("w").alias("w")), "levels")

    bits, total, power = f"{terms:b}"[1:], message, relation
    for i, bit in enumerate(bits):
        total = plus(total, step(total, power, True, split))
        last = i == len(bits) - 1
        if bit == "1" and last:  # the message alone goes on
            total = plus(total, step(step(message, power, True, split), power, True, split))
        elif not last:
            power = written(composed(power, power, split).select("src", "dst", "w"), "power")
            if bit == "1":
                total = plus(total, step(message, power, True, split))
                power = written(composed(power, relation, split).select("src", "dst", "w"), "power")
    return total


def product(left: DataFrame, right: DataFrame, heavy: Split = NONE) -> DataFrame:
    """Weights multiplied where symbols, and queries if both have them, agree.
    Where one side has no query, symbols that very many queries of the other
    hold are split."""
    on = [c for c in keys_of(left) if c in right.columns]
    right = right.withColumnRenamed("w", "rw")
    joined = met(left, right, "id", heavy.left, heavy.right, heavy.rows) if on == ["id"] else left.join(right, on)
    by = ["qid", "id"] if "qid" in joined.columns else ["id"]
    return joined.select(*by, (F.col("w") * F.col("rw")).alias("w"))


def totals(message: DataFrame) -> DataFrame:
    """The total of a message, by query; one row where it has no query."""
    by = [c for c in keys_of(message) if c != "id"]
    return message.groupBy(*by).agg(F.sum("w").alias("total")) if by else message.agg(F.sum("w").alias("total")).filter("total is not null")


def scale(value: DataFrame, by: DataFrame) -> DataFrame:
    """A message times another's total.  Without a query on one side that side
    is repeated for each of the other's rows: a total is one row, and a value
    without query comes whole for each query by definition."""
    total = totals(by)
    if "qid" in value.columns and "qid" in by.columns:
        joined = value.join(total, "qid")
    elif "qid" not in by.columns:
        joined = value.crossJoin(F.broadcast(total))
    else:
        joined = total.crossJoin(value)
    cols = ["qid", "id"] if "qid" in joined.columns else ["id"]
    return joined.select(*cols, (F.col("w") * F.col("total")).alias("w"))


def added(parts: list[DataFrame], queries: DataFrame) -> DataFrame:
    """Messages added up; those without a query come for each query."""
    if any("qid" in p.columns for p in parts):
        parts = [p if "qid" in p.columns else queries.crossJoin(p).select("qid", "id", "w") for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if len(parts) == 1 else out.groupBy(*keys_of(out)).agg(F.sum("w").alias("w"))


def softmax(scores: DataFrame, queries: DataFrame, underflown: bool = False) -> DataFrame:
    """Softmax by query over the scores that aren't zero and the null entity,
    whose score is lowered by ten.  A query without answers gets the null
    entity alone; answers whose weight underflows to zero are dropped, unless
    ``underflown`` ones are asked for."""
    nulls = queries.select("qid", F.lit(NULL).alias("id"), F.lit(NULL_SCORE).alias("w"))
    s = scores.unionByName(nulls).groupBy("qid", "id").agg(F.sum("w").alias("w")).filter("w <> 0")
    top = s.groupBy("qid").agg(F.max("w").alias("top"))
    e = s.join(top, "qid").select("qid", "id", F.exp(F.col("w") - F.col("top")).alias("w"))
    p = e.join(totals(e), "qid").select("qid", "id", (F.col("w") / F.col("total")).alias("w"))
    return p if underflown else p.filter("w > 0")


def log1p(scores: DataFrame) -> DataFrame:
    return scores.withColumn("w", F.log1p("w"))


def normalised(scores: DataFrame, queries: DataFrame, how: str, underflown: bool = False) -> DataFrame:
    """``softmax``, ``log+softmax`` or ``none``."""
    if how == "none":
        return scores
    if how not in ("softmax", "log+softmax"):
        raise ValueError(f"no such normalisation: {how}")
    return softmax(log1p(scores) if how == "log+softmax" else scores, queries, underflown)


class Evaluation:
    """Messages of all nodes of a plan, for one batch of queries.

    ``batch`` is (qid, id, w), unique on (qid, id).  With a ``program``, plans
    may hold calls, and runs of steps are bracketed by estimated size; without,
    every node of a plan has its message.  ``own_ids`` says that no symbol is
    asked by very many queries, so that the batch isn't looked through for hubs;
    ``named``, that each query's name is its symbol.
    """

    def __init__(self, relations: Relations, batch: DataFrame, plugins: dict[str, Plugin] | None = None, keep: bool = False, program: Program | None = None, own_ids: bool = False, named: bool = False):
        self.relations, self.batch, self.plugins, self.keep, self.program = relations, batch, plugins or {}, keep, program
        self.named = named
        self.queries = batch.select("qid").distinct()
        self.made: dict[int, DataFrame] = {}
        self.tables: dict[tuple[Mode, int], tuple[DataFrame, Rows]] = {}
        #: of tables that don't hold all inputs, the inputs that they hold
        self.asked: dict[tuple[Mode, int], DataFrame] = {}
        self.choices: list[str] = []
        #: rows of steps before they are summed, where the sum leaves most of them
        self.unsummed: dict[int, DataFrame] = {}
        self._sizes: dict[tuple[str, int], Size] = {}
        self._users: Counter[int] = Counter()
        self._batch_hubs: Rows | None = {} if own_ids else None

    def of(self, root: Node) -> DataFrame:
        order = list(in_order(root))
        inner = self._inner_steps(order) if self.program else set()
        self._users |= Counter(id(i) for n in order for i in n.inputs)
        for node in order:
            if id(node) not in self.made and id(node) not in inner:
                out = self._run_of_steps(node, inner) if node.kind == "step" and inner else self._one(node)
                if node.kind in ("sum", "step") and node.steps >= CUT and node.steps % CUT == 0 and self._deep(root):
                    out = written(out, "level")
                self.made[id(node)] = out.persist() if self.keep and node.kind in ("step", "sum") and self._users[id(node)] else out
        return self.made[id(root)]

    # -- choosing by size -----------------------------------------------------

    @staticmethod
    def _inner_steps(order: list[Node]) -> set[int]:
        """Steps whose message nothing but the next step uses."""
        users = Counter(id(i) for n in order for i in n.inputs)
        return {id(n.inputs[0]) for n in order if n.kind == "step" and n.inputs[0].kind == "step" and users[id(n.inputs[0])] == 1}

    def _known(self, names: set[tuple[str, int]]) -> None:
        """Sizes of relations, and of the batch under the name ("", 0)."""
        missing = names - set(self._sizes)
        if missing:
            self._sizes |= self.relations.statistics({n for n in missing if n[1]}, self.batch if ("", 0) in missing else None)

    def size(self, node: Node) -> Size:
        """An estimate of a message."""
        stored = {(n.detail[0], 1 if n.kind == "unary" else 2) for n in in_order(node) if n.kind in ("unary", "preimage", "step")}
        self._known(stored | {("", 0)})
        got: dict[int, Size] = {}
        for n in in_order(node):
            parts = [got[id(i)] for i in n.inputs]
            match n.kind:
                case "input":
                    out = self._sizes[("", 0)]
                case "unary":
                    out = Size(self._sizes[(n.detail[0], 1)].rows, 1, self._sizes[(n.detail[0], 1)].rows)
                case "preimage":
                    end = self._ends(n)
                    out = Size(end.near, 1, end.near)
                case "step":
                    out = joined(parts[0], self._ends(n))[1]
                case "product":
                    rows, far = min(p.rows for p in parts), min(p.far for p in parts)
                    near = max(p.near for p in parts)
                    out = Size(min(max(p.rows for p in parts), max(rows, near)), near, far)
                case "scale" | "plugin" | "call" if parts:
                    out = parts[0]
                case "sum":
                    near, far = max(p.near for p in parts), max(p.far for p in parts)
                    out = Size(min(sum(p.rows for p in parts), near * far), near, far)
                case _:
                    out = Size(1, 1, 1)
            got[id(n)] = out
        return got[id(node)]

    def _ends(self, node: Node) -> Size:
        s = self._sizes[(node.detail[0], 2)]
        return s if node.detail[1] == "forward" else Size(s.rows, s.far, s.near)

    def heavy(self, node: Node) -> Rows:
        """Symbols that very many queries may hold in a message, with about how
        many: those of the batch, and hubs at the far end of the last step.
        Rows that meet at a symbol only by way of hubs further back aren't told."""
        if not node.per_query:
            return {}
        match node.kind:
            case "input":
                if self._batch_hubs is None:
                    self._batch_hubs = hubs_at(self.batch, ["id"], self.relations.hub_rows)["id"]
                return self._batch_hubs
            case "step":
                functor, direction = node.detail
                found = self.relations.hubs(functor)["dst" if direction == "forward" else "src"]
                if not found:
                    return {}
                before = self.size(node.inputs[0])
                each = before.rows / max(before.far, 1.0)  # queries that hold one symbol
                return {h: min(n * each, before.near) if node.inputs[0].per_query else 1.0 for h, n in found.items()}
            case "product" | "sum" | "scale":
                out: Rows = {}
                for i in node.inputs:
                    for h, n in self.heavy(i).items():
                        out[h] = max(n, out.get(h, 0.0))
                return out
        return {}

    def _many_rows(self, node: Node) -> bool:
        """Whether some query may have very many rows: a symbol on its way has very many facts."""
        return any(self.relations.hubs(n.detail[0])["src" if n.detail[1] == "forward" else "dst"] for n in in_order(node) if n.kind == "step")

    def split(self, message: Node | None, functor: str, direction: str) -> Split:
        """Hubs of a step along a relation; without a message's node, the relation's alone."""
        near = self.relations.hubs(functor)["src" if direction == "forward" else "dst"]
        return Split(self.heavy(message) if message else {}, near, self.relations.hub_rows)

    def _run_of_steps(self, last: Node, inner: set[int]) -> DataFrame:
        """A run of steps in the order that makes fewest rows."""
        run = [last]
        while id(run[0].inputs[0]) in inner:
            run.insert(0, run[0].inputs[0])
        message = self.made[id(run[0].inputs[0])]
        if len(run) == 1:
            return self._one(last)
        self._known({(n.detail[0], 2) for n in run})
        sizes = [self.size(run[0].inputs[0]), *(self._ends(n) for n in run)]
        cost, tree, _ = best_order(sizes)
        self.choices.append(f"{shown(tree, ['queries', *(n.detail[0] for n in run)])}: about {cost:.3g} rows")

        def relation(k: int, whole: bool = False) -> DataFrame:
            functor, size = run[k - 1].detail[0], sizes[k]
            r = self.relations.binary(functor) if whole or size.near * size.far < SPARSE * size.rows else self.relations.as_added(functor)
            return r if run[k - 1].detail[1] == "forward" else r.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")

        def outermost(tree: Tree, side: int) -> int:
            while not isinstance(tree, int):
                tree = tree[side]
            return tree

        def sized(tree: Tree) -> Size:
            return sizes[tree] if isinstance(tree, int) else joined(sized(tree[0]), sized(tree[1]))[1]

        def large(left: Tree, right: Tree) -> int:
            """Tasks of a large step whose relation has no repeated facts, or 0."""
            made = joined(sized(left), sized(right))[0]
            summed = not isinstance(right, int) or self.relations.is_summed(run[right - 1].detail[0])
            many = summed and "qid" in message.columns and made >= max(LARGE_STEP, LARGE_GAIN * sized(left).rows)
            return int(min(made / ROWS_A_TASK, MOST_TASKS - 1)) + 1 if many else 0

        def built(part: Tree) -> DataFrame:
            if isinstance(part, int):
                return message if part == 0 else relation(part)
            left, right = part
            end, begin = outermost(left, 1), run[outermost(right, 0) - 1]
            split = self.split(run[end].inputs[0] if end == 0 else run[end - 1], *begin.detail)
            tasks = large(left, right) if outermost(left, 0) == 0 else 0
            if tasks:
                self.choices.append("unsummed where a query has one symbol")
                stored, by = written(built(left), "message"), sized(right)
                facts = relation(right, whole=True) if isinstance(right, int) else built(right)
                if by.rows <= SMALL_FACTS:
                    return unsummed_step(stored, facts, True, split, tasks, small=True)
                # what a task makes counts here: the message's rows of a symbol, as they are, times the facts that each meets
                each = by.rows / max(by.near, 1.0)
                found = hubs_at(stored, ["id"], max(1, int(ROWS_A_TASK / each)))["id"]
                parts = {h: even_parts(found.get(h, 1.0), split.right.get(h, each), ROWS_A_TASK) for h in {*found, *split.right}}
                cut = Split({h: float(n) for h, (n, _) in parts.items()}, {h: float(n) for h, (_, n) in parts.items()}, 1)
                return unsummed_step(stored, facts, True, cut, tasks)
            if outermost(left, 0) == 0:
                rows = multiplied(built(left), built(right), True, split)
                made, after = joined(sized(left), sized(right))
                if part is tree and "qid" in message.columns and after.rows > FEW_SUMMED * made:
                    self.unsummed[id(last)] = rows
                return summed(rows)
            functor, direction = run[end - 1].detail
            left_hubs = self.relations.hubs(functor)["dst" if direction == "forward" else "src"]
            return composed(built(left), built(right), Split(left_hubs, split.right, split.rows))

        return built(tree)

    def _called(self, node: Node, message: DataFrame) -> DataFrame:
        """A call: by doubling, where it is a deep linear recursion; from a table,
        where the message has many more rows than different symbols; or else
        by its rules.  The table is of all inputs, or of the symbols asked for
        where those are fewer; what other calls ask is added to it."""
        mode, depth = node.detail
        linear = self.program.linear(mode) if node.per_query else None
        terms = self.program.max_depth - depth + 1
        if linear and terms >= DOUBLED_FROM:
            by, size = self._step_relation(linear)
            now = self.size(node.inputs[0])
            one, two = unrolled_cost(now, size, terms), doubled_cost(now, size, terms)
            if two < one:
                self.choices.append(f"{mode}, {terms} levels by doubling: about {two:.3g} rows, one by one {one:.3g}")
                return self._doubled(linear, message, by, terms)
            self.choices.append(f"{mode}, {terms} levels one by one: about {one:.3g} rows, by doubling {two:.3g}")
        domain = self.program.domain(mode) if node.per_query else None
        if domain:
            self._known({(f, n) for f, n, _ in domain})
            inputs = sum(self._sizes[(f, n)].far if c == "dst" else self._sizes[(f, n)].near for f, n, c in domain)
            size, key = self.size(node.inputs[0]), (mode, depth)
            asked = min(size.far, inputs)
            if size.rows > TABLE_GAIN * asked:
                if DEMAND_GAIN * asked < inputs and (key not in self.tables or key in self.asked):
                    self.choices.append(f"{mode} from a table of what is asked: about {asked:.3g} of {inputs:.3g} inputs for {size.rows:.3g} rows")
                    message = written(message, "message")
                    self._extend(mode, depth, message.select("id").distinct())
                elif key not in self.tables or key in self.asked:
                    self.choices.append(f"{mode} from a table: about {inputs:.3g} inputs for {size.rows:.3g} rows")
                    self.asked.pop(key, None)
                    self._keep(key, self._table(mode, depth, self.inputs(domain)))
                table, heads = self.tables[key]
                if size.near >= MANY_QUERIES and promised_bytes(table) <= SMALL_TABLE and not self._many_rows(node.inputs[0]):
                    self.choices.append(f"{mode} where its queries are")
                    return small_step(message if key in self.asked else self.unsummed.get(id(node.inputs[0]), message), table)
                return step(message, table, True, Split(self.heavy(node.inputs[0]), heads, self.relations.hub_rows))
        return self.of(self.program.expanded(mode, depth, node.inputs[0]))

    def _step_relation(self, linear: Linear) -> tuple[DataFrame, Size]:
        """The relation from one level of a recursion to the next, and its size."""
        if linear.single:
            functor, direction = linear.single
            self._known({(functor, 2)})
            r, s = self.relations.binary(functor), self._sizes[(functor, 2)]
            return (r, s) if direction == "forward" else (r.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), Size(s.rows, s.far, s.near))
        mode = Mode("_step", "io")
        ev = Evaluation(self.relations, self.batch, self.plugins, program=linear.parts)
        domain = linear.parts.domain(mode)
        table = ev._table(mode, 0, ev.inputs(domain))
        got = table.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("src").alias("near"), F.approx_count_distinct("dst").alias("far")).first()
        return table, Size(float(got.n), float(got.near), float(got.far))

    def _doubled(self, linear: Linear, message: DataFrame, by: DataFrame, terms: int) -> DataFrame:
        def base(batch: DataFrame) -> DataFrame:
            ev = Evaluation(self.relations, batch.select("qid", "id", "w"), self.plugins, program=linear.parts)
            return ev.scores(linear.parts.plan("_base/io", calls=True))

        start = message.select("qid", "id", "w")
        hubs = hubs_at(by, ["src", "dst"], self.relations.hub_rows)
        split = Split(hubs["dst"], hubs["src"], self.relations.hub_rows)
        return base(doubled(start, by, terms, split)) if linear.front else doubled(written(base(start), "levels"), by, terms, split)

    def inputs(self, domain: set[tuple[str, int, str]]) -> DataFrame:
        """(id): every symbol at the ends of relations named."""
        ends = [(self.relations.unary(f) if n == 1 else self.relations.binary(f)).select(F.col(c).alias("id")) for f, n, c in sorted(domain)]
        ids = ends[0]
        for e in ends[1:]:
            ids = ids.union(e)
        return ids.distinct()

    def _keep(self, key: tuple[Mode, int], table: DataFrame) -> None:
        self.tables[key] = table, hubs_at(table, ["src"], self.relations.hub_rows)["src"]

    def _extend(self, mode: Mode, depth: int, ids: DataFrame) -> None:
        """Adds inputs to a table that holds what was asked so far."""
        key = (mode, depth)
        before = self.asked.get(key)
        ids = written(ids if before is None else ids.join(before, "id", "left_anti"), "asked")
        part = self._table(mode, depth, ids)
        self.asked[key] = ids if before is None else before.union(ids)
        self._keep(key, part if before is None else self.tables[key][0].union(part))

    def _table(self, mode: Mode, depth: int, ids: DataFrame) -> DataFrame:
        """A called predicate as a relation: every one of ``ids`` (id) is a query."""
        ev = Evaluation(self.relations, ids.select(F.col("id").alias("qid"), "id", F.lit(1.0).alias("w")), self.plugins, program=self.program, own_ids=True)
        ev.tables, ev.asked, ev.choices = self.tables, self.asked, self.choices
        ev._sizes = {k: s for k, s in self._sizes.items() if k[1]}
        answers = ev.scores(self.program.expanded(mode, depth))
        return written(answers.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "w"), "table")

    @staticmethod
    def _deep(root: Node) -> bool:
        """Whether the plan is recursive deeply enough for levels to be written."""
        return root.steps > 2 * CUT

    def scores(self, root: Node) -> DataFrame:
        """(qid, id, w) of a plan's value, for each query."""
        out = self.of(root)
        return out if "qid" in out.columns else self.queries.crossJoin(out).select("qid", "id", "w")

    def release(self) -> None:
        if self.keep:
            for df in self.made.values():
                df.unpersist()
        self.made.clear()

    def plugin_message(self, node: Node) -> DataFrame | None:
        """What a plugin gets; the batch comes without symbols where these are
        the queries' names and the plugin ``takes_names``."""
        if not node.inputs:
            return None
        message, plugin = self.of(node.inputs[0]), self.plugins[f"{node.detail[0]}/{len(node.detail[1])}"]
        return message.select("qid", "w") if self.named and node.inputs[0].kind == "input" and getattr(plugin, "takes_names", False) else message

    def _for_product(self, node: Node, other: Node) -> DataFrame:
        """A node's message for a product with another: a step that meets a
        unary relation with few symbols takes only the facts that end at them,
        so that what is dropped is neither summed nor joined."""
        alone = node.kind == "step" and node.per_query and node.steps < CUT and self._users[id(node)] == 1
        if self.program and alone and other.kind == "unary" and id(node.inputs[0]) in self.made:
            self._known({(other.detail[0], 1)})
            if self._sizes[(other.detail[0], 1)].rows <= FEW_SYMBOLS:
                functor, direction = node.detail
                far = "dst" if direction == "forward" else "src"
                few = F.broadcast(self.relations.unary(other.detail[0]).select(F.col("id").alias(far)))
                facts = self.relations.binary(functor).join(few, far, "left_semi")
                return step(self.made[id(node.inputs[0])], facts, direction == "forward", self.split(node.inputs[0], functor, direction))
        return self._for_batch(node, other)

    def _for_batch(self, node: Node, other: Node) -> DataFrame:
        """A node's message for a product with another: a step without queries
        that meets a small batch takes only the facts that end at its symbols."""
        if node.kind != "step" or node.per_query or other.kind != "input" or id(node.inputs[0]) not in self.made or promised_bytes(self.batch) > SMALL_BATCH:
            return self.made[id(node)]
        functor, direction = node.detail
        far = "dst" if direction == "forward" else "src"
        facts = self.relations.binary(functor).join(F.broadcast(self.batch.select(F.col("id").alias(far)).distinct()), far, "left_semi")
        return step(self.made[id(node.inputs[0])], facts, direction == "forward", self.split(node.inputs[0], functor, direction))

    def _one(self, node: Node) -> DataFrame:
        r, spark = self.relations, self.relations.spark
        got = [self.made[id(i)] for i in node.inputs]
        match node.kind:
            case "input":
                return self.batch
            case "const":
                return spark.range(1).select(F.lit(node.detail[0]).alias("id"), F.lit(1.0).alias("w"))
            case "ones":
                return r.symbols(node.detail[0]).select("id", F.lit(1.0).alias("w"))
            case "unary":
                return r.unary(node.detail[0])
            case "preimage":
                near = "src" if node.detail[1] == "forward" else "dst"
                return r.binary(node.detail[0]).groupBy(F.col(near).alias("id")).agg(F.sum("w").alias("w"))
            case "step":
                return step(got[0], r.binary(node.detail[0]), node.detail[1] == "forward", self.split(node.inputs[0], *node.detail))
            case "product":
                left, right = (self.heavy(i) if i.per_query != j.per_query else {} for i, j in (node.inputs, node.inputs[::-1]))
                return product(*(self._for_product(i, j) for i, j in (node.inputs, node.inputs[::-1])), Split(left, right, r.hub_rows))
            case "scale":
                return scale(*got)
            case "sum":
                return added(got, self.queries)
            case "plugin":
                functor, pattern = node.detail
                return self.plugins[f"{functor}/{len(pattern)}"].value(self.plugin_message(node), pattern)
            case "call":
                return self._called(node, got[0])
            case "empty":
                return self.batch.limit(0)
        raise AssertionError(node.kind)
