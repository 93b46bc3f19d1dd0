"""Predicates computed by functions, with what gradients need of them.

A plugin gets a message (qid, id, w), or (id, w) where it doesn't depend on the
query, and gives one; a unary plugin gets nothing.  Gradients pass through it
if it has an adjoint, and it may have parameters of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.lower import SMALL_FACTS, keys_of, step
from weft.scratch import written

Key = tuple[str, int]
#: What a plugin's adjoint gives: the delta of its message (None for a unary plugin), and gradients by parameter.
Back = tuple[DataFrame | None, dict[Key, DataFrame]]


class NoAdjoint(ValueError):
    """Gradients don't pass through this operator."""


class Differentiable(Protocol):
    """A plugin with an adjoint; ``pattern`` is ``io`` or ``oi``, or ``i`` of a
    unary one.  A delta may lack rows that the value doesn't have."""

    parameters: set[Key]

    def value(self, message: DataFrame | None, pattern: str) -> DataFrame: ...

    def back(self, message: DataFrame | None, delta: DataFrame, pattern: str) -> Back: ...


@dataclass
class Function:
    """A plain function, and perhaps another one that gives its adjoint.

    ``call(message)`` gives the value, ``call()`` that of a unary plugin.
    ``backward(message, delta)`` gives the delta of the message, or that and a
    dictionary of gradients by parameter.
    """

    call: Callable[..., DataFrame]
    backward: Callable[..., DataFrame | Back] | None = None
    parameters: set[Key] = field(default_factory=set)

    def value(self, message: DataFrame | None, pattern: str) -> DataFrame:
        return self.call() if message is None else self.call(message)

    def back(self, message: DataFrame | None, delta: DataFrame, pattern: str) -> Back:
        if self.backward is None:
            raise NoAdjoint("a plugin without an adjoint")
        out = self.backward(message, delta)
        return out if isinstance(out, tuple) else (out, {})


# -- edges between embedded symbols ----------------------------------------------

#: Weight and slope by the difference, of each kind of link.
LINKS = {
    "exp": (F.exp, F.exp),
    "softplus": (lambda d: F.greatest(d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d))), lambda d: 1 / (1 + F.exp(-d))),
}


@dataclass
class EmbeddedEdges:
    """A stored relation whose weights come from vectors of its ends.

    The weight of (a, b) is the stored one times ``link(sum of a's vector - sum
    of b's)``.  Vectors are a parameter of their own, ``(name, 0)``, stored as
    rows (id, k, w); facts with an end that has no vector have no weight.
    """

    db: object
    relation: str
    vectors: str
    link: str = "softplus"
    #: gets a batch as (qid, w) where each query's name is its symbol: its rows then stay with the facts of that symbol
    takes_names = True
    #: the relation that ends were counted of; by end its symbols, where they are few
    _counted: tuple = (None, {})

    def _few(self, end: str) -> DataFrame | None:
        """(end): the symbols at an end of the relation, if they are few enough for every task."""
        rel = self.db.binary(self.relation)
        if self._counted[0] is not rel:
            self._counted = (rel, {})
        if end not in self._counted[1]:
            ids = written(self.db.ends(self.relation, end).withColumnRenamed("id", end), "ends")
            self._counted[1][end] = ids if ids.count() <= SMALL_FACTS else None
        return self._counted[1][end]

    @property
    def parameters(self) -> set[Key]:
        return {(self.vectors, 0), (self.relation, 2)}

    def _edges(self) -> DataFrame:
        """(src, dst, stored, d): each fact with the difference of its ends."""
        level = self.db.relations[(self.vectors, 0)].groupBy("id").agg(F.sum("w").alias("u"))
        near, far = level.select(F.col("id").alias("src"), F.col("u").alias("a")), level.select(F.col("id").alias("dst"), F.col("u").alias("b"))
        few = self._few("dst")
        if few is not None:
            far = F.broadcast(far.join(F.broadcast(few), "dst", "left_semi"))
        return self.db.binary(self.relation).withColumnRenamed("w", "stored").join(near, "src").join(far, "dst").select("src", "dst", "stored", (F.col("a") - F.col("b")).alias("d"))

    def weights(self) -> DataFrame:
        """(src, dst, w): the relation that the vectors make."""
        return self._edges().select("src", "dst", (F.col("stored") * LINKS[self.link][0](F.col("d"))).alias("w"))

    def value(self, message: DataFrame | None, pattern: str) -> DataFrame:
        if "id" not in message.columns:
            near, far = ("src", "dst") if pattern == "io" else ("dst", "src")
            by_name = self.weights().select(F.col(near).alias("qid"), F.col(far).alias("id"), F.col("w").alias("rw"))
            return message.join(by_name, "qid").groupBy("qid", "id").agg(F.sum(F.col("w") * F.col("rw")).alias("w"))
        return step(message, self.weights(), pattern == "io")

    def back(self, message: DataFrame | None, delta: DataFrame, pattern: str) -> Back:
        near, far = ("src", "dst") if pattern == "io" else ("dst", "src")
        on = ["qid"] if "qid" in message.columns and "qid" in delta.columns else []
        named = "id" not in message.columns
        m = message.select(*on, F.col("w").alias("mw")) if named else message.select(*on, F.col("id").alias(near), F.col("w").alias("mw"))
        d = delta.select(*on, F.col("id").alias(far), F.col("w").alias("dw"))
        weight, slope = LINKS[self.link]
        if named:
            met = m.join(self._edges().withColumnRenamed(near, "qid"), "qid").join(d, ["qid", far]).withColumnRenamed("qid", near)
        else:
            met = m.join(self._edges(), near).join(d, [*on, far])
        by_edge = met.groupBy("src", "dst").agg(F.sum(F.col("mw") * F.col("dw")).alias("g"), F.first("stored").alias("stored"), F.first("d").alias("d"))
        pull = F.col("g") * F.col("stored") * slope(F.col("d"))
        ends = F.explode(F.array(F.struct(F.col("src").alias("id"), pull.alias("g")), F.struct(F.col("dst").alias("id"), (-pull).alias("g")))).alias("e")
        by_symbol = by_edge.select(ends).groupBy("e.id").agg(F.sum("e.g").alias("g"))
        components = self.db.relations[(self.vectors, 0)].select("id", "k").join(by_symbol, "id").select("id", "k", F.col("g").alias("w"))
        stored = by_edge.select("src", "dst", (F.col("g") * weight(F.col("d"))).alias("w"))
        return step(delta, self.weights(), pattern == "oi").select(*keys_of(delta), "w"), {(self.vectors, 0): components, (self.relation, 2): stored}
