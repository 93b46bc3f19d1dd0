"""The database: weighted unary and binary relations, their types, and which
of them are parameters.  A predicate is its name and its number of arguments."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.messages import numbered
from weft.operators.hubs import HUB_ROWS, Rows, hubs_at, promised_bytes
from weft.plans.order import Size
from weft.plans.terms import Goal, TypeDecl
from weft.scratch import bucketed, buckets_for, fine_tasks, written

log = logging.getLogger(__name__)

DEFAULT_TYPE, NULL, OOV = "__THING__", "__NULL__", "__OOV__"
BINARY, UNARY, VECTORS = "src string, dst string, w double", "id string, w double", "id string, k int, w double"
COLUMNS = {2: ["src", "dst", "w"], 1: ["id", "w"], 0: ["id", "k", "w"]}


class UnknownSymbol(KeyError):
    """A symbol that no relation of its type has."""


@dataclass
class Database:
    """Relations by (name, arity); repeated facts add up."""

    spark: SparkSession
    relations: dict[tuple[str, int], DataFrame] = field(default_factory=dict)
    types: dict[tuple[str, int], tuple[str, ...]] = field(default_factory=dict)
    parameters: set[tuple[str, int]] = field(default_factory=set)
    typed: bool = False
    #: facts of one symbol from which on joins split it
    hub_rows: int = HUB_ROWS
    #: facts as they were added, before equal ones are summed; sizes are counted on these
    _facts: dict[tuple[str, int], tuple[DataFrame, DataFrame]] = field(default_factory=dict, repr=False)
    _counted: dict[tuple[str, int], tuple[DataFrame, Size]] = field(default_factory=dict, repr=False)
    _hubs: dict[str, dict[str, Rows]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        fine_tasks(self.spark)

    # -- filling ------------------------------------------------------------

    def add(self, functor: str, facts: DataFrame, weighted: bool | None = None) -> Database:
        """A relation from columns (src, dst[, w]) or (id[, w]); rows with a
        null symbol are dropped, repeated facts add up."""
        binary = "src" in facts.columns
        key = (functor, 2 if binary else 1)
        if key in self.relations:
            raise ValueError(f"{functor}/{key[1]} is loaded already")
        cols = ["src", "dst"] if binary else ["id"]
        w = F.col("w").cast("double") if "w" in facts.columns else F.lit(1.0)
        rows = facts.select(*(F.col(c).cast("string").alias(c) for c in cols), w.alias("w")).dropna()
        self.relations[key] = rows.groupBy(*cols).agg(F.sum("w").alias("w"))
        self._facts[key] = (self.relations[key], rows)
        return self

    def add_vectors(self, name: str, vectors: DataFrame) -> Database:
        """A vector for each symbol, from columns (id, v), v an array, or (id,
        k, w) with a row a component.  It is stored as ``(name, 0)``: not a
        relation that rules can use, but a parameter that plugins and losses
        may have.  Components that are null are dropped, repeated ones add up."""
        if (name, 0) in self.relations:
            raise ValueError(f"{name}/0 is loaded already")
        if "v" in vectors.columns:
            vectors = vectors.select("id", F.posexplode("v").alias("k", "w"))
        rows = vectors.select(F.col("id").cast("string").alias("id"), F.col("k").cast("int").alias("k"), F.col("w").cast("double").alias("w")).dropna()
        self.relations[(name, 0)] = rows.groupBy("id", "k").agg(F.sum("w").alias("w"))
        return self

    def declare(self, functor: str, *types: str) -> None:
        key = (functor, len(types))
        if self.types.get(key, types) != types:
            raise ValueError(f"{functor} is declared as {self.types[key]} and as {types}")
        self.types[key], self.typed = types, True

    def check_types(self) -> list[str]:
        """Relations of a typed database that have no declaration; each is logged."""
        missing = [f"{f}/{n}" for f, n in self.relations if self.typed and (f, n) not in self.types]
        for m in missing:
            log.warning("no types are declared for %s", m)
        return missing

    # -- access -------------------------------------------------------------

    def has(self, functor: str, arity: int) -> bool:
        return (functor, arity) in self.relations

    def binary(self, functor: str) -> DataFrame:
        return self.relations[(functor, 2)]

    def unary(self, functor: str) -> DataFrame:
        return self.relations[(functor, 1)]

    def argument_types(self, functor: str, arity: int) -> tuple[str, ...] | None:
        if (functor, arity) in self.types:
            return self.types[(functor, arity)]
        return (DEFAULT_TYPE,) * arity if not self.typed and (functor, arity) in self.relations else None

    def symbols(self, type_name: str | None = None) -> DataFrame:
        """(id): the distinct symbols of a type, null and unknown ones first of all."""
        out = self.spark.createDataFrame([(NULL,), (OOV,)], "id string")
        for (functor, arity), rel in self.relations.items():
            types = self.argument_types(functor, arity) or (DEFAULT_TYPE,) * arity
            added, facts = self._facts.get((functor, arity), (rel, rel))
            cols = [F.col(c) for c, t in zip(["id"] if arity == 1 else ["src", "dst"], types) if type_name is None or t == type_name]
            if cols:  # of facts as they were added: equal ones needn't be summed for it
                out = out.union((facts if added is rel else rel).select(F.explode(F.array(*cols)).alias("id")))
        return out.distinct()

    def numbers(self, type_name: str | None = None) -> DataFrame:
        """(id, number): the symbols of a type numbered from 0 without gaps, in
        an order that depends on the symbols alone."""
        return numbered(self.symbols(type_name), "number", "id")

    def number_of(self, symbols: DataFrame, type_name: str | None = None) -> DataFrame:
        """``symbols`` (id) with their number, -1 where it is unknown."""
        found = symbols.join(self.numbers(type_name), "id", "left")
        return found.withColumn("number", F.coalesce("number", F.lit(-1).cast("long")))

    def symbol_of(self, numbers: DataFrame, type_name: str | None = None) -> DataFrame:
        """``numbers`` (number) with their symbol, null where there is none."""
        return numbers.join(self.numbers(type_name), "number", "left")

    def dimension(self, type_name: str | None = None) -> int:
        """Vocabulary size and one."""
        return self.symbols(type_name).count() + 1

    def statistics(self, names: set[tuple[str, int]], batch: DataFrame | None = None) -> dict[tuple[str, int], Size]:
        """About how large relations, and a batch under the name ("", 0), are;
        counted in one job, and once for each relation until it is replaced."""
        out, parts = {}, []
        for key in sorted(names):
            rel = self.relations[key]
            if key in self._counted and self._counted[key][0] is rel:
                out[key] = self._counted[key][1]
                continue
            ends = ("src", "dst") if key[1] == 2 else ("id", "id")
            added, facts = self._facts.get(key, (rel, rel))
            parts.append((key, rel, facts if added is rel else rel, ends))
        if batch is not None:
            parts.append((("", 0), batch, batch, ("qid", "id")))
        rows = None
        for i, (_, _, facts, ends) in enumerate(parts):
            one = facts.agg(F.count(F.lit(1)).alias("rows"), *(F.approx_count_distinct(e).alias(n) for e, n in zip(ends, ("near", "far")))).withColumn("i", F.lit(i))
            rows = one if rows is None else rows.unionByName(one)
        for r in rows.collect() if rows is not None else ():
            key, rel, _, _ = parts[r.i]
            out[key] = Size(float(min(r["rows"], r.near * r.far) if key[1] == 2 else r["rows"]), float(r.near), float(r.far))
            if key[1]:
                self._counted[key] = (rel, out[key])
        return out

    def hubs(self, functor: str) -> dict[str, Rows]:
        """By end, the symbols with very many facts of a binary relation.  They
        are counted once: other weights, as training gives, leave them as they
        are, and hubs that are out of date change no result.  Facts are counted
        as they were added: equal ones needn't be summed for it."""
        if functor not in self._hubs:
            self._hubs[functor] = hubs_at(self.as_added(functor), ["src", "dst"], self.hub_rows)
        return self._hubs[functor]

    def as_added(self, functor: str) -> DataFrame:
        """A binary relation's facts before equal ones are summed, or the
        relation itself where it has been replaced."""
        rel = self.binary(functor)
        added, facts = self._facts.get((functor, 2), (rel, rel))
        return facts if added is rel else rel

    def is_summed(self, functor: str) -> bool:
        """Whether a binary relation has no repeated facts, because it was added and never replaced."""
        return self._facts.get((functor, 2), (None,))[0] is self.binary(functor)

    def ends(self, functor: str, end: str) -> DataFrame:
        """(id): the distinct symbols at an end of a binary relation."""
        return self.as_added(functor).select(F.col(end).alias("id")).distinct()

    def store_dealt(self, functor: str, end: str) -> None:
        """A binary relation stored in buckets by one end: what meets it there,
        or is summed within a symbol, doesn't move it.  Where the end has hubs
        it is stored as it is."""
        facts = self.as_added(functor)
        if hubs_at(facts, [end], self.hub_rows)[end]:
            self.set_parameter(functor, 2, written(self.binary(functor), functor))
            return
        parts = buckets_for(promised_bytes(facts))
        self.set_parameter(functor, 2, bucketed(facts.repartition(parts, end).groupBy("src", "dst").agg(F.sum("w").alias("w")), functor, end, parts))

    def dealt(self, functor: str, end: str) -> DataFrame:
        """A binary relation with all facts of a symbol at one end in one task,
        so that what is summed within that symbol needs no shuffle of its own.
        Where the end has hubs it comes as it is."""
        facts = self.as_added(functor)
        if hubs_at(facts, [end], self.hub_rows)[end]:
            return self.binary(functor)
        return facts.repartition(end).groupBy("src", "dst").agg(F.sum("w").alias("w"))

    # -- constructors of messages -------------------------------------------

    def onehot(self, symbols: list[str] | str, type_name: str | None = None, strict: bool = True, unknown_as_oov: bool = False) -> DataFrame:
        """(qid, id, w): one query for each symbol; unknown symbols are an
        error, or become the unknown entity."""
        symbols = [symbols] if isinstance(symbols, str) else list(symbols)
        batch = self.spark.createDataFrame([(i, s, 1.0) for i, s in enumerate(symbols)], "qid long, id string, w double")
        if not strict and not unknown_as_oov:
            return batch
        known = {r.id for r in self.symbols(type_name).join(F.broadcast(batch.select("id")), "id", "left_semi").collect()}
        missing = [s for s in symbols if s not in known]
        if missing and not unknown_as_oov:
            raise UnknownSymbol(f"no such symbols: {missing[:5]}")
        return self.spark.createDataFrame([(i, s if s in known else OOV, 1.0) for i, s in enumerate(symbols)], "qid long, id string, w double")

    def zeros(self, queries: int = 1) -> DataFrame:
        """No answers, for any number of queries."""
        return self.spark.createDataFrame([], "qid long, id string, w double")

    def ones(self, type_name: str | None = None) -> DataFrame:
        return self.symbols(type_name).select("id", F.lit(1.0).alias("w"))

    def nulls(self, queries: DataFrame) -> DataFrame:
        """The null entity for each query."""
        return queries.select("qid", F.lit(NULL).alias("id"), F.lit(1.0).alias("w")).distinct()

    # -- parameters ---------------------------------------------------------

    def mark_parameter(self, functor: str, arity: int) -> None:
        self.parameters.add((functor, arity))

    def clear_parameters(self) -> None:
        self.parameters.clear()

    def parameter(self, functor: str, arity: int) -> DataFrame:
        return self.relations[(functor, arity)]

    def set_parameter(self, functor: str, arity: int, value: DataFrame) -> None:
        self.relations[(functor, arity)] = value.select(*COLUMNS[arity])

    def is_initialised(self, functor: str, arity: int) -> bool:
        return (functor, arity) in self.relations

    def partner(self) -> Database:
        """A database with the same schema and relations of its own."""
        return replace(self, relations=dict(self.relations), types=dict(self.types), parameters=set(self.parameters), _facts=dict(self._facts), _counted=dict(self._counted), _hubs=dict(self._hubs))

    # -- listing ------------------------------------------------------------

    def sizes(self, functor: str | None = None) -> DataFrame:
        """(functor, arity, facts, left, right, parameter) of each relation."""
        out = None
        for (f, n), rel in sorted(self.relations.items()):
            if functor not in (None, f):
                continue
            left, right = ("src", "dst") if n == 2 else ("id", "id")
            row = rel.agg(F.count(F.lit(1)).alias("facts"), F.countDistinct(left).alias("left"), F.countDistinct(right).alias("right"))
            row = row.select(F.lit(f).alias("functor"), F.lit(n).alias("arity"), "facts", "left", "right", F.lit((f, n) in self.parameters).alias("parameter"))
            out = row if out is None else out.unionByName(row)
        return out if out is not None else self.spark.createDataFrame([], "functor string, arity int, facts long, left long, right long, parameter boolean")

    def n_relations(self) -> int:
        return len(self.relations)

    def size(self, parameters_only: bool = False) -> int:
        return sum(rel.count() for key, rel in self.relations.items() if not parameters_only or key in self.parameters)

    def listing(self) -> str:
        lines = [f"{r.functor}/{r.arity}: in DB: {r.left} x {r.right}, {r.facts} facts" for r in self.sizes().collect()]
        return "\n".join(lines + [f"typing: {TypeDecl(f, t)}" for (f, _), t in sorted(self.types.items())])

    def facts(self, functor: str, arity: int) -> dict[Goal, float]:
        """A relation's facts as goals with weights; meant for small relations."""
        rel = self.relations[(functor, arity)]
        return {Goal(functor, tuple(r[:arity])): r.w for r in rel.collect()}

    def fact_text(self, functor: str, arity: int) -> DataFrame:
        """(value): a relation as lines of a fact file."""
        if not arity:
            raise ValueError(f"{functor}/0 holds vectors, which fact files can't")
        cols = ["src", "dst"] if arity == 2 else ["id"]
        return self.relations[(functor, arity)].select(F.concat_ws("\t", F.lit(functor), *cols, shortest_number("w")).alias("value"))

    def possible_ops(self, type_name: str | None = None) -> list[str]:
        """Modes of stored binary relations that take a symbol of the type."""
        out = []
        for functor, arity in sorted(self.relations):
            types = self.argument_types(functor, arity)
            if arity == 2 and types:
                out += [f"{functor}/{pattern}" for pattern, t in zip(("io", "oi"), types) if type_name in (None, t)]
        return out


def shortest_number(column: str):
    """A number as ``%g`` prints it, for numbers that need no exponent."""
    six = F.format_string("%.5e", F.col(column)).cast("double")
    whole = F.abs(six - F.round(six)) < 1e-12
    return F.when(whole & (F.abs(six) < 1e15), six.cast("long").cast("string")).otherwise(six.cast("string"))


def row_symbols(message: DataFrame) -> dict[int, dict[str, float]]:
    """Answers by query as plain dictionaries; meant for small results."""
    out: dict[int, dict[str, float]] = {}
    for r in message.collect():
        out.setdefault(r.qid, {})[r.id] = r.w
    return out
