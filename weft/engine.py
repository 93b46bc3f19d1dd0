"""The engine: rules over a database, asked by mode."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalog import Database, row_symbols
from weft.learn import ranked
from weft.operators.lower import Evaluation, normalised
from weft.operators.plugins import Differentiable, Function
from weft.plans.features import FeatureRules, feature_weights, plain_only, rule_weights
from weft.plans.nodes import explain, in_order
from weft.plans.parse import parse_rule_files, parse_rules
from weft.plans.planner import Program
from weft.plans.terms import Mode, RuleSet
from weft.prepared import Prepared
from weft.scratch import written

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Settings:
    """What can be set, and what it is for."""

    max_depth: int = 10  #: calls of rule-defined predicates, one in another
    normalise: str = "softmax"  #: softmax, log+softmax or none
    syntax: str = "classic"  #: of rules given as text
    top: int = 10  #: answers that a session shows

    @staticmethod
    def help() -> str:
        return "max_depth: how deep calls of defined predicates go\nnormalise: softmax, log+softmax or none\nsyntax: classic or pythonic rules\ntop: answers that a session shows"


class Engine:
    """Plans and evaluates modes of a program.

    ``rules`` may be text, a rule set, or a file name ending in ``.ppr`` or
    ``.tlog`` (several with ``:``).  With ``rule_features``, features in rules
    become weights; ``initial_weights`` sets their first values.
    """

    def __init__(self, db: Database, rules: str | RuleSet, settings: Settings = Settings(), rule_features: bool = True, initial_weights: bool = True, epsilon: float = 1.0, rule_ids_from: str | None = None):
        self.db, self.settings, self.normalise = db, settings, settings.normalise
        if isinstance(rules, str):
            first = rules.split(":")[0]
            rules = parse_rule_files(rules) if first.endswith((".ppr", ".tlog")) and "\n" not in rules else parse_rules(rules, settings.syntax)
        self.source_rules = rules
        self.features = FeatureRules(rules, db) if rule_features else None
        plain = self.features.rules if self.features else plain_only(rules)
        self.plugin_calls: dict[str, Differentiable] = {}
        self.plugin_types: dict[str, Callable] = {}
        self.program = Program(plain, self._known, self.plugin_calls, settings.max_depth, self._types)
        if self.features and initial_weights:
            self.set_weights(epsilon, rule_ids_from)

    def _known(self, functor: str, arity: int) -> bool:
        return self.db.has(functor, arity) or (functor, arity) in self.db.parameters

    def _types(self, functor: str, arity: int) -> tuple[str, ...] | None:
        if f"{functor}/{arity}" in self.plugin_types:
            return self.plugin_types[f"{functor}/{arity}"]
        return self.db.argument_types(functor, arity)

    def set_weights(self, epsilon: float = 1.0, rule_ids_from: str | None = None) -> None:
        """First values of all feature and rule weights."""
        feature_weights(self.db, self.features, self.program, epsilon)
        if self.features.rule_ids and not (self.db.typed and not rule_ids_from):
            rule_weights(self.db, self.features, epsilon, rule_ids_from)

    def set_depth(self, depth: int) -> None:
        self.program = Program(self.program.rules, self._known, self.plugin_calls, depth, self._types)

    def plugin(self, predicate: str, call: Callable[..., DataFrame] | Differentiable, types: tuple[str, ...] | None = None, backward: Callable | None = None, parameters: Iterable[tuple[str, int]] = ()) -> None:
        """A predicate computed by a function: ``f/2`` gets a message and gives
        one; ``f/1`` gets nothing and gives (id, w).  ``backward``, and the
        ``parameters`` it has gradients of, let training pass through it; see
        :mod:`weft.operators.plugins`, whose plugins have both."""
        self.plugin_calls[predicate] = call if hasattr(call, "value") else Function(call, backward, set(parameters))
        if types:
            self.plugin_types[predicate] = types

    # -- asking -------------------------------------------------------------

    def batch(self, inputs: DataFrame | Iterable[str], strict: bool = False) -> DataFrame:
        """(qid, id, w) from symbols, a DataFrame with a column x, or a batch."""
        if not isinstance(inputs, DataFrame):
            return self.db.onehot(list(inputs), strict=strict)
        if "qid" in inputs.columns:
            return inputs.select("qid", "id", "w")
        return inputs.select(F.col("x").alias("qid"), F.col("x").alias("id"), F.lit(1.0).alias("w")).distinct()

    def evaluation(self, inputs: DataFrame | Iterable[str]) -> Evaluation:
        return Evaluation(self.db, self.batch(inputs), self.plugin_calls)

    def proof_count_batch(self, mode: str | Mode, batch: DataFrame, own_ids: bool = False) -> DataFrame:
        """(qid, id, w): sums over proofs of products of weights.  With
        ``own_ids`` no symbol is asked by very many queries."""
        ev = Evaluation(self.db, batch, self.plugin_calls, program=self.program, own_ids=own_ids)
        return ev.scores(self.program.plan(mode, calls=True))

    def inference_batch(self, mode: str | Mode, batch: DataFrame, own_ids: bool = False, underflown: bool = False) -> DataFrame:
        """(qid, id, w), normalised as set; with ``underflown`` also the answers
        whose weight is too small for a double, at zero."""
        ev = Evaluation(self.db, batch, self.plugin_calls, program=self.program, own_ids=own_ids)
        return normalised(ev.scores(self.program.plan(mode, calls=True)), ev.queries, self.normalise, underflown)

    def _answers(self, mode, inputs, ask) -> DataFrame:
        if isinstance(inputs, DataFrame) and "qid" not in inputs.columns:
            # one query a symbol: the symbol itself is the query's key
            batch = inputs.filter("x is not null").select(F.col("x").alias("qid"), F.col("x").alias("id"), F.lit(1.0).alias("w")).distinct()
            return ask(mode, batch, True).select(F.col("qid").alias("x"), F.col("id").alias("y"), "w")
        batch = self.batch(inputs, strict=not isinstance(inputs, DataFrame))
        names = batch.select("qid", F.col("id").alias("x"))
        return ask(mode, batch, not isinstance(inputs, DataFrame)).join(names, "qid").select("x", F.col("id").alias("y"), "w")

    def proof_count(self, mode: str | Mode, inputs: DataFrame | Iterable[str]) -> DataFrame:
        """(x, y, w) for each input symbol; a DataFrame has a column x."""
        return self._answers(mode, inputs, self.proof_count_batch)

    def inference(self, mode: str | Mode, inputs: DataFrame | Iterable[str]) -> DataFrame:
        """(x, y, w), normalised as set."""
        return self._answers(mode, inputs, self.inference_batch)

    def prepare(self, *modes: str | Mode, **options) -> Prepared:
        """Answers of all inputs of some modes, stored for batches to look up."""
        return Prepared(self, modes, **options)

    def eval(self, mode: str | Mode, symbols: str | list[str], strict: bool = True) -> dict[int, dict[str, float]]:
        """Answers of a few symbols as dictionaries."""
        return row_symbols(self.inference_batch(mode, self.db.onehot(symbols, strict=strict), own_ids=True))

    def loss(self, mode: str | Mode, x: DataFrame, y: DataFrame) -> DataFrame:
        """(cross_entropy, n) of a batch."""
        from weft.learn import cross_entropy

        return cross_entropy(y, self.inference_batch(mode, x, underflown=True), x.select("qid").distinct())

    def loss_gradient(self, mode: str | Mode, x: DataFrame, y: DataFrame, densify: bool = False) -> dict[tuple[str, int], DataFrame]:
        """Gradients of the log-likelihood by parameter, summed over the batch."""
        from weft.learn import Learner

        return Learner(self, densify=densify).gradient(mode, x, y).by_parameter

    # -- looking ------------------------------------------------------------

    def explain(self, mode: str | Mode, inputs: DataFrame | Iterable[str] | None = None) -> str:
        """The plan, and for given inputs the orders that are chosen for them."""
        text = f"{mode}: {self.normalise}\n{explain(self.program.plan(mode))}"
        if inputs is None:
            return text
        ev = Evaluation(self.db, self.batch(inputs), self.plugin_calls, program=self.program)
        ev.scores(self.program.plan(mode, calls=True))
        return "\n".join([text, *ev.choices])

    def show_messages(self, mode: str | Mode, inputs: Iterable[str], rows: int = 5) -> str:
        """Each node of the plan with some of its message."""
        ev, out = self.evaluation(inputs), []
        root = self.program.plan(mode)
        ev.of(root)
        for node in in_order(root):
            got = ev.made[id(node)]
            cols = [c for c in ("qid", "id", "w") if c in got.columns]
            out.append(f"#{node.number} {node.label()}: " + "; ".join(" ".join(map(str, r)) for r in got.select(*cols).sort(F.col("w").desc(), "id").limit(rows).collect()))
        return "\n".join(out)

    def show_deltas(self, mode: str | Mode, x: DataFrame, y: DataFrame, rows: int = 5) -> str:
        """Each node of the plan, from the answers back, with some of the
        derivative of the log-likelihood by its message."""
        from weft.learn import Learner

        seen: list = []
        Learner(self).gradient(mode, x, y, seen)
        out = []
        for node, delta in seen:
            cols = [c for c in ("qid", "id", "w") if c in delta.columns]
            out.append(f"#{node.number} {node.label()}: " + "; ".join(" ".join(map(str, r)) for r in delta.select(*cols).sort(F.abs("w").desc(), "id").limit(rows).collect()))
        return "\n".join(out)

    def message_counts(self, mode: str | Mode, inputs: DataFrame | Iterable[str]) -> DataFrame:
        """(number, node, rows, not_a_number, least, largest, total) of each
        message of the plan, the last three over weights that are numbers; for
        debugging.  All are counted in one job, in which steps and sums are kept."""
        ev = Evaluation(self.db, self.batch(inputs), self.plugin_calls, keep=True)
        root = self.program.plan(mode)
        ev.of(root)
        number, odd, out = F.when(~F.isnan("w"), F.col("w")), F.when(F.isnan("w"), 1), None
        for node in in_order(root):
            one = ev.made[id(node)].agg(F.count(F.lit(1)).alias("rows"), F.count(odd).alias("not_a_number"), F.min(number).alias("least"), F.max(number).alias("largest"), F.sum(number).alias("total"))
            one = one.select(F.lit(node.number).cast("long").alias("number"), F.lit(node.label()).alias("node"), *one.columns)
            out = one if out is None else out.unionByName(one)
        out = written(out.coalesce(1), "counts")
        ev.release()
        return out

    def check_numbers(self, mode: str | Mode, inputs: DataFrame | Iterable[str]) -> int:
        """How many weights of any message are not a number."""
        return self.message_counts(mode, inputs).agg(F.sum("not_a_number")).first()[0]

    def possible_ops(self, type_name: str | None = None) -> list[str]:
        stored = self.db.possible_ops(type_name)
        return stored + [f"{f}/{p}" for f, n in self.program.rules.heads() for p in ("io", "oi") if n == 2 and type_name in (None, self.program.input_type(f"{f}/{p}"))]

    def parameters(self) -> list[tuple[str, int]]:
        return sorted(self.db.parameters)

    def learned(self, functor: str, arity: int) -> DataFrame:
        return self.db.parameter(functor, arity)

    def save(self, path: str) -> None:
        from weft.sources.store import save_program

        if self.plugin_calls:
            log.warning("plugins are not saved: %s", ", ".join(sorted(self.plugin_calls)))
        save_program(self.source_rules, self.db, path)


class Session:
    """A small command surface: list, eval and set, with printed results."""

    def __init__(self, engine: Engine):
        self.engine, self.top = engine, engine.settings.top

    def set(self, depth: int | None = None, echo: int | None = None, normalise: str | None = None) -> None:
        if depth is not None:
            self.engine.set_depth(depth)
        if echo is not None:
            self.top = echo
        if normalise is not None:
            self.engine.normalise = normalise

    def list(self, what: str | None = None) -> str:
        """Everything; rules or facts of ``f/2``; or the plan of ``f/io``."""
        rules, db = self.engine.program.rules, self.engine.db
        if what is None:
            return rules.to_text() + "\n" + db.listing()
        functor, _, rest = what.partition("/")
        if not rest.isdigit():
            return self.engine.explain(what)
        if (functor, int(rest)) in rules:
            return "\n".join(map(str, rules.rules_for(functor, int(rest))))
        return "\n".join(f"{r.functor}/{r.arity}: {r.facts} facts" for r in db.sizes(functor).collect() if r.arity == int(rest))

    def eval(self, mode: str, symbol: str) -> dict[str, float]:
        batch = self.engine.db.onehot(symbol)
        p = self.engine.inference_batch(mode, batch, own_ids=True)
        for r in ranked(p, self.top).sort("rank").collect() if self.top else ():
            print(f"{r['rank']}\t{r.w:g}\t{r.id}")
        return row_symbols(p).get(0, {})

    def help(self) -> str:
        return "list(), list('f/2'), list('f/io'), eval('f/io', symbol), set(depth=, echo=, normalise=)\n" + Settings.help()


def facts_and_rules(spark: SparkSession, facts: Iterable[str], rules: str, **options) -> Engine:
    """An engine from lines of facts and text of rules."""
    from weft.sources.facts import load_lines

    return Engine(load_lines(spark, facts), rules, **options)
