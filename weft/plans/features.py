"""Rule features as ordinary goals, and first values for their weights.

``{r}`` weighs a rule by one parameter fact; ``{w(F): generators}`` weighs each
solution of the generators by a parameter relation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.catalog import Database
from weft.plans.planner import ASSIGN, Program, UnsupportedRule
from weft.plans.terms import Goal, Rule, RuleSet

RULE_WEIGHTS = "weighted"


def plain_only(rules: RuleSet) -> RuleSet:
    """The rules as they are; an error if one has features."""
    for r in rules:
        if r.features:
            raise UnsupportedRule(f"features are not allowed here: {r}")
    return rules


class FeatureRules:
    """Rules without features, the ids of rules, and where weights come from."""

    def __init__(self, rules: RuleSet, db: Database):
        self.rule_ids: list[str] = []
        self.domains: dict[str, list[tuple[str, str]]] = {}  # weight: (generator, pattern)
        self.rules = RuleSet(self._plain(r, db) for r in rules)

    def _plain(self, rule: Rule, db: Database) -> Rule:
        if rule.features is None:
            return Rule(rule.head, rule.body)
        if len(rule.features) != 1:
            raise UnsupportedRule(f"one feature at a time: {rule}")
        feature = rule.features[0]
        if not rule.findall:
            if feature.arity:
                raise UnsupportedRule(f"a feature with arguments needs generators: {rule}")
            variable = feature.functor.upper() if feature.functor[:1].isalpha() else "_" + feature.functor.upper()
            self.rule_ids.append(feature.functor)
            return Rule(rule.head, (*rule.body, Goal(ASSIGN, (variable, feature.functor)), Goal(RULE_WEIGHTS, (variable,))))
        if feature.arity != 1:
            raise UnsupportedRule(f"a generated feature has one argument: {rule}")
        db.mark_parameter(feature.functor, 1)
        made = tuple(g for g in rule.findall if g.arity or g.functor != "true")
        for g in made:
            if g.arity == 2 and feature.args[0] in g.args:
                self.domains.setdefault(feature.functor, []).append((g.functor, "src" if g.args[0] == feature.args[0] else "dst"))
        return Rule(rule.head, (*rule.body, *made, feature))


def rule_weights(db: Database, features: FeatureRules, epsilon: float = 1.0, ids_from: str | None = None) -> None:
    """``weighted/1``: epsilon for each rule id, or a unary relation times epsilon."""
    if not features.rule_ids:
        return
    db.mark_parameter(RULE_WEIGHTS, 1)
    if ids_from:
        db.set_parameter(RULE_WEIGHTS, 1, db.unary(ids_from).withColumn("w", F.col("w") * epsilon))
    elif db.typed:
        raise ValueError("a typed database needs a relation that lists the rule ids")
    else:
        db.set_parameter(RULE_WEIGHTS, 1, db.spark.createDataFrame([(r, float(epsilon)) for r in dict.fromkeys(features.rule_ids)], "id string, w double"))


def feature_weights(db: Database, features: FeatureRules, program: Program, epsilon: float = 1.0) -> None:
    """First values for generated features: untyped, the mean over generators
    of the weights' sums, at most 1, times epsilon; typed, epsilon for every
    symbol of the inferred type."""
    if db.typed:
        for rule in program.rules:
            types = program.variable_types(rule)
            for g in rule.body:
                if g.arity == 1 and (g.functor, 1) in db.parameters and g.args[0] in types and (g.functor, 1) not in db.types:
                    db.declare(g.functor, types[g.args[0]])
        for functor, arity in sorted(db.parameters):
            if arity == 1 and (functor, 1) in db.types and functor != RULE_WEIGHTS:
                db.set_parameter(functor, 1, db.symbols(db.types[(functor, 1)][0]).select("id", F.lit(float(epsilon)).alias("w")))
        return
    for functor, sources in features.domains.items():
        parts: list[DataFrame] = [db.binary(g).groupBy(F.col(col).alias("id")).agg(F.sum("w").alias("w")) for g, col in sources]
        total = reduce(DataFrame.unionByName, parts).groupBy("id").agg((F.sum("w") / len(parts)).alias("w"))
        db.set_parameter(functor, 1, total.select("id", (F.greatest(F.lit(0.0), F.least(F.lit(1.0), "w")) * epsilon).alias("w")))
