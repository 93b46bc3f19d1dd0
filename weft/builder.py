"""Rules as Python expressions.

    b = Builder(spark)
    B, C, K, T = b.variables("B C K T")
    offers, lends, twin, liking, about = b.predicates("offers lends twin liking about")
    b += offers(B, K) <= twin(B, C) & lends(C, K)
    b += offers(B, K) <= lends(B, K) // b.rule_id("rules", "own")
    b += offers(B, K) <= lends(B, K) // (liking(T) | about(K, T))
    b.schema += lends("branch", "book")
    b.db += "libraries.cfacts"
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from weft.catalog import Database
from weft.plans.planner import ASSIGN
from weft.plans.terms import Goal, Rule, RuleSet
from weft.sources.facts import load_files


def _names(text: str) -> list[str]:
    return re.findall(r"\w+", text)


@dataclass(frozen=True)
class Part:
    """Goals, and features for them; a whole rule once it has a head."""

    goals: tuple[Goal, ...] = ()
    features: tuple[Goal, ...] | None = None
    findall: tuple[Goal, ...] | None = None
    head: Goal | None = None

    def __and__(self, other: Part) -> Part:
        return Part(self.goals + other.goals, other.features or self.features, other.findall or self.findall)

    def __or__(self, other: Part) -> Part:
        return Part((), self.goals, other.goals)

    def __floordiv__(self, other: Part) -> Part:
        if other.features is None:
            return replace(self, features=other.goals)
        return replace(self, features=other.features, findall=other.findall)

    def __le__(self, body: Part) -> Part:
        return replace(body, head=self.goals[0])

    def rule(self) -> Rule:
        if self.head is None:
            raise ValueError("a rule has a head: head(X,Y) <= body")
        return Rule(self.head, self.goals, self.features, self.findall)

    def __str__(self) -> str:
        return str(self.rule()) if self.head else " & ".join(map(str, self.goals))


class _Added:
    """Takes ``+=`` and a plain assignment alike."""

    def __init__(self, take):
        self.take = take

    def __iadd__(self, other):
        self.take(other)
        return self


class Builder:
    def __init__(self, spark: SparkSession):
        object.__setattr__(self, "_made", {"spark": spark, "rules": RuleSet(), "files": [], "declared": []})

    variables = types = staticmethod(_names)

    @staticmethod
    def variable(name: str) -> str:
        return _names(name)[0]

    @staticmethod
    def predicates(names: str) -> list:
        return [lambda *args, f=n: Part((Goal(f, tuple(args)),)) for n in _names(names)]

    @classmethod
    def predicate(cls, name: str):
        return cls.predicates(name)[0]

    @staticmethod
    def rule_ids(type_name: str, names: str) -> list[Part]:
        return [Part((), (Goal("weight", (n[:1].upper() + n[1:],)),), (Goal(ASSIGN, (n[:1].upper() + n[1:], n, type_name)),)) for n in _names(names)]

    @classmethod
    def rule_id(cls, type_name: str, name: str) -> Part:
        return cls.rule_ids(type_name, name)[0]

    def __iadd__(self, part: Part) -> Builder:
        self._made["rules"].add(part.rule())
        return self

    @property
    def rule_set(self) -> RuleSet:
        return self._made["rules"]

    def __getattr__(self, name: str):
        made = object.__getattribute__(self, "_made")
        if name == "rules":
            return _Added(lambda p: made["rules"].add(p.rule()))
        if name == "schema":
            return _Added(lambda p: made["declared"].extend(p.goals))
        if name == "db":
            return _Added(lambda f: made["files"].extend(f.split(":")))
        raise AttributeError(name)

    def __setattr__(self, name: str, value) -> None:
        if isinstance(value, _Added):
            return  # what += gives back
        if name != "db":
            raise AttributeError(name)
        self._made["files"][:] = value.split(":")

    def database(self) -> Database:
        db = Database(self._made["spark"])
        for g in self._made["declared"]:
            db.declare(g.functor, *g.args)
        return load_files(self._made["spark"], list(self._made["files"]), db) if self._made["files"] else db
