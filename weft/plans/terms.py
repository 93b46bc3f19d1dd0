"""Goals, rules, modes and type declarations."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

PLAIN = re.compile(r"[A-Za-z0-9_$]+\Z")


def is_variable(atom: str) -> bool:
    return atom[:1].isupper() or atom[:1] == "_"


def quoted(atom: str) -> str:
    """An atom as rules write it: in quotes unless it is plain."""
    if PLAIN.match(atom):
        return atom
    return "'" + atom.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Goal:
    functor: str
    args: tuple[str, ...] = ()

    @property
    def arity(self) -> int:
        return len(self.args)

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(a for a in self.args if is_variable(a)))

    def __str__(self) -> str:
        return quoted(self.functor) + (f"({','.join(map(quoted, self.args))})" if self.args else "")


@dataclass(frozen=True)
class Rule:
    """head :- body, with features for each solution of findall."""

    head: Goal
    body: tuple[Goal, ...]
    features: tuple[Goal, ...] | None = None
    findall: tuple[Goal, ...] | None = None

    def to_text(self, syntax: str = "classic") -> str:
        """As either syntax writes it: ``classic`` or ``pythonic``."""
        features = self.features or ()
        if syntax == "classic":
            tail = f" {{{','.join(map(str, features))}{' : ' + ','.join(map(str, self.findall)) if self.findall else ''}}}" if features else ""
            return f"{self.head} :- {', '.join(map(str, self.body))}{tail}."
        if syntax != "pythonic":
            raise ValueError(f"no such syntax: {syntax}")
        tail = f" // {' & '.join(map(str, features))}{' | ' + ' & '.join(map(str, self.findall)) if self.findall else ''}" if features else ""
        return f"{self.head} <= {' & '.join(map(str, self.body))}{tail}"

    def __str__(self) -> str:
        return self.to_text()


class RuleSet:
    """Rules by head, in the order they were added."""

    def __init__(self, rules: Iterable[Rule] = ()):
        self._by_head: dict[tuple[str, int], list[Rule]] = {}
        for r in rules:
            self.add(r)

    def add(self, rule: Rule) -> None:
        self._by_head.setdefault((rule.head.functor, rule.head.arity), []).append(rule)

    def rules_for(self, functor: str, arity: int = 2) -> list[Rule]:
        return self._by_head.get((functor, arity), [])

    def __contains__(self, key: tuple[str, int]) -> bool:
        return key in self._by_head

    def __iter__(self) -> Iterator[Rule]:
        return (r for rules in self._by_head.values() for r in rules)

    def __len__(self) -> int:
        return sum(len(r) for r in self._by_head.values())

    def heads(self) -> list[tuple[str, int]]:
        return list(self._by_head)

    def to_text(self, syntax: str = "classic") -> str:
        return "\n".join(r.to_text(syntax) for r in self)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, RuleSet) and sorted(self.to_text().split("\n")) == sorted(other.to_text().split("\n"))

    __hash__ = None  # type: ignore[assignment]


@dataclass(frozen=True)
class Mode:
    """A predicate with a direction: ``p/io`` asks for the second argument."""

    functor: str
    pattern: str

    @classmethod
    def parse(cls, text: str | Mode) -> Mode:
        if isinstance(text, Mode):
            return text
        m = re.fullmatch(r"\s*([^/(\s]+)\s*(?:/([io]+)|\(\s*([io](?:\s*,\s*[io])*)\s*\))\s*", text)
        if not m:
            raise ValueError(f"not a mode: {text!r}")
        return cls(m.group(1), m.group(2) or re.sub(r"[\s,]", "", m.group(3)))

    @property
    def arity(self) -> int:
        return len(self.pattern)

    @property
    def input_at(self) -> int:
        return self.pattern.index("i")

    @property
    def output_at(self) -> int:
        return self.pattern.index("o")

    def __str__(self) -> str:
        return f"{self.functor}/{self.pattern}"


@dataclass(frozen=True)
class TypeDecl:
    """Types of a predicate's arguments."""

    functor: str
    types: tuple[str, ...]

    def __str__(self) -> str:
        return f"{self.functor}({','.join(self.types)})"
