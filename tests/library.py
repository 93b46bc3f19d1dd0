"""A few libraries and books with weights, and a plain prover over them."""

from itertools import count

from weft.plans.parse import parse_rules
from weft.plans.terms import is_variable

#: functor: {arguments: weight}
FACTS = {
    "lends": {("north", "atlas"): 2.0, ("north", "herbal"): 1.0, ("north", "saga"): 1.0, ("south", "saga"): 3.0, ("south", "primer"): 1.0, ("quay", "atlas"): 1.0, ("quay", "ledger"): 0.5},
    "cites": {("atlas", "herbal"): 1.0, ("atlas", "ledger"): 2.0, ("saga", "atlas"): 1.0, ("primer", "herbal"): 1.0, ("primer", "saga"): 0.5, ("ledger", "primer"): 1.0},
    "wrote": {("ines", "atlas"): 1.0, ("ines", "saga"): 1.0, ("omar", "herbal"): 1.0, ("omar", "ledger"): 1.0, ("tove", "primer"): 1.0, ("tove", "saga"): 2.0},
    "twin": {("north", "quay"): 1.0, ("quay", "south"): 1.0, ("south", "north"): 1.0},
    "old": {("atlas",): 1.0, ("herbal",): 0.5, ("ledger",): 1.0},
    "open": {("north",): 1.0, ("quay",): 2.0},
}


def lines() -> list[str]:
    return ["\t".join([f, *args, f"{w:g}"]) for f, facts in FACTS.items() for args, w in facts.items()]


class Prover:
    """Sums over proofs of products of weights, found by trying everything."""

    def __init__(self, rules, facts=FACTS, max_depth=10):
        self.rules = parse_rules(rules) if isinstance(rules, str) else rules
        self.facts, self.max_depth = facts, max_depth
        self.fresh, self.known = count(), {}

    def relation(self, functor: str, depth: int = 0) -> dict:
        """{(x, y): weight} of a defined predicate."""
        if (functor, depth) not in self.known:
            out: dict = {}
            for rule in self.rules.rules_for(functor, 2) if depth <= self.max_depth else ():
                for env, w in self._body(list(rule.body), {}, depth):
                    key = tuple(env[a] for a in rule.head.args)
                    out[key] = out.get(key, 0.0) + w
            self.known[(functor, depth)] = out
        return self.known[(functor, depth)]

    def _body(self, goals, env, depth):
        if not goals:
            yield env, 1.0
            return
        goal, rest = goals[0], goals[1:]
        for more, w in self._goal(goal, env, depth):
            for whole, w2 in self._body(rest, more, depth):
                yield whole, w * w2

    def _goal(self, goal, env, depth):
        if goal.functor == "assign":
            facts, args = {(goal.args[1],): 1.0}, goal.args[:1]
        else:
            args = goal.args
            facts = self.relation(goal.functor, depth + 1) if (goal.functor, goal.arity) in self.rules else self.facts.get(goal.functor, {})
        for values, w in facts.items():
            now = dict(env)
            if all((now.setdefault(a, v) if is_variable(a) else a) == v for a, v in zip(args, values)):
                yield now, w

    def answers(self, mode: str, symbol: str) -> dict[str, float]:
        functor, pattern = mode.split("/")
        i = pattern.index("i")
        return {pair[1 - i]: w for pair, w in self.relation(functor).items() if pair[i] == symbol and w}
