"""Rules as text, in both syntaxes, and as Python expressions."""

import pytest

from weft.builder import Builder
from weft.plans.parse import NoRule, parse_goal, parse_rule, parse_rules
from weft.plans.terms import Goal, Mode, Rule

CLASSIC = """
# a comment
p(X,Y) :- q(X,Z), r(Z,Y).
p(X,Y) :- q(X,Y) {r1}.
p(X,Y) :- assign(Y,'it''s') , q(X,Z) {w(F) : has(X,F), good(F)}.
"""
PYTHONIC = """
p(X,Y) <= q(X,Z) & r(Z,Y)
p(X,Y) <= q(X,Y) // r1
p(X,Y) <= assign(Y,'it\\'s') & q(X,Z) // w(F) | has(X,F) & good(F)
"""


def test_both_syntaxes_agree():
    classic, pythonic = parse_rules(CLASSIC.replace("''", "\\'")), parse_rules(PYTHONIC, "pythonic")
    assert classic == pythonic and len(classic) == 3
    for syntax in ("classic", "pythonic"):
        assert parse_rules(classic.to_text(syntax), syntax) == classic


def test_the_reader_scans():
    rules = parse_rules("p(X,Y) :- q(X,Y). @@ nonsense ( p(X,Y) :- r(X,Y). tail")
    assert [str(r) for r in rules] == ["p(X,Y) :- q(X,Y).", "p(X,Y) :- r(X,Y)."]
    with pytest.raises(NoRule):
        parse_rule("p(X,Y) :- q(X,")
    with pytest.raises(NoRule):
        parse_goal("p(X,Y) q")
    assert parse_goal("p('a b',X).") == Goal("p", ("a b", "X"))


def test_modes():
    assert Mode.parse("p(i,o)") == Mode.parse("p/io") == Mode("p", "io")
    with pytest.raises(ValueError):
        Mode.parse("p/x")


def test_builder(spark):
    b = Builder(spark)
    A, B, C, K, T = b.variables("A B C K T")
    offers, lends, twin = b.predicates("offers lends twin")
    about, taste, liking = b.predicates("about, taste, liking")
    b += offers(B, K) <= twin(B, C) & lends(C, K)
    b.rules += offers(B, K) <= lends(B, K) // b.rule_id("rules", "own")
    b += offers(B, K) <= lends(B, K) // (liking(T) | taste(B, A) & about(T, A))
    assert [str(r) for r in b.rule_set] == [
        "offers(B,K) :- twin(B,C), lends(C,K).",
        "offers(B,K) :- lends(B,K) {weight(Own) : assign(Own,own,rules)}.",
        "offers(B,K) :- lends(B,K) {liking(T) : taste(B,A),about(T,A)}.",
    ]
    b.schema += lends("branch", "book") & twin("branch", "branch")
    assert b.database().types == {("lends", 2): ("branch", "book"), ("twin", 2): ("branch", "branch")}
    assert isinstance(next(iter(b.rule_set)), Rule)
