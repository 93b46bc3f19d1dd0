"""Proof counts against a prover that tries everything."""

import math

import pytest
from library import FACTS, Prover

from weft.catalog import NULL, UnknownSymbol, row_symbols
from weft.engine import Engine, Settings
from weft.plans.nodes import in_order
from weft.plans.order import Size, best_order, joined
from weft.plans.planner import UnsupportedRule
from weft.plans.terms import Mode
from weft.sources.facts import load_lines

#: Programs for r/2, by what they need of the planner.
PROGRAMS = {
    "a relation": "r(B,K) :- lends(B,K).",
    "its inverse": "r(K,B) :- lends(B,K).",
    "two ways": "r(B,K) :- lends(B,K). r(B,C) :- twin(B,C).",
    "the same way twice": "r(K,L) :- cites(K,L). r(K,L) :- cites(K,L).",
    "a chain": "r(B,L) :- lends(B,K), cites(K,L).",
    "a chain back and forth": "r(A,B) :- wrote(A,K), lends(B,K).",
    "four links": "r(A,D) :- wrote(A,K), lends(B,K), twin(B,C), lends(C,D).",
    "a tail that only has to be": "r(B,K) :- lends(B,K), cites(K,L).",
    "a longer tail": "r(B,K) :- lends(B,K), cites(K,L), wrote(A,L).",
    "a branch at the input": "r(B,C) :- twin(B,C), lends(B,K).",
    "two branches at the input": "r(B,C) :- twin(B,C), lends(B,K), lends(B,L), cites(L,M).",
    "a branch on the way": "r(A,L) :- wrote(A,K), lends(B,K), cites(K,L).",
    "goals out of order": "r(B,L) :- wrote(A,L), cites(K,L), lends(B,K).",
    "a constant answer": "r(B,V) :- assign(V,yes), lends(B,K), old(K).",
    "a constant answer by a chain": "r(A,V) :- wrote(A,K), cites(K,L), assign(V,yes).",
    "a filter on the way": "r(B,L) :- lends(B,K), old(K), cites(K,L).",
    "a filter first": "r(B,K) :- open(B), lends(B,K).",
    "a filter on the answer": "r(B,K) :- lends(B,K), old(K).",
    "a constant in a goal": "r(B,K) :- lends(B,K), cites(K,herbal).",
    "a constant in front": "r(K,A) :- cites(saga,K), wrote(A,K).",
    "a call": "h(B,K) :- lends(B,K). r(B,L) :- h(B,K), cites(K,L).",
    "a call in both directions": "h(K,L) :- cites(K,L). r(K,M) :- h(K,L), h(M,L).",
    "calls of calls": "g(K,L) :- cites(K,L). h(K,M) :- g(K,L), g(L,M). r(B,M) :- lends(B,K), h(K,M).",
    "a call that filters": "h(A,K) :- wrote(A,K). r(B,K) :- lends(B,K), h(A,K), old(K).",
    "a call of a constant": "h(K,V) :- old(K), assign(V,yes). r(B,V) :- lends(B,K), h(K,V).",
    "one call used twice": "h(B,K) :- lends(B,K). r(B,L) :- h(B,K), cites(K,L). r(B,A) :- h(B,K), wrote(A,K).",
    "citations of citations": "r(K,L) :- cites(K,L). r(K,M) :- cites(K,L), r(L,M).",
    "back and forth for ever": "r(B,C) :- twin(B,C). r(B,C) :- r(C,B).",
    "each other": "r(K,L) :- cites(K,M), s(M,L). s(K,L) :- cites(K,L). s(K,L) :- r(K,L).",
}
SYMBOLS = sorted({a for facts in FACTS.values() for args in facts for a in args})


@pytest.fixture
def engine(library):
    return lambda rules, **settings: Engine(library.partner(), rules, Settings(**settings))


def counts(e, mode, *symbols):
    return row_symbols(e.proof_count_batch(mode, e.db.onehot(list(symbols), strict=False)))


@pytest.mark.parametrize("what", PROGRAMS)
def test_counts(engine, what):
    """Every symbol asked at once, forward and, for some, back."""
    rules, depth = PROGRAMS[what], 4
    e, prover = engine(rules, max_depth=depth), Prover(rules, max_depth=depth)
    for mode in ("r/io", "r/oi")[: 1 + (list(PROGRAMS).index(what) % 3 == 0)]:
        try:
            got = counts(e, mode, *SYMBOLS)
        except UnsupportedRule:
            assert mode == "r/oi" and "constant" in what
            continue
        want = {i: a for i, s in enumerate(SYMBOLS) if (a := prover.answers(mode, s))}
        assert {q: pytest.approx(row) for q, row in got.items()} == want


@pytest.mark.parametrize("depth", [0, 1, 2, 5, 9])
def test_depth_bounds_calls(engine, depth):
    for what in ("citations of citations", "back and forth for ever", "each other"):
        prover = Prover(PROGRAMS[what], max_depth=depth)
        got = counts(engine(PROGRAMS[what], max_depth=depth), "r/io", "saga", "quay")
        assert {q: got.get(q, {}) for q in (0, 1)} == {0: pytest.approx(prover.answers("r/io", "saga")), 1: pytest.approx(prover.answers("r/io", "quay"))}


def test_softmax_has_the_null_entity(engine):
    rules = PROGRAMS["a tail that only has to be"]
    scores = Prover(rules).answers("r/io", "north")
    for how, f in (("softmax", lambda w: w), ("log+softmax", math.log1p)):
        got = engine(rules, normalise=how).eval("r/io", ["north", "omar"])
        z = sum(math.exp(f(w)) for w in scores.values()) + math.exp(-10)
        assert got[0] == pytest.approx({**{k: math.exp(f(w)) / z for k, w in scores.items()}, NULL: math.exp(-10) / z})
        assert got[1] == {NULL: 1.0}
    assert engine(rules, normalise="none").eval("r/io", "north")[0] == scores


def test_rule_features_weigh_rules(spark, engine):
    e = engine("r(B,K) :- lends(B,K) {own}. r(B,C) :- twin(B,C) {other}.")
    assert e.features.rule_ids == ["own", "other"]
    e.db.set_parameter("weighted", 1, spark.createDataFrame([("own", 0.5), ("other", 4.0)], "id string, w double"))
    assert counts(e, "r/io", "quay")[0] == {"atlas": 0.5, "ledger": 0.25, "south": 4.0}


def test_what_cannot_be_planned(engine):
    for rules in ("r(B,K) :- lends(B,L), cites(L,K), lends(B,K).", "r(B,B) :- twin(B,B).", "r(B,K) :- steals(B,K).", "r(B,K) :- lends(A,K), cites(K,L)."):
        with pytest.raises(UnsupportedRule):
            engine(rules).program.plan("r/io")
    with pytest.raises(UnsupportedRule):
        engine("r(B,K) :- lends(B,K).").program.plan("lends/io")
    with pytest.raises(UnknownSymbol):
        engine("r(B,K) :- lends(B,K).").eval("r/io", "alexandria")


def test_shared_subplans_are_one_node(engine):
    e = engine(PROGRAMS["one call used twice"])
    assert e.explain("r/io").count("see above") == 1
    assert "lends" in e.show_messages("r/io", ["quay"])
    assert e.check_numbers("r/io", ["quay"]) == 0


def test_plugins(spark, engine):
    e = engine("r(B,K) :- lends(B,L), half(L,K), rare(K).")
    e.plugin("half/2", lambda m: m.selectExpr("qid", "id", "w / 2 AS w"))
    e.plugin("rare/1", lambda: spark.createDataFrame([("atlas", 3.0)], "id string, w double"))
    assert counts(e, "r/io", "north") == {0: {"atlas": 3.0}}
    assert e.program.domain(Mode("r", "io")) is None


def test_deep_recursion_is_cut(spark):
    road = [f"road\tn{i}\tn{i + 1}" for i in range(30)]
    e = Engine(load_lines(spark, road), "far(X,Y) :- road(X,Y). far(X,Y) :- road(X,Z), far(Z,Y).", Settings(max_depth=14))
    assert len(counts(e, "far/io", "n0")[0]) == 15


def test_orders_make_few_rows():
    """Against every bracketing: estimates of a product differ a little by its bracketing, so not always the least."""
    import itertools
    import random

    rng = random.Random(6)

    def brackets(i, j):
        if i == j:
            yield i
        for k in range(i, j):
            yield from itertools.product(brackets(i, k), brackets(k + 1, j))

    def cost(tree, sizes):
        if isinstance(tree, int):
            return 0.0, sizes[tree]
        (c1, s1), (c2, s2) = cost(tree[0], sizes), cost(tree[1], sizes)
        made, left = joined(s1, s2)
        return c1 + c2 + made + left.rows, left

    for _ in range(50):
        ends = [rng.choice([3, 40, 500, 10_000]) for _ in range(6)]
        sizes = [Size(min(a * b, max(a, b) * rng.uniform(1, 9)), a, b) for a, b in zip(ends, ends[1:])]
        best, tree, _ = best_order(sizes)
        assert best == pytest.approx(cost(tree, sizes)[0])
        assert best <= 1.2 * min(cost(t, sizes)[0] for t in brackets(0, 4))


def test_orders_and_tables_follow_sizes(spark):
    """Many queries: relations are multiplied first, and calls come from a
    table; one query goes forward.  The answers are the same."""
    facts = [f"has\tu{i}\tk{i % 50}" for i in range(400)] + [f"has\tu{i}\tk{(i * 7) % 50}" for i in range(400)]
    facts += [f"of\tk{i}\tg{i % 4}" for i in range(50)] + [f"in\tg{i}\tz{i % 2}" for i in range(4)] + [f"by\tz{i}\tz{1 - i}" for i in range(2)]
    rules = "step(A,B) :- by(A,B). step(A,B) :- by(A,C), step(C,B). r(U,Z) :- has(U,K), of(K,G), in(G,Z). s(U,Y) :- has(U,K), of(K,G), in(G,Z), step(Z,Y)."
    e = Engine(load_lines(spark, facts), rules, Settings(max_depth=3, normalise="none"))
    everyone = e.db.binary("has").selectExpr("src x").distinct()
    assert "(queries . (has . (of . in)))" in e.explain("r/io", everyone)
    assert "(((queries . has) . of) . in)" in e.explain("r/io", ["u1"])
    assert "step/io from a table" in e.explain("s/io", everyone) and "from a table" not in e.explain("s/io", ["u1"])
    plain = {}
    for line in facts:
        f, a, b = line.split("\t")
        plain.setdefault(f, {}).setdefault((a, b), 0.0)
        plain[f][(a, b)] += 1.0
    for mode in ("r/io", "s/io"):
        want = Prover(rules, plain, 3).relation(mode[0])
        assert {(r.x, r.y): r.w for r in e.proof_count(mode, everyone).collect()} == pytest.approx(want)


def test_what_only_counts_is_summed_without_queries(engine):
    """No row is made for each query and word where words only add to a total."""
    program = engine("p(B,V) :- assign(V,yes), lends(B,K), old(K). q(B,V) :- assign(V,yes), lends(B,K), cites(K,L), old(L).").program
    for mode in ("p/io", "q/io"):
        steps = [n for n in in_order(program.plan(mode)) if n.kind == "step"]
        assert steps and not any(n.per_query for n in steps)


def test_large_batches_take_whole_relations(spark, engine, monkeypatch):
    """A step beside the answers is the same cut to the batch's symbols and whole."""
    rules, asked = "r(B,V) :- assign(V,yes), lends(B,K), cites(K,L), old(L).", ["north", "quay", "nobody"]
    x = spark.createDataFrame([(b,) for b in asked], "x string")
    small = {tuple(r) for r in engine(rules).proof_count("r/io", x).collect()}
    monkeypatch.setattr("weft.operators.lower.SMALL_BATCH", 0)
    assert small == {tuple(r) for r in engine(rules).proof_count("r/io", x).collect()} and {r[0] for r in small} == {"north", "quay"}
