"""Linear recursions by doubling against sums of matrix powers, and against levels one by one."""

import random

import numpy as np
import pytest

from weft.catalog import Database
from weft.engine import Engine, Settings
from weft.operators import lower
from weft.plans.order import Size, doubled_cost, unrolled_cost
from weft.plans.parse import parse_rules
from weft.plans.planner import Program
from weft.plans.terms import Mode

N = 6
rng = random.Random(9)
A = np.array([[rng.choice([0, 0, 0.25, 0.5]) for _ in range(N)] for _ in range(N)])
B = np.array([[rng.choice([0, 1.0, 2.0]) for _ in range(N)] for _ in range(N)])
KEEP = np.array([1.0, 0.0, 0.5, 1.0, 2.0, 1.0])


def cells(m):
    return {(f"s{i}", f"s{j}"): w for (i, j), w in np.ndenumerate(m) if w}


@pytest.fixture(scope="module")
def facts(spark):
    db = Database(spark)
    for name, m in (("hop", A), ("leaf", B)):
        db.add(name, spark.createDataFrame([(*k, float(w)) for k, w in cells(m).items()], "src string, dst string, w double"))
    db.add("open", spark.createDataFrame([(f"s{i}", float(w)) for i, w in enumerate(KEEP) if w], "id string, w double"))
    return db


def levels(step, terms):
    return sum(np.linalg.matrix_power(step, k) for k in range(terms))


@pytest.mark.parametrize("terms", [1, 2, 3, 6, 13, 16])
def test_sums_of_powers(facts, spark, terms):
    message = spark.createDataFrame([("q", "s0", 1.0), ("q", "s3", 0.5), ("r", "s4", 2.0)], "qid string, id string, w double")
    got = {(r.qid, r.id): r.w for r in lower.doubled(message, facts.binary("hop"), terms).collect()}
    start = np.array([[1.0, 0, 0, 0.5, 0, 0], [0, 0, 0, 0, 2.0, 0]])
    want = {("qr"[i], f"s{j}"): w for (i, j), w in np.ndenumerate(start @ levels(A, terms)) if w}
    assert got == pytest.approx(want)


FILTERED = A @ np.diag(KEEP)
CASES = {
    "front, one relation": ("p(X,Y) :- leaf(X,Y). p(X,Y) :- hop(X,Z), p(Z,Y).", lambda n: levels(A, n) @ B),
    "front, a relation and a filter": ("p(X,Y) :- leaf(X,Y). p(X,Y) :- hop(X,Z), open(Z), p(Z,Y).", lambda n: levels(FILTERED, n) @ B),
    "end, one relation": ("p(X,Y) :- leaf(X,Y). p(X,Y) :- p(X,Z), hop(Z,Y).", lambda n: B @ levels(A, n)),
    "end, against the relation, two bases": ("p(X,Y) :- leaf(X,Y). p(X,Y) :- hop(X,Y). p(X,Y) :- p(X,Z), hop(Y,Z).", lambda n: (B + A) @ levels(A.T, n)),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("mode", ["p/io", "p/oi"])
def test_recursions(facts, spark, monkeypatch, case, mode):
    rules, value = CASES[case]
    monkeypatch.setattr(lower, "DOUBLED_FROM", 2)
    monkeypatch.setattr(lower, "unrolled_cost", lambda *a: float("inf"))
    engine = Engine(facts, rules, Settings(max_depth=5, normalise="none"))
    x = spark.createDataFrame([(f"s{i}",) for i in range(N)], "x string")
    got = {(r.x, r.y): r.w for r in engine.inference(mode, x).collect()}
    want = value(6) if mode == "p/io" else value(6).T
    assert got == pytest.approx(cells(want))
    assert "by doubling" in engine.explain(mode, x).splitlines()[-1]


def test_what_is_linear(facts):
    def linear(rules, mode="p/io"):
        return Program(parse_rules(rules), facts.has).linear(Mode.parse(mode))

    assert linear(CASES["front, one relation"][0]).front and linear(CASES["front, one relation"][0]).single == ("hop", "forward")
    assert not linear(CASES["front, one relation"][0], "p/oi").front and linear(CASES["front, one relation"][0], "p/oi").single == ("hop", "backward")
    assert linear(CASES["front, a relation and a filter"][0]).single is None
    for other in (
        "p(X,Y) :- leaf(X,Y).",  # doesn't call itself
        "p(X,Y) :- leaf(X,Y). p(X,Y) :- p(X,Z), p(Z,Y).",  # twice
        "p(X,Y) :- leaf(X,Y). p(X,Y) :- hop(X,Z), p(Y,Z).",  # in the other direction
        "p(X,Y) :- leaf(X,Y). p(X,Y) :- hop(X,Z), p(Z,Y), open(Y).",  # what it gives is filtered
        "h(X,Y) :- hop(X,Y). p(X,Y) :- leaf(X,Y). p(X,Y) :- h(X,Z), p(Z,Y).",  # a defined goal has fewer levels left each time
        "p(X,Y) :- hop(X,Z), p(Z,Y).",  # no base
    ):
        assert linear(other) is None


def test_the_cheaper_way_is_taken(facts, spark):
    """Few levels, or a message that stays small over a large relation, go one by one."""
    small, large = Size(25, 25, 25), Size(1e9, 1e7, 1e7)
    assert doubled_cost(small, small, 65) < unrolled_cost(small, small, 65)
    assert doubled_cost(Size(10, 10, 10), large, 9) > unrolled_cost(Size(10, 10, 10), large, 9)
    engine = Engine(facts, CASES["front, one relation"][0], Settings(max_depth=6, normalise="none"))
    assert "doubling" not in engine.explain("p/io", ["s0"])
