"""Tables of called predicates hold what is asked, and no more."""

import pytest
from pyspark.sql import functions as F

from library import Prover
from weft.catalog import Database
from weft.engine import Engine, Settings
from weft.scratch import intermediates

EDGE = "src string, dst string, w double"
TAGS = {(f"i{i}", f"t{(i * 7 + k) % 40}"): 1.0 + k for i in range(1000) for k in range(2)}
BELOW = {(f"t{i}", f"z{i % 4}"): 0.5 for i in range(40)}
#: A hundred users like five of a thousand items; two of them another five.
LIKES = {(f"u{u}", f"i{(u + k) % 5}"): 1.0 for u in range(100) for k in range(3)}
SEES = {(f"u{u}", f"i{(u + k) % 5 + 3}"): 2.0 for u in range(100) for k in range(4)}
RULES = """tagged(I,Z) :- tag(I,T), below(T,Z). likes_tag(U,Z) :- likes(U,I), tagged(I,Z).
both(U,Z) :- likes(U,I), tagged(I,Z). both(U,Z) :- sees(U,I), tagged(I,Z)."""


@pytest.fixture(scope="module")
def engine(spark):
    db = Database(spark)
    for name, facts in (("tag", TAGS), ("below", BELOW), ("likes", LIKES), ("sees", SEES)):
        db.add(name, spark.createDataFrame([(*k, w) for k, w in facts.items()], EDGE).coalesce(1))
    return Engine(db, RULES, Settings(normalise="none"))


def asked(spark, engine, mode):
    """(answers, inputs of the tables that were made for them, what was chosen)."""
    x = engine.db.binary("likes").select(F.col("src").alias("x")).distinct()
    with intermediates(spark) as paths:
        got = {(r.x, r.y): r.w for r in engine.proof_count(mode, x).collect()}
        inputs = [r.src for p in paths if "weft-table-" in p for r in spark.read.schema(EDGE).parquet(p).select("src").distinct().collect()]
    return got, inputs, engine.explain(mode, x)


def test_only_what_is_asked(spark, engine):
    got, inputs, chosen = asked(spark, engine, "likes_tag/io")
    assert sorted(inputs) == [f"i{i}" for i in range(5)] and "from a table of what is asked: about 5 of " in chosen
    facts = {"tag": TAGS, "below": BELOW, "likes": LIKES, "sees": SEES}
    assert got == pytest.approx(Prover(RULES, facts).relation("likes_tag"))


def test_another_call_adds_to_the_table(spark, engine):
    got, inputs, _ = asked(spark, engine, "both/io")
    assert sorted(inputs) == [f"i{i}" for i in range(8)]  # i3 and i4, asked twice, are made once
    facts = {"tag": TAGS, "below": BELOW, "likes": LIKES, "sees": SEES}
    assert got == pytest.approx(Prover(RULES, facts).relation("both"))


def test_all_inputs_where_most_are_asked(spark):
    db = Database(spark).add("likes", spark.createDataFrame([(f"u{u}", f"i{i}", 1.0) for u in range(60) for i in range(8)], EDGE))
    db.add("tag", spark.createDataFrame([(f"i{i}", f"t{i % 3}", 1.0) for i in range(10)], EDGE))
    engine = Engine(db, "h(I,T) :- tag(I,T). r(U,T) :- likes(U,I), h(I,T).", Settings(normalise="none"))
    got, inputs, chosen = asked(spark, engine, "r/io")
    assert sorted(inputs) == sorted(f"i{i}" for i in range(10)) and "what is asked" not in chosen
    assert got == {(f"u{u}", f"t{t}"): (3.0, 3.0, 2.0)[t] for u in range(60) for t in range(3)}
