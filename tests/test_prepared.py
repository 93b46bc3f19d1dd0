"""Prepared questions give what the engine gives, in any batches."""

import pytest
from pyspark.sql import functions as F

from weft.catalog import Database
from weft.engine import Engine, Settings
from weft.plans.planner import UnsupportedRule
from weft import prepared as P
from weft.scratch import intermediates

EDGE = "src string, dst string, w double"
RULES = "far(X,Z) :- to(X,Y), to(Y,Z). kept(X,Y) :- to(X,Y), good(Y). kept(X,Y) :- far(X,Y)."
MODES = ("far/io", "far/oi", "kept/io")


@pytest.fixture(scope="module")
def db(spark):
    facts = [(f"a{i}", f"a{(i * 3 + k) % 30}", 0.5 + k) for i in range(20) for k in range(3)] + [("hub", f"a{i}", 1.0) for i in range(30)] + [('q"\\\n', "a1", 800.0)]
    db = Database(spark).add("to", spark.createDataFrame(facts, EDGE).coalesce(1))
    return db.add("good", spark.createDataFrame([("a1", 1.0), ("a2", 2.0)], "id string, w double").coalesce(1))


def rows(df):
    return {(r.x, r.y): r.w for r in df.collect()}


@pytest.mark.parametrize("how", ["none", "softmax"])
def test_as_the_engine_answers(spark, db, monkeypatch, how):
    monkeypatch.setattr(P, "ROWS_A_PART", 40)  # several parts
    engine = Engine(db, RULES, Settings(normalise=how))
    listed = ["a0", "a0", None, "a7", "a29", "hub", "nobody", 'q"\\\n', ""]
    x = spark.createDataFrame([(s,) for s in listed], "x string").coalesce(1)
    with intermediates(spark):
        ready = engine.prepare(*MODES)
        assert ready.parts > 1
        got = ready.ask(listed).collect()
        same = ready.ask(x).collect()
        assert sorted(map(str, got)) == sorted(map(str, same))
        monkeypatch.setattr(P, "MOST_LISTED", 2)
        assert sorted(map(str, ready.ask(listed).collect())) == sorted(map(str, got))
        assert {r.mode for r in ready.ask(["hub"], ["kept/io"]).collect()} == {"kept/io"}
        assert ready.ask([]).count() == 0
    for mode in MODES:
        found = [r for r in got if r.mode == mode]
        assert {(r.x, r.y): r.w for r in found} == pytest.approx(rows(engine.inference(mode, x))) and len({(r.x, r.y) for r in found}) == len(found)


def test_parts_of_listed_symbols_alone_are_read(spark, db, monkeypatch):
    monkeypatch.setattr(P, "ROWS_A_PART", 10)
    engine = Engine(db, RULES, Settings(normalise="none"))
    with intermediates(spark):
        ready = engine.prepare("far/io")
        plan = ready.ask(["hub"])._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_stale_unknown_and_too_large(spark, db):
    other = Database(spark, dict(db.relations))
    engine = Engine(other, RULES, Settings(normalise="none"))
    with intermediates(spark):
        ready = engine.prepare("kept/io")
        with pytest.raises(ValueError, match="not prepared"):
            ready.ask(["hub"], ["far/io"])
        with pytest.raises(ValueError, match="answers, more than"):
            engine.prepare("kept/io", most_rows=5)
        other.relations[("good", 1)] = other.unary("good").withColumn("w", F.col("w") * 2)
        assert ready.stale() == ["good/1"]
        with pytest.raises(P.Stale, match="good/1"):
            ready.ask(["hub"])
        assert rows(engine.prepare("kept/io").ask(["hub"])) == pytest.approx(rows(engine.inference("kept/io", spark.createDataFrame([("hub",)], "x string"))))
    plugged = Engine(db, "p(X,Y) :- to(X,Y), same(Y,Z).")
    plugged.plugin("same/2", lambda message: message)
    with pytest.raises(UnsupportedRule):
        plugged.prepare("p/io")
