"""Joins that split hubs: the same answers and gradients, and even tasks without adaptive execution."""

import os
import random

import pytest
from pyspark.sql import functions as F

from weft.catalog import Database
from weft.engine import Engine, Settings
from weft.learn import Learner
from weft.operators import hubs, lower
from weft.operators.hubs import hubs_at, met
from weft.operators.lower import Split
from weft.scratch import FIRST_PARTS, TASK_BYTES, intermediates, written

EDGE = "src string, dst string, w double"


def facts(spark, hub_rows):
    """Relations in which ``hub`` has half of the facts at one end or the other."""
    rng = random.Random(4)
    out = {(f"a{i}", "hub") for i in range(30)} | {("hub", f"b{i}") for i in range(40)}
    out |= {(f"a{rng.randrange(30)}", f"b{rng.randrange(40)}") for _ in range(60)}
    db = Database(spark, hub_rows=hub_rows)
    db.add("to", spark.createDataFrame([(a, b, 1.0 + i % 3) for i, (a, b) in enumerate(sorted(out))], EDGE))
    db.add("back", spark.createDataFrame([(b, a, 0.5) for a, b in sorted(out) if a != "hub"] + [("hub", "hub", 2.0)], EDGE))
    db.add("kept", spark.createDataFrame([("hub", 0.5), ("b1", 2.0), ("a3", 1.0)], "id string, w double"))
    return db


RULES = {
    "step": "p(X,Y) :- to(X,Y).",
    "through the hub": "p(X,Y) :- to(X,Z), to(Z,Y).",
    "run of three": "p(X,Y) :- to(X,Z), to(Z,U), back(U,Y).",
    "filter": "p(X,Y) :- to(X,Z), kept(Z), back(Z,Y).",
    "call": "p(X,Y) :- q(X,Z), to(Z,Y). q(X,Y) :- to(X,Y). q(X,Y) :- back(Y,X).",
    "recursion": "p(X,Y) :- to(X,Y). p(X,Y) :- back(X,Z), p(Z,Y).",
}


@pytest.fixture(scope="module")
def both(spark):
    """The same facts, with hubs whole and split."""
    return facts(spark, 1_000_000), facts(spark, 7)


def asked(db, rules, mode):
    engine = Engine(db, rules, Settings(normalise="none", max_depth=3))
    x = db.symbols().select(F.col("id").alias("x"))
    return {(r.x, r.y): r.w for r in engine.proof_count(mode, x).collect()}


@pytest.mark.parametrize("rules, mode", [(r, "p/io") for r in RULES] + [("run of three", "p/oi"), ("call", "p/oi")])
def test_answers_do_not_change(both, rules, mode):
    whole, cut = (asked(db, RULES[rules], mode) for db in both)
    assert whole and cut == pytest.approx(whole)


def test_doubled_recursion(spark):
    message = spark.createDataFrame([(q, "a1", 1.0) for q in range(20)] + [(q, "hub", 1.0) for q in range(20)], "qid long, id string, w double")
    by = facts(spark, 7).binary("back")
    hubs = hubs_at(by, ["src", "dst"], 7)
    whole, cut = ({(r.qid, r.id): r.w for r in lower.doubled(message, by, 11, s).collect()} for s in (lower.NONE, Split(hubs["dst"], hubs["src"], 7)))
    assert whole and cut == pytest.approx(whole)


def test_gradients_do_not_change(spark):
    """All queries ask the hub, or reach it."""
    x = spark.createDataFrame([(q, "hub" if q % 2 else f"a{q}", 1.0) for q in range(24)], "qid long, id string, w double")
    y = spark.createDataFrame([(q, f"b{q % 5}", 1.0) for q in range(24)], "qid long, id string, w double")
    got = []
    for rows in (1_000_000, 7):
        db = facts(spark, rows)
        db.mark_parameter("to", 2)
        db.mark_parameter("kept", 1)
        engine = Engine(db, "p(X,Y) :- to(X,Y). p(X,Y) :- to(X,Z), kept(Z), to(Z,Y).")
        by = Learner(engine).gradient("p/io", x, y).by_parameter
        got.append({(key, *r[:-1]): r.w for key, g in by.items() for r in g.collect()})
    assert got[0] and got[1] == pytest.approx(got[0])


def test_hubs_are_symbols_with_many_rows(spark):
    db = facts(spark, 25)
    assert list(db.hubs("to")["src"].values()) == [40] and list(db.hubs("to")["dst"].values()) == [30]
    assert db.hubs("back")["src"].keys() == db.hubs("to")["dst"].keys() and not db.hubs("back")["dst"]
    assert facts(spark, 1_000).hubs("to") == {"src": {}, "dst": {}}
    empty = Database(spark, hub_rows=1)
    empty.add("to", spark.createDataFrame([], EDGE))
    assert empty.hubs("to") == {"src": {}, "dst": {}}


def test_tasks_are_even_without_adaptive_execution(spark):
    """A hub of a tenth of all facts, which two in three queries hold: no task
    makes over three times the median's rows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        facts = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, "hub").otherwise(F.concat(F.lit("s"), F.col("id") % 9_000)).alias("id"), F.col("id").cast("string").alias("to"), F.lit(1.0).alias("rw"))
        message = spark.range(3_000).select(F.col("id").alias("qid"), F.when(F.col("id") % 3 > 0, "hub").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("id"), F.lit(1.0).alias("w"))
        right, left = hubs_at(facts, ["id"], 200)["id"], hubs_at(message, ["id"], 200)["id"]
        assert len(right) == len(left) == 1

        def tasks(joined):
            return sorted(r.n for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())

        whole, cut = tasks(met(message, facts, "id", {}, {}, 200)), tasks(met(message, facts, "id", left, right, 200))
        assert sum(whole) == sum(cut) and len(cut) == 32
        assert whole[-1] > 3 * whole[len(whole) // 2]
        assert cut[-1] <= 3 * cut[len(cut) // 2]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_messages_are_counted_in_one_job(both, spark):
    db = both[0].partner()
    db.set_parameter("to", 2, db.binary("to").withColumn("w", F.when(F.col("dst") == "hub", F.lit(float("nan"))).otherwise(F.col("w"))))
    engine = Engine(db, "p(X,Y) :- to(X,Z), back(Z,Y).")
    counts = {r.node: r for r in engine.message_counts("p/io", ["a1", "a2"]).collect()}
    assert counts["input"].rows == 2 and counts["input"].not_a_number == 0 and counts["input"].total == 2
    assert counts["step(to, forward)"].not_a_number == 2
    assert engine.check_numbers("p/io", ["a1", "a2"]) == sum(r.not_a_number for r in counts.values())


def test_intermediates_are_deleted(spark):
    frame = spark.range(3).toDF("x")
    with intermediates(spark) as outer:
        kept = written(frame, "outer")
        with intermediates(spark) as inner:
            assert written(frame, "inner").count() == 3
        assert len(inner) == 1 and len(outer) == 2 and kept.count() == 3
    assert not any(os.path.exists(p.removeprefix("file://")) for p in outer)
    assert written(frame, "after").count() == 3 and len(outer) == 2


def test_tasks_are_fine(spark):
    """A database lowers what a task gets, and leaves finer settings alone."""
    size, first = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.unset(size), spark.conf.unset(first)
    Database(spark)
    assert (spark.conf.get(size), spark.conf.get(first)) == (str(TASK_BYTES), str(FIRST_PARTS))
    spark.conf.set(size, "1m"), spark.conf.set(first, "5000")
    Database(spark)
    assert (spark.conf.get(size), spark.conf.get(first)) == ("1m", "5000")
    spark.conf.unset(size), spark.conf.unset(first)


@pytest.mark.parametrize("buckets", [1, 4, 1 << 16])
def test_only_full_buckets_are_counted_by_symbol(spark, monkeypatch, buckets):
    """Hubs are the same however symbols share buckets; where no bucket is full nothing else is counted."""
    monkeypatch.setattr(hubs, "BUCKETS", buckets)
    rows = facts(spark, 7).binary("to")
    many = {c: {r.h: float(r.n) for r in rows.groupBy(F.xxhash64(c).alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 7").collect()} for c in ("src", "dst")}
    assert hubs_at(rows, ["src", "dst"], 7) == many and all(many.values())
    assert hubs.full_buckets(rows, ["src", "dst"], 200) == {"src": [], "dst": []}
    assert all(0 <= b < buckets for found in hubs.full_buckets(rows, ["src", "dst"], 7).values() for b in found)


def test_only_messages_that_others_use_are_kept(both, monkeypatch):
    frame = type(both[0].binary("to"))
    kept, persist = [], frame.persist
    monkeypatch.setattr(frame, "persist", lambda df, *a: kept.append(df) or persist(df, *a))
    counts = Engine(both[0], "p(X,Y) :- to(X,Z), back(Z,Y).").message_counts("p/io", ["a1", "a2"]).collect()
    assert len(kept) == 1 and sum(r.node.startswith("step") for r in counts) == 2


def test_steps_are_cut_to_few_filtered_symbols(both):
    """Facts that a unary relation drops are dropped before they meet the message."""
    engine = Engine(both[0], RULES["filter"], Settings(normalise="none"))
    x = both[0].symbols().select(F.col("id").alias("x"))
    assert "LeftSemi" in engine.proof_count("p/io", x)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("hub_rows", [1_000_000, 7])
def test_large_steps_sum_only_queries_with_several_symbols(spark, monkeypatch, hub_rows):
    """The same answers; those of queries with one symbol aren't shuffled to be summed, and repeated facts still are."""
    def answers():
        db = facts(spark, hub_rows)
        found = [asked(db, RULES[r], "p/io") for r in ("through the hub", "run of three")]
        engine, x = Engine(db, RULES["run of three"], Settings(normalise="none")), db.symbols().select(F.col("id").alias("x"))
        return found, engine.explain("p/io", x)

    whole, told = answers()
    assert "unsummed" not in told
    monkeypatch.setattr(lower, "LARGE_STEP", 1.0)
    monkeypatch.setattr(lower, "LARGE_GAIN", 0.1)
    monkeypatch.setattr(lower, "ROWS_A_TASK", 100.0)
    cut, told = answers()
    assert "unsummed" in told and all(a and a == pytest.approx(b) for a, b in zip(cut, whole))
    db = facts(spark, hub_rows)
    db.set_parameter("to", 2, db.binary("to").union(db.binary("to")))
    assert db.is_summed("back") and not db.is_summed("to")
    doubled = asked(db, RULES["through the hub"], "p/io")
    assert doubled == pytest.approx({k: 4 * w for k, w in whole[0].items()})


def test_parts_of_two_hubs_repeat_few_rows():
    """A million queries of a symbol with 72,000 facts: parts that meet make two million rows, and neither side is repeated more than the other."""
    a, b = lower.even_parts(1_080_000, 72_000, 2e6)
    assert 1_080_000 / a * 72_000 / b <= 2e6 and 1_080_000 * b + 72_000 * a < 1.2e8
    assert lower.even_parts(3, 10_000_000, 2e6) == (1, 15) and lower.even_parts(10, 10, 2e6) == (1, 1) and lower.even_parts(5, 1e9, 1.0) == (5, 1_000_000_000)


@pytest.mark.parametrize("small_facts", [500_000, 0])
def test_large_steps_repeat_no_more_than_they_must(spark, monkeypatch, small_facts):
    """The same rows whether the relation goes to every task or hubs are cut; where each query has one symbol nothing is left to be summed."""
    db = Database(spark, hub_rows=5)
    db.add("of", spark.createDataFrame([(f"c{i}", f"n{i % 3}") for i in range(60)], "src string, dst string"))
    db.add("has", spark.createDataFrame([(f"n{i % 3}", f"s{i}") for i in range(45)], "src string, dst string"))
    monkeypatch.setattr(lower, "LARGE_STEP", 1.0)
    monkeypatch.setattr(lower, "LARGE_GAIN", 0.1)
    monkeypatch.setattr(lower, "ROWS_A_TASK", 20.0)
    monkeypatch.setattr(lower, "SMALL_FACTS", small_facts)
    out = Engine(db, "p(X,Y) :- of(X,Z), has(Z,Y).", Settings(normalise="none")).proof_count("p/io", db.binary("of").select(F.col("src").alias("x")))
    assert sorted((r.x, r.y, r.w) for r in out.collect()) == sorted((f"c{i}", f"s{k}", 1.0) for i in range(60) for k in range(45) if i % 3 == k % 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and ("hub_place" in plan) == (not small_facts)


def test_small_tables_go_where_the_queries_are(spark, monkeypatch):
    """The same answers; what the table makes of a query's rows is summed where they are, and facts are summed with them, repeated ones too."""
    db = Database(spark)
    db.add("of", spark.createDataFrame([(f"c{i}", f"p{i * k % 90}") for i in range(80) for k in (1, 2, 3, 3)], "src string, dst string"))
    db.add("kind", spark.createDataFrame([(f"p{i}", f"k{i % 4}") for i in range(90)], "src string, dst string"))
    db.add("co", spark.createDataFrame([(f"k{i}", f"k{j}") for i in range(4) for j in range(4) if i != j], "src string, dst string"))
    rules = "near(A,B) :- co(A,B). near(A,B) :- co(A,Z), near(Z,B). r(C,B) :- of(C,P), kind(P,A), near(A,B)."
    x = db.symbols().select(F.col("id").alias("x"))

    def answers():
        engine = Engine(db, rules, Settings(normalise="none", max_depth=2))
        out = engine.proof_count("r/io", x)
        return {(r.x, r.y): r.w for r in out.collect()}, out._jdf.queryExecution().optimizedPlan().toString()

    monkeypatch.setattr(lower, "SPARSE", 1e9)
    whole, plan = answers()
    assert whole and "RepartitionByExpression [qid" not in plan
    monkeypatch.setattr(lower, "SPARSE", 1.0)
    monkeypatch.setattr(lower, "MANY_QUERIES", 1)
    there, plan = answers()
    assert there == whole and "RepartitionByExpression [qid" in plan
    monkeypatch.setattr(db, "hub_rows", 2)
    db._hubs.clear()
    cut, plan = answers()
    assert cut == whole and "RepartitionByExpression [qid" not in plan
