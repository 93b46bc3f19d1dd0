"""Facts, examples, and what is saved and exported."""

import os
import time

import pytest

from weft.catalog import NULL, OOV, row_symbols
from weft.engine import Engine, Session, Settings
from weft.learn import ranked_answers
from weft.plans.terms import Goal
from weft.sources.examples import BadExample, Dataset, example_text, from_relation, load_examples
from weft.sources.facts import BadFact, load_files, load_lines
from weft.scratch import paths_of
from weft.sources.store import fresh, load_database, load_dataset, load_program, open_database, save_database, save_dataset, stored_relations


def test_fact_lines(spark):
    db = load_lines(spark, ["u\ta", "u\tb\t0.5", "p\ta\tb", "p\ta\tb", "p\ta\tc\t3", "odd name\tx", "", "# a comment"])
    assert db.facts("u", 1) == {Goal("u", ("a",)): 1.0, Goal("u", ("b",)): 0.5}
    assert db.facts("p", 2) == {Goal("p", ("a", "b")): 2.0, Goal("p", ("a", "c")): 3.0}
    assert db.has("odd name", 1)
    assert load_lines(spark, ["u\tb\t7"], weighted_tuples=False).has("u", 2)
    with pytest.raises(BadFact):
        load_lines(spark, ["p\ta\tb\t-1"])


def test_declarations(spark):
    db = load_lines(spark, ["# :- nations(year)", "# :- in(century,year)", "# :- trainable(in,2)", "# :- trainable(a,b)", "nations\t1900\t0.3", "in\t20\t1900", "lost\ta\tb"])
    assert db.types[("in", 2)] == ("century", "year") and ("trainable", 2) in db.types
    assert db.parameters == {("in", 2)} and not db.has("lost", 2)
    assert db.facts("nations", 1) == {Goal("nations", ("1900",)): 0.3} and db.has("in", 2)
    assert {r.id for r in db.symbols("year").collect()} == {NULL, OOV, "1900"}
    assert db.possible_ops("century") == ["in/io"]
    with pytest.raises(ValueError):
        db.declare("in", "year", "year")


def test_database_round_trip(spark, library, tmp_path, caplog):
    db = library.partner()
    db.mark_parameter("lends", 2)
    save_database(db, f"file://{tmp_path}/x.db")
    back = load_database(spark, f"file://{tmp_path}/x.db")
    assert back.parameters == db.parameters and back.facts("cites", 2) == db.facts("cites", 2)
    save_database(db, f"file://{tmp_path}/p.db", "parameters")
    assert set(load_database(spark, f"file://{tmp_path}/p.db").relations) == {("lends", 2)}
    some = load_database(spark, f"file://{tmp_path}/x.db", library.partner(), only=[("lends", 2)])
    assert some.parameters == {("lends", 2)} and len(some.relations) == len(library.relations)
    with pytest.raises(KeyError):
        stored_relations(spark, f"file://{tmp_path}/p.db", [("cites", 2)])
    text = tmp_path / "lends.cfacts"
    text.write_text("\n".join(r.value for r in db.fact_text("lends", 2).collect()))
    assert load_files(spark, str(text)).facts("lends", 2) == db.facts("lends", 2)
    cached = open_database(spark, f"{tmp_path}/c.db|{text}")
    assert cached.n_relations() == 1 and cached.size() == 7
    os.utime(text, (time.time() + 60, time.time() + 60))
    assert not fresh(spark, f"{tmp_path}/c.db", str(text))
    engine = Engine(db, "r(B,K) :- lends(B,K) {r1}.")
    engine.plugin("f/2", lambda m: m)
    engine.save(f"file://{tmp_path}/prog")
    assert "plugins are not saved: f/2" in caplog.text
    rules, again = load_program(spark, f"file://{tmp_path}/prog")
    assert rules == engine.source_rules and again.has("weighted", 1)


def test_examples(spark, library, tmp_path):
    exam = tmp_path / "a.exam"
    exam.write_text("p\tnorth\tsaga\tatlas\np\tquay\tledger\np\tnobody\n")
    data = load_examples(library, str(exam))
    y = row_symbols(data.labels("p/io"))
    assert sorted(map(lambda d: sorted(d.items()), y.values())) == [[("atlas", 0.5), ("saga", 0.5)], [("ledger", 1.0)]]
    assert {r.id for r in data.queries("p/io").collect()} == {"north", "quay", OOV}
    examples = tmp_path / "a.examples"
    examples.write_text("p(north,Y)\t+p(north,saga)\t-p(north,ledger)\t+p(north,atlas)\n")
    same = load_examples(library, str(examples))
    assert list(row_symbols(same.labels("p/io")).values()) == [{"atlas": 0.5, "saga": 0.5}]
    assert example_text(same, "p/io").first().value == "p(north,Y)\t+p(north,atlas)\t+p(north,saga)"
    for line in ("p(north,Y)\t+p(quay,saga)", "p(north,Y)\t+q(north,saga)", "p(north,Y)\tp(north,saga)", "p north"):
        examples.write_text(f"p(north,Y)\t+p(north,saga)\n{line}\n")
        with pytest.raises(BadExample):
            load_examples(library, str(examples))
    save_dataset(data, f"file://{tmp_path}/d.dset")
    assert load_dataset(spark, f"file://{tmp_path}/d.dset").size() == 3
    whole = from_relation(library, "p/io", "cites")
    assert whole.size() == 6 and sum(r.w for r in whole.y.collect()) == pytest.approx(6)


def test_lists_of_paths():
    assert paths_of("a:b") == ["a", "b"] and paths_of("file:/a:s3a://b/c:/d:hdfs://h:8020/e:file:///f") == ["file:/a", "s3a://b/c", "/d", "hdfs://h:8020/e", "file:///f"]


def test_many_answers(spark, library, tmp_path):
    """However many answers a line has."""
    (tmp_path / "long.exam").write_text("p\tnorth" + "".join(f"\ta{i}" for i in range(1 << 20 | 5)) + "\n")
    assert load_examples(None, str(tmp_path / "long.exam"), normalise=False, spark=spark).y.count() == 1 << 20 | 5


def test_minibatches(spark):
    x = spark.createDataFrame([(m, i, f"s{i}", 1.0) for m in ("p/io", "q/io") for i in range(7)], "mode string, qid long, id string, w double")
    data = Dataset(x, x)
    parts = [(m, part.size(), {r.id for r in part.x.collect()}) for m, part in data.batches(3, seed=1)]
    assert sorted(n for _, n, _ in parts) == [1, 1, 3, 3, 3, 3]
    for mode in ("p/io", "q/io"):
        assert set().union(*(ids for m, _, ids in parts if m == mode)) == {f"s{i}" for i in range(7)}


def test_session_and_export(library, capsys):
    engine = Engine(library.partner(), "r(B,K) :- lends(B,K), cites(K,L).", Settings(normalise="none"))
    s = Session(engine)
    assert s.eval("r/io", "north") == {"atlas": 6, "saga": 1}
    assert capsys.readouterr().out == "1\t6\tatlas\n2\t1\tsaga\n"
    assert "r(B,K)" in s.list("r/2") and "cites" in s.list() and "preimage" in s.list("r/io") and "6 facts" in s.list("cites/2")
    batch = engine.db.onehot("north")
    lines = [r.value for r in ranked_answers("r/io", batch, engine.proof_count_batch("r/io", batch)).collect()]
    assert lines[0] == "# proved 1\tr(north,X1).\t999 msec" and lines[1] == "1\t6.000000000000000000\tr(north,atlas)."


def test_streamed_queries(spark, library, tmp_path):
    from weft.streaming import answer_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("north\nquay\n")
    engine = Engine(library.partner(), "p(X,Y) :- twin(X,Y).", Settings(normalise="none"))
    seen = []
    stream = spark.readStream.text(f"file://{tmp_path}/in").withColumnRenamed("value", "x")
    query = answer_stream(engine, "p/io", stream, lambda df, epoch: seen.extend(map(tuple, df.collect())), f"file://{tmp_path}/ck")
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [("north", "quay", 1.0), ("quay", "south", 1.0)]


def test_batches_are_read_alone(spark, tmp_path, monkeypatch):
    """An epoch's batches hold every example once, and each reads its own folder only."""
    from weft.sources import examples

    pairs = spark.createDataFrame([(m, i, f"x{i}", f"y{i % 3}") for m, n in (("r/io", 23), ("p/oi", 5)) for i in range(n)], "mode string, qid long, x string, y string")
    data = examples.from_pairs(pairs)
    for folders in (10_000, 2):
        monkeypatch.setattr(examples, "FOLDERS", folders)
        parts = list(data.batches(5, seed=1))
        assert sorted(p.x.count() for _, p in parts) == [3, 5, 5, 5, 5, 5]
        assert sorted((m, r.id) for m, p in parts for r in p.x.collect()) == sorted((r["mode"], r.x) for r in pairs.collect())
        assert all(p.x.select("qid").exceptAll(p.y.select("qid")).count() == 0 and {r["mode"] for r in p.x.collect()} == {m} for m, p in parts)
        plan = parts[0][1].x._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(of_mode" in plan


def test_typed_binary_facts_without_weights(spark):
    """The third field of a fact may be a symbol where types are declared."""
    db = load_lines(spark, ["# :- did(user,event)", "# :- old(user)", "did\tu1\tsignup", "did\tu2\tclick\t2", "old\tu1\t0.5"])
    assert {tuple(r) for r in db.binary("did").collect()} == {("u1", "signup", 1.0), ("u2", "click", 2.0)}
    assert [tuple(r) for r in db.unary("old").collect()] == [("u1", 0.5)]
