"""Gradients, updates, learners and what they make of a small text task."""

import math
import random

import pytest
from pyspark.sql import functions as F
from library import FACTS, Prover

from weft.catalog import Database
from weft.engine import Engine, Settings
from weft.learn import AdaGrad, EveryEpochs, Experiment, FixedRateGD, FixedRateSGD, L2Regulariser, Learner, RecordingTracer, TestTracer, WholeDatasetGD, accuracy, cheap_tracer, cross_entropy, sigmoid, softplus, softplus_inverse, updated, updated_free
from weft.operators.adjoint import _holding
from weft.operators.lower import Evaluation
from weft.plans.nodes import in_order
from weft.sources.examples import from_pairs
from weft.sources.facts import load_lines

def one(spark, symbol, answers):
    x = spark.createDataFrame([(0, symbol, 1.0)], "qid long, id string, w double")
    return x, spark.createDataFrame([(0, a, 1.0 / len(answers)) for a in answers], "qid long, id string, w double")


#: Rules, a query and its right answers.
TASKS = [
    ("r(B,K) :- lends(B,K).", "r/io", "north", ["atlas"]),
    ("r(B,K) :- lends(B,K).", "r/oi", "saga", ["south"]),
    ("r(B,L) :- lends(B,K), cites(K,L).", "r/io", "north", ["herbal", "atlas"]),
    ("r(B,K) :- lends(B,K), old(K), cites(K,L).", "r/io", "quay", ["ledger"]),
    ("r(B,C) :- twin(B,C), lends(B,K), cites(K,L). r(B,K) :- lends(B,K).", "r/io", "north", ["saga", "quay"]),
    ("g(K,L) :- cites(K,L). r(K,M) :- g(K,L), g(L,M). r(K,L) :- g(K,L).", "r/io", "saga", ["ledger", "atlas"]),
    ("r(B,V) :- assign(V,yes), lends(B,K), rare(V). r(B,L) :- lends(B,K), cites(K,L), old(L).", "r/io", "north", ["yes", "herbal"]),
]


@pytest.mark.parametrize("rules,mode,symbol,answers", TASKS)
def test_gradients_match_differences(spark, library, rules, mode, symbol, answers):
    """The gradient of every fact against differences of the likelihood, which the prover computes."""
    facts = {f: dict(w) for f, w in FACTS.items()} | {"rare": {("yes",): 0.7}}
    db = library.partner()
    db.add("rare", spark.createDataFrame([("yes", 0.7)], "id string, w double"))
    db.parameters = set(db.relations)

    def likelihood():
        scores = Prover(rules, facts).answers(mode, symbol)
        z = sum(map(math.exp, scores.values())) + math.exp(-10)
        return sum(scores[a] - math.log(z) for a in answers) / len(answers)

    found = Engine(db, rules).loss_gradient(mode, *one(spark, symbol, answers))
    got = {(f, *tuple(r)[:-1]): r.w for (f, _), df in found.items() for r in df.collect()}
    moved = 0
    for f, weights in facts.items():
        for args, w in list(weights.items()):
            ends = []
            for step in (1e-5, -1e-5):
                weights[args] = w + step
                ends.append(likelihood())
            weights[args] = w
            slope = (ends[0] - ends[1]) / 2e-5
            assert got.get((f, *args), 0.0) == pytest.approx(slope, abs=1e-6)
            moved += abs(slope) > 1e-3
    assert moved >= 2


def test_densify_makes_facts(spark, library):
    db = library.partner()
    db.mark_parameter("lends", 2)
    x, y = one(spark, "south", ["ledger"])
    learner = Learner(Engine(db, "r(B,K) :- lends(B,K)."), densify=True, rate=1.0)
    learner.apply(learner.gradient("r/io", x, y))
    assert db.relations[("lends", 2)].filter("src = 'south' and dst = 'ledger' and w > 0").count() == 1


def test_updates(spark):
    p = spark.createDataFrame([("a", 1.0), ("b", 0.1)], "id string, w double")
    g = spark.createDataFrame([("a", 4.0), ("b", -400.0), ("c", 2.0)], "id string, w double")
    assert {r.id: r.w for r in updated(p, g, 0.5, 2).collect()} == {"a": 2.0, "b": 0.0, "c": 0.5}
    decayed = L2Regulariser(0.1).applied(p)
    assert {r.id: round(r.w, 6) for r in decayed.collect()} == {"a": 0.9, "b": 0.09}
    assert {r.id: round(r.w, 9) for r in softplus(softplus_inverse(p)).collect()} == {"a": 1.0, "b": 0.1}
    assert [round(r.w, 6) for r in sigmoid(p, 1.0, -1.0).collect()][0] == 0.5


def test_softplus_steps(spark):
    p = spark.createDataFrame([("a", 2.0), ("b", 0.5), ("c", 40.0)], "id string, w double")
    g = spark.createDataFrame([("a", 3.0), ("b", -9.0), ("new", 5.0)], "id string, w double")
    got = {r.id: r.w for r in updated_free(p, g, 0.5, 2).collect()}
    want = {k: math.log1p(math.exp(math.log(math.expm1(w)) + 0.25 * gk * (1 - math.exp(-w)))) for k, w, gk in (("a", 2.0, 3.0), ("b", 0.5, -9.0))}
    assert got == pytest.approx(want | {"c": 40.0})


def test_tracers(text_task):
    engine, data = text_task
    seen = []
    test = TestTracer(learner=Learner(engine), data=data, then=seen.append)
    learner = FixedRateGD(engine, epochs=3, rate=1.0, tracer=EveryEpochs(2, test))
    learner.train(data)
    assert [r["epoch"] for r in seen] == [0, 2] and seen == test.records
    assert seen[1]["test_cross_entropy"] < seen[0]["test_cross_entropy"] and seen[1]["test_cross_entropy"] == pytest.approx(seen[1]["cross_entropy"])
    times = []
    FixedRateGD(engine, epochs=1, tracer=cheap_tracer)._trace(data, 0, 0.0)
    FixedRateGD(engine, epochs=1, tracer=RecordingTracer(then=times.append))._trace(data, 0, 0.0)
    assert times[0].keys() == {"epoch", "seconds", "cross_entropy", "accuracy", "regularised"}


def test_metrics(spark):
    schema = "qid long, id string, w double"
    y = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.5), (1, "a", 1.0), (2, "z", 1.0)], schema)
    p = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.5), (1, "b", 0.75), (1, "a", 0.25), (2, "a", 1.0)], schema)
    assert accuracy(y, p).first().accuracy == pytest.approx(0.5 / 3)  # two right answers: half a hit
    assert cross_entropy(y, p).first().cross_entropy == pytest.approx((math.log(2) + math.log(4)) / 3)  # z wasn't predicted: no cost


RULES = "predict(D,L) :- assign(L,pos) {pw(F) : word(D,F)}. predict(D,L) :- assign(L,neg) {nw(F) : word(D,F)}."


@pytest.fixture
def text_task(spark):
    rng = random.Random(2)
    facts, rows = [], []
    for i in range(12):
        label = "pos" if i % 2 else "neg"
        words = [f"{label}{rng.randint(0, 3)}" for _ in range(3)] + [f"any{rng.randint(0, 5)}" for _ in range(2)]
        facts += [f"word\td{i}\t{w}" for w in words]
        rows.append(("predict/io", i, f"d{i}", label))
    db = load_lines(spark, facts + ["label\tpos", "label\tneg"])
    data = from_pairs(spark.createDataFrame(rows, "mode string, qid long, x string, y string"))
    return Engine(db, RULES, Settings()), data


@pytest.mark.parametrize("make", [lambda e: FixedRateGD(e, epochs=1, rate=2.0, tracer=RecordingTracer()), lambda e: FixedRateSGD(e, epochs=1, rate=2.0, batch=6), lambda e: AdaGrad(e, epochs=1, rate=0.5), lambda e: WholeDatasetGD(e, epochs=1, rate=2.0, regulariser=L2Regulariser(0.001))])
def test_learners(text_task, make):
    engine, data = text_task
    learner = make(engine)
    p = {r.id: r.w for r in learner.predict("predict/io", data.queries("predict/io").limit(1)).collect()}
    assert p["pos"] == pytest.approx(p["neg"])
    before = learner.dataset_cross_entropy(data)
    out = Experiment(learner, data, data).run() if isinstance(learner, FixedRateSGD) else None
    if out is None:
        learner.train(data)
    assert learner.dataset_accuracy(data) == 1.0 and learner.dataset_cross_entropy(data) < before
    if isinstance(learner, FixedRateGD):
        assert [r["epoch"] for r in learner.tracer.records] == [0]


def test_labels_predicted_at_zero_cost_the_most(spark):
    """Scores 2,000 apart: the softmax of the lesser is too small for a double."""
    db = Database(spark)
    db.add("has", spark.createDataFrame([("a", "x", 2000.0), ("a", "y", 1.0), ("b", "x", 2000.0), ("b", "y", 1.0)], "src string, dst string, w double"))
    engine = Engine(db, "r(A,B) :- has(A,B).")
    x = spark.createDataFrame([(0, "a", 1.0), (1, "b", 1.0)], "qid long, id string, w double")
    y = spark.createDataFrame([(0, "x", 1.0), (1, "y", 1.0)], "qid long, id string, w double")
    assert engine.loss("r/io", x, y).first().cross_entropy == math.inf
    assert {(r.qid, r.id) for r in engine.inference_batch("r/io", x).collect()} == {(0, "x"), (1, "x")}  # answers have no such rows
    right = spark.createDataFrame([(0, "x", 1.0), (1, "x", 1.0)], "qid long, id string, w double")
    assert engine.loss("r/io", x, right).first().cross_entropy == pytest.approx(0.0)


def test_all_batches_at_once(spark):
    """The batches of one pass as a table; its plan doesn't grow with them."""
    rows = [(m, q, f"x{q}", f"y{q % 3}") for m, n in (("p/io", 23), ("r/io", 9)) for q in range(n)]
    data = from_pairs(spark.createDataFrame(rows, "mode string, qid long, x string, y string"))
    one_by_one = sorted(sorted((m, r.qid, r.id) for r in part.x.collect()) for m, part in data.batches(5, seed=2))
    both = data.in_batches(5, seed=2)
    together: dict = {}
    for r in both.x.collect():
        together.setdefault((r["mode"], r.batch), []).append((r["mode"], r.qid, r.id))
    assert sorted(map(sorted, together.values())) == one_by_one and len(one_by_one) == 7
    assert both.x.join(both.y, ["mode", "batch", "qid"]).count() == len(rows)


def test_gradients_beside_the_answers(spark, library):
    """Words' weights behind a constant answer: each label's share of the facts, summed over queries before words are met."""
    db = library.partner()
    db.parameters = {("old", 1)}
    engine = Engine(db, "r(B,V) :- assign(V,yes), lends(B,K), old(K).", Settings(normalise="softmax"), initial_weights=False)
    x = spark.createDataFrame([(i, b, 1.0) for i, b in enumerate(("north", "quay", "south"))], "qid long, id string, w double")
    y = spark.createDataFrame([(i, "yes", 1.0) for i in range(3)], "qid long, id string, w double")
    found = engine.loss_gradient("r/io", x, y)[("old", 1)]
    want, old = {}, {a: w for (a,), w in FACTS["old"].items()}
    for b in ("north", "quay", "south"):
        score = sum(w * old[k] for (a, k), w in FACTS["lends"].items() if a == b and k in old)
        for (a, k), w in FACTS["lends"].items():
            if a == b and k in old:
                want[k] = want.get(k, 0.0) + w * (1 - 1 / (1 + math.exp(-10 - score)))
    assert {r.id: r.w for r in found.collect()} == pytest.approx(want)


def test_words_are_counted_where_their_texts_are(spark, tmp_path):
    """One shuffle, of the texts; no fact of has_word is shuffled to be summed."""
    from weft.queries import counted_words, database

    rows = [(1, "A b a  c"), (2, None), (3, ""), (4, "b b"), (None, "lost"), (1, "c C")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counted = counted_words(spark, str(tmp_path))
    assert {tuple(r) for r in counted.collect()} == {("d1", "a", 2.0), ("d1", "b", 1.0), ("d1", "c", 3.0), ("d4", "b", 2.0)} == {tuple(r) for r in database(spark, str(tmp_path), ["has_word"]).binary("has_word").collect()}
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION" in plan


def test_rules_of_words_store_them_once(spark, tmp_path, monkeypatch):
    """feature_weights meets has_word in its weights and in its rule: it is counted and written once."""
    from weft import queries

    spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stored, was = [], queries.written
    monkeypatch.setattr(queries, "written", lambda df, name, *more: stored.append(name) or was(df, name, *more))
    out = queries.QUERIES["feature_weights"](spark, str(tmp_path))
    assert stored == ["has-word"] and {tuple(r) for r in out.collect()} == {("d1", "q0", 3.0), ("d2", "q1", 1.0)}


def test_experiments_make_their_examples_once(spark):
    """Examples and first parameters are read from tables; a dataset that is train and test is predicted once before and once after."""
    db = Database(spark).add("to", spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0), ("d", "c", 1.0)], "src string, dst string, w double"))
    db.mark_parameter("to", 2)
    seen, predicted = [], []

    class Watched(FixedRateGD):
        def train(self, data):
            seen.extend([data, self.engine.db.binary("to")])
            super().train(data)

        def dataset_predict(self, data, underflown=False):
            predicted.append(data)
            return super().dataset_predict(data, underflown)

    data = from_pairs(spark.createDataFrame([("r/io", 0, "a", "b"), ("r/io", 1, "d", "c")], "mode string, qid long, x string, y string"))
    out = Experiment(Watched(Engine(db, "r(X,Y) :- to(X,Y).", initial_weights=False), epochs=1, rate=1.0), data, data).run()
    assert out["test_accuracy_after"] == out["train_accuracy_after"] and out["test_cross_entropy_after"] < out["test_cross_entropy_before"]
    assert len(predicted) == 2
    assert all("weft-examples" in f for d in (seen[0].x, seen[0].y) for f in d.inputFiles()) and all("weft-parameter" in f for f in seen[1].inputFiles())
    assert seen[0].x.inputFiles() and seen[0].y.inputFiles() and seen[1].inputFiles()


def test_totals_send_deltas_without_their_messages(spark):
    """A total's delta goes to the batch's rows; what they hold isn't joined with the words again, and documents without words move nothing."""
    db = Database(spark)
    db.add("word", spark.createDataFrame([("d0", "a", 1.0), ("d0", "b", 2.0), ("d1", "b", 1.0), ("d2", "z", 1.0)], "src string, dst string, w double"))
    engine = Engine(db, "predict(D,L) :- assign(L,pos) {pw(F) : word(D,F)}. predict(D,L) :- assign(L,neg) {nw(F) : word(D,F)}.", initial_weights=False)
    for name in ("pw", "nw"):
        db.set_parameter(name, 1, spark.createDataFrame([("a", 0.5), ("b", 0.25)], "id string, w double"))
    x = spark.createDataFrame([(q, f"d{q}", 1.0) for q in range(4)], "qid long, id string, w double")
    y = x.select("qid", F.lit("pos").alias("id"), "w")
    learner, seen = Learner(engine), []
    told, lean = learner.gradient("predict/io", x, y, seen).by_parameter[("pw", 1)], learner.gradient("predict/io", x, y).by_parameter[("pw", 1)]
    assert {r.id: r.w for r in lean.collect()} == pytest.approx({r.id: r.w for r in told.collect()}, abs=1e-12) and lean.count() == 2

    ev, root = Evaluation(db, x), engine.program.plan("predict/io")
    assert [_holding(n.inputs[1], ev) is ev.batch for n in in_order(root) if n.kind == "scale"] == [True, True]
