"""Edges with embedded ends, adjoints of plugins, and losses, against differences of a plain likelihood."""

import math

import pytest
from pyspark.sql import functions as F

from weft.catalog import Database
from weft.engine import Engine, Settings
from weft.learn import FixedRateGD, Learner, SigmoidLikelihood, softplus
from weft.operators.plugins import EmbeddedEdges, NoAdjoint
from weft.sources.examples import from_pairs
from weft.sources.store import load_database, save_database

ROAD = {("a", "b"): 1.0, ("a", "c"): 2.0, ("b", "c"): 0.5, ("b", "d"): 1.5, ("c", "d"): 1.0, ("d", "a"): 0.7, ("e", "a"): 1.0}
SPOT = {"a": [0.2, -0.4], "b": [0.9, 0.1], "c": [-0.3, 0.5], "d": [0.0, -1.2]}
GOAL = {0: ("a", "d"), 1: ("b", "d"), 2: ("d", "c")}
LINK = {"softplus": lambda d: math.log1p(math.exp(d)), "exp": math.exp}


def edges(spots, link, roads=ROAD):
    return {(i, j): w * LINK[link](sum(spots[i]) - sum(spots[j])) for (i, j), w in roads.items() if i in spots and j in spots}


def two_steps(x, e, back=False):
    """Scores of r(X,Y) :- road(X,Z), near(Z,Y), or with near asked backwards."""
    out = {}
    for (i, z), w in ROAD.items():
        for (p, q), v in e.items():
            near, far = (q, p) if back else (p, q)
            if i == x and near == z:
                out[far] = out.get(far, 0.0) + w * v
    return out


def likelihood(e, back=False):
    total = 0.0
    for x, y in GOAL.values():
        s = {**two_steps(x, e, back), None: -10.0}
        total += s.get(y, 0.0) - math.log(sum(math.exp(v) for v in s.values()))  # answers that aren't labelled go down, whether or not the label has a score
    return total


def make(spark, link="softplus"):
    db = Database(spark)
    db.add("road", spark.createDataFrame([(*k, w) for k, w in ROAD.items()], "src string, dst string, w double"))
    db.add_vectors("spot", spark.createDataFrame(list(SPOT.items()), "id string, v array<double>"))
    db.mark_parameter("spot", 0)
    return db, EmbeddedEdges(db, "road", "spot", link)


def examples(spark):
    return from_pairs(spark.createDataFrame([("r/io", q, x, y) for q, (x, y) in GOAL.items()], "mode string, qid long, x string, y string"))


def slopes(f, at, h=1e-6):
    """Central differences of f over a dictionary of vectors."""
    out = {}
    for i, v in at.items():
        for k in range(len(v)):
            up, down = ({**at, i: [c + s * h * (j == k) for j, c in enumerate(v)]} for s in (1, -1))
            out[(i, k)] = (f(up) - f(down)) / (2 * h)
    return out


@pytest.mark.parametrize("link,back", [("softplus", False), ("exp", False), ("softplus", True)])
def test_gradients_of_vectors(spark, link, back):
    db, plugin = make(spark, link)
    engine = Engine(db, f"r(X,Y) :- road(X,Z), near({'Y,Z' if back else 'Z,Y'}).", Settings(), initial_weights=False)
    engine.plugin("near/2", plugin)
    assert {(r.src, r.dst): r.w for r in plugin.weights().collect()} == pytest.approx(edges(SPOT, link))
    data = examples(spark)
    got = Learner(engine).gradient("r/io", data.queries("r/io"), data.labels("r/io")).by_parameter
    assert set(got) == {("spot", 0)}
    want = slopes(lambda spots: likelihood(edges(spots, link), back), SPOT)
    assert {(r.id, r.k): r.w for r in got[("spot", 0)].collect()} == pytest.approx(want, abs=1e-5)


def test_gradients_of_the_relation_below(spark):
    """The delta goes on through the plugin to the message it got, and to the stored weights."""
    db, plugin = make(spark)
    db.add("first", db.binary("road"))
    db.mark_parameter("first", 2)
    db.mark_parameter("road", 2)
    engine = Engine(db, "r(X,Y) :- first(X,Z), near(Z,Y).", Settings(), initial_weights=False)
    engine.plugin("near/2", plugin)
    data = examples(spark)
    got = Learner(engine).gradient("r/io", data.queries("r/io"), data.labels("r/io")).by_parameter

    def by_road(roads):
        return likelihood(edges(SPOT, "softplus", {k: v[0] for k, v in roads.items()}))

    want = {k[0]: v for k, v in slopes(by_road, {k: [w] for k, w in ROAD.items()}).items() if k[0][0] in SPOT and k[0][1] in SPOT}
    found = {(r.src, r.dst): r.w for r in got[("road", 2)].collect()}
    assert found == pytest.approx({k: v for k, v in want.items() if k in found}, abs=1e-5) and all(abs(want[k]) < 1e-9 for k in set(want) - set(found))
    e = edges(SPOT, "softplus")

    def by_first(firsts):
        total = 0.0
        for x, y in GOAL.values():
            s = {None: -10.0}
            for (i, z), (w,) in firsts.items():
                for (p, q), v in e.items():
                    if i == x and p == z:
                        s[q] = s.get(q, 0.0) + w * v
            total += s.get(y, 0.0) - math.log(sum(map(math.exp, s.values())))
        return total

    want = {k[0]: v for k, v in slopes(by_first, {k: [w] for k, w in ROAD.items()}).items()}
    found = {(r.src, r.dst): r.w for r in got[("first", 2)].collect()}
    assert found == pytest.approx({k: want[k] for k in found}, abs=1e-5)


def test_training_vectors(spark, tmp_path):
    db, plugin = make(spark)
    engine = Engine(db, "r(X,Y) :- near(X,Y).", Settings(), initial_weights=False)
    engine.plugin("near/2", plugin)
    data = examples(spark)
    learner = FixedRateGD(engine, epochs=3, rate=0.5)
    before = learner.dataset_cross_entropy(data)
    learner.train(data)
    assert learner.dataset_cross_entropy(data) < before
    assert db.relations[("spot", 0)].filter("w < 0").count() > 0  # components aren't cut at zero
    save_database(db, f"file://{tmp_path}/db")
    again = load_database(spark, f"file://{tmp_path}/db")
    assert again.parameters == {("spot", 0)} and {tuple(r) for r in again.relations[("spot", 0)].collect()} == {tuple(r) for r in db.relations[("spot", 0)].collect()}
    assert ("spot", 0) in {(r.functor, r.arity) for r in again.sizes().collect()} and again.symbols().count() == 2 + 5


def test_adjoints_of_functions(spark):
    db, _ = make(spark)
    db.mark_parameter("road", 2)
    data = examples(spark)
    results = []
    for rules, backward in (("r(X,Y) :- road(X,Z), road(Z,Y).", None), ("r(X,Y) :- road(X,Z), half(Z,V), road(V,Y).", "half"), ("r(X,Y) :- road(X,Z), half(Z,V), road(V,Y).", None)):
        engine = Engine(db, rules, Settings(), initial_weights=False)
        halved = lambda m: m.withColumn("w", F.col("w") / 2)
        engine.plugin("half/2", halved, backward=(lambda m, d: halved(d)) if backward else None)
        if "half" in rules and not backward:
            with pytest.raises(NoAdjoint, match="half/2"):
                Learner(engine).gradient("r/io", data.queries("r/io"), data.labels("r/io"))
            continue
        results.append({(r.src, r.dst): r.w for r in Learner(engine).gradient("r/io", data.queries("r/io"), data.labels("r/io")).by_parameter[("road", 2)].collect()})
    e = {k: v / 2 for k, v in ROAD.items()}

    def by_road(roads):
        flat = {k: v[0] for k, v in roads.items()}
        total = 0.0
        for x, y in GOAL.values():
            s = {None: -10.0}
            for (i, z), w in flat.items():
                for (p, q), v in flat.items():
                    if i == x and p == z:
                        s[q] = s.get(q, 0.0) + w * v / 2
            total += s.get(y, 0.0) - math.log(sum(map(math.exp, s.values())))
        return total

    want = {k[0]: v for k, v in slopes(by_road, {k: [w] for k, w in ROAD.items()}).items()}
    assert e and results[1] == pytest.approx({k: want[k] for k in results[1]}, abs=1e-5) and results[0] != pytest.approx(results[1])


def test_deltas_keep_to_the_messages_rows(spark):
    """Many symbols share a far end; a query's delta has none of those that it doesn't reach."""
    db = Database(spark)
    rows = [(f"x{q}", f"m{q}", 1.0) for q in range(20)]
    db.add("first", spark.createDataFrame(rows, "src string, dst string, w double"))
    db.add("last", spark.createDataFrame([(f"m{q}", "all", 1.0 + q) for q in range(20)], "src string, dst string, w double"))
    db.mark_parameter("first", 2)
    engine, seen = Engine(db, "r(X,Y) :- first(X,Z), last(Z,Y).", initial_weights=False), []
    x = spark.createDataFrame([(q, f"x{q}", 1.0) for q in range(20)], "qid long, id string, w double")
    found = Learner(engine).gradient("r/io", x, x.select("qid", F.lit("all").alias("id"), "w"), seen).by_parameter[("first", 2)]
    (delta,) = [d for node, d in seen if node.label() == "step(first, forward)"]
    assert {(r.qid, r.id) for r in delta.collect()} == {(q, f"m{q}") for q in range(20)}
    p = [1 / (1 + math.exp(-10 - (1 + q))) for q in range(20)]
    assert {(r.src, r.dst): r.w for r in found.collect()} == pytest.approx({(f"x{q}", f"m{q}"): (1 - p[q]) * (1 + q) for q in range(20)}, abs=1e-12)


def test_sigmoid_likelihood(spark):
    """Labels of any number, one of them without a score; slope and bias are trained too."""
    db, plugin = make(spark)
    engine = Engine(db, "r(X,Y) :- road(X,Z), near(Z,Y).", Settings(), initial_weights=False)
    engine.plugin("near/2", plugin)
    loss = SigmoidLikelihood(db)
    db.set_parameter("logistic", 0, spark.createDataFrame([("slope", 0, 0.8), ("bias", 0, -0.3)], "id string, k int, w double"))
    x = spark.createDataFrame([(0, "a", 1.0), (1, "d", 1.0)], "qid long, id string, w double")
    y = spark.createDataFrame([(0, "c", 1.0), (0, "d", 1.0), (0, "nowhere", 1.0), (1, "b", 0.5)], "qid long, id string, w double")
    truth = {(0, "c"), (0, "d"), (0, "nowhere"), (1, "b")}

    def mean(spots, extra):
        e, total, n = edges(spots, "softplus"), 0.0, 0
        for q, start in ((0, "a"), (1, "d")):
            s = two_steps(start, e)
            for i in set(s) | {i for k, i in truth if k == q}:
                t = extra["slope"][0] * s.get(i, 0.0) + extra["bias"][0]
                total += -math.log1p(math.exp(-t)) if (q, i) in truth else -math.log1p(math.exp(t))
                n += 1
        return total, n

    scalars = {"slope": [0.8], "bias": [-0.3]}
    got = Learner(engine, loss=loss).gradient("r/io", x, y)
    total, n = mean(SPOT, scalars)
    assert got.n == n and loss.cost(engine.proof_count_batch("r/io", x), y).first().loss == pytest.approx(-total / n)
    assert {(r.id, r.k): r.w for r in got.by_parameter[("spot", 0)].collect()} == pytest.approx(slopes(lambda s: mean(s, scalars)[0], SPOT), abs=1e-5)
    assert {(r.id, r.k): r.w for r in got.by_parameter[("logistic", 0)].collect()} == pytest.approx(slopes(lambda s: mean(SPOT, s)[0], scalars), abs=1e-5)
    learner = Learner(engine, loss=loss, rate=1.0)
    learner.apply(got)
    assert -loss.cost(engine.proof_count_batch("r/io", x), y).first().loss > total / n
    assert all(0 < r.w < 1 for r in learner.predict("r/io", x).collect())


def test_links_agree_with_the_library(spark):
    free = spark.createDataFrame([("a", 31.0), ("b", -2.0), ("c", 0.0)], "id string, w double")
    from weft.operators.plugins import LINKS

    got = {r.id: r.w for r in free.select("id", LINKS["softplus"][0](F.col("w")).alias("w")).collect()}
    assert got == pytest.approx({r.id: r.w for r in softplus(free).collect()})


def test_queries_named_by_their_symbol(spark):
    """The same gradients as under numbers; facts stored by an end aren't shuffled to be summed there."""
    spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    db, plugin = make(spark)
    db.set_parameter("road", 2, db.binary("road"))
    db.add("twice", db.binary("road").union(db.binary("road")))
    db.store_dealt("twice", "src")
    assert {(r.src, r.dst): r.w for r in db.binary("twice").collect()} == {k: 2 * w for k, w in ROAD.items()}
    assert "Exchange" not in db.binary("twice").groupBy("src", "dst").agg(F.sum("w"))._jdf.queryExecution().executedPlan().toString()
    engine = Engine(db, "r(X,Y) :- near(X,Z), road(Z,Y).", Settings(), initial_weights=False)
    engine.plugin("near/2", plugin)
    rows = [("r/io", q, x, y) for q, (x, y) in GOAL.items()]
    found = []
    for kind, pairs in (("long", rows), ("string", [(m, x, x, y) for m, _, x, y in rows])):
        data = from_pairs(spark.createDataFrame(pairs, f"mode string, qid {kind}, x string, y string"))
        by = Learner(engine).gradient("r/io", data.queries("r/io"), data.labels("r/io")).by_parameter[("spot", 0)]
        found.append({(r.id, r.k): r.w for r in by.collect()})
    assert found[0] and found[1] == pytest.approx(found[0], abs=1e-12)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "false"
    spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
