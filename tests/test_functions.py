"""Mining, hashed embeddings, word weights and message utilities."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weft.functions import messages, mining, vectors


@pytest.fixture(scope="module")
def triples(spark):
    rows = [("a", "p", "b"), ("a", "q", "b"), ("c", "q", "d"), ("b", "r", "a"), ("b", "s", "e"), ("a", "t", "e")]
    return spark.createDataFrame(rows, "head string, relation string, tail string")


def test_mining(triples):
    assert {(r.p, r.q): (r.n, round(r.score, 6)) for r in mining.entailments(triples).collect()} == {("p", "q"): (1, round(math.log(0.5), 6)), ("q", "p"): (1, 0.0)}
    assert ("r", "p") in {(r.p, r.q) for r in mining.inversions(triples).collect()}
    chains = {(r.p, r.q, r.r): r.n for r in mining.chains(triples).collect()}
    assert chains[("t", "p", "s")] == 1 and chains[("t", "q", "s")] == 1
    text = {r.value for r in mining.rule_text(triples).collect()}
    assert "p(X,Y):-q(X,Y) {if_p_q}.\t#score -0.693" in text and "t(X,Y):-p(X,Z),s(Z,Y) {chain_t_p_s}.\t#score 0.000" in text


@pytest.mark.parametrize("hub_rows", [1_000_000, 5])
def test_chains_equal_all_paths(spark, hub_rows):
    """Over many-to-many relations with hubs and loops, some of them closing chains of others; hubs whole and split."""
    rng = random.Random(3)
    rows = {(f"a{rng.randint(0, 9) ** 2 // 9}", "p", f"b{rng.randint(0, 5)}") for _ in range(60)} | {(f"b{rng.randint(0, 5)}", "q", f"c{rng.randint(0, 9)}") for _ in range(40)}
    rows |= {(f"a{rng.randint(0, 9)}", "s", f"c{rng.randint(0, 9)}") for _ in range(50)} | {(f"c{rng.randint(0, 9)}", "t", f"c{rng.randint(0, 9)}") for _ in range(30)}
    rows |= {(t, "back", h) for h, r, t in rows if r == "p"} | {("c1", "t", "c1"), ("c2", "t", "c2"), ("a1", "s", "a1"), ("a1", "p", "a1"), ("b1", "q", "b1")}
    paths, pairs = Counter(), defaultdict(set)
    for (x, q, z), (z2, r, y) in itertools.product(rows, rows):
        if z == z2:
            paths[(q, r)] += 1
            pairs[(q, r)].add((x, y))
    want = {}
    for (q, r), found in pairs.items():
        for p in {row[1] for row in rows}:
            n = sum((x, p, y) in rows for x, y in found)
            if n:
                want[(p, q, r)] = (n, round(math.log(n / paths[(q, r)]), 9))
    given = [*sorted(rows), (None, "p", "b1"), ("a1", None, "b1"), ("a1", "p", None)]
    got = mining.chains(spark.createDataFrame(given, "head string, relation string, tail string"), hub_rows).collect()
    assert {(r.p, r.q, r.r): (r.n, round(r.score, 9)) for r in got} == want and len(want) >= 5


def test_chains_through_hubs_make_few_rows(spark):
    """Two hubs, each a relation's only head or tail: paths through them grow with the square, wedges don't."""
    n = 400
    rows = [("X", "p", f"y{i}") for i in range(n)] + [("X", "q", f"z{i}") for i in range(n)] + [(f"z{i}", "r", "Y") for i in range(n)] + [(f"w{i}", "p", "Y") for i in range(n)]
    rows += [(f"w{i}", "q", f"z{i}") for i in range(n)] + [(f"z{i}", "r", f"y{i}") for i in range(n)]
    triples = spark.createDataFrame(rows, "head string, relation string, tail string")
    edges = mining.oriented(mining._named_edges(triples))
    assert edges.count() == 6 * n and mining.wedges(edges).count() <= 8 * n
    assert {(r.p, r.q, r.r): r.n for r in mining.chains(triples).collect()} == {("p", "q", "r"): 2 * n}


def test_chains_of_nothing(spark):
    assert mining.chains(spark.createDataFrame([], "head string, relation string, tail string")).collect() == []


def test_numbers_without_gaps(spark):
    rows = spark.range(500).selectExpr("id % 3 AS mode", "id")
    got = messages.numbered(rows, "n", "id", within=("mode",), seed=2).collect()
    for mode in range(3):
        own = sorted((r.n, r.id) for r in got if r["mode"] == mode)
        assert [n for n, _ in own] == list(range(len(own))) and [i for _, i in own] != sorted(i for _, i in own)


def test_steps_in_cells(spark):
    """Exact where cells are wide, and never less where they are narrow and hashes fall together."""
    facts = [(f"a{i}", f"b{(i * k) % 11}", 1.0 + k) for i in range(12) for k in range(1, 4)]
    rel = spark.createDataFrame(facts, "src string, dst string, w double")
    m = spark.createDataFrame([(q, f"a{i}", 1.0 + i) for q in range(3) for i in range(q, 12, 3)], "qid int, id string, w double")
    names = spark.createDataFrame([(f"b{i}",) for i in range(12)], "id string")
    want: dict = {}
    for q in range(3):
        for a, b, w in facts:
            if int(a[1:]) % 3 == q:
                want[(q, b)] = want.get((q, b), 0.0) + (1.0 + int(a[1:])) * w
    for columns in (1 << 30, 40, 4):
        moved = vectors.step_cells(vectors.embed(m, columns), rel, columns)
        got = {(r.qid, r.id): r.w for r in vectors.unembed(moved, names, columns).collect()}
        assert all(got[k] >= w - 1e-9 for k, w in want.items())
        if columns == 1 << 30:
            assert got == pytest.approx(want)


def test_embeddings_never_lose(spark):
    m = spark.createDataFrame([(0, f"s{i}", float(i + 1)) for i in range(5)], "qid long, id string, w double")
    symbols = spark.createDataFrame([(f"s{i}",) for i in range(40)], "id string")
    back = {r.id: r.w for r in vectors.unembed(vectors.embed(m, 256), symbols, 256).collect()}
    assert all(back[f"s{i}"] >= i + 1 for i in range(5)) and len(back) < 15
    assert {f"s{i}" for i in range(5)} <= {r.id for r in vectors.contains(vectors.embed(m, 256), symbols, columns=256).collect()}
    rel = spark.createDataFrame([("s0", "s1", 2.0)], "src string, dst string, w double")
    assert vectors.embed_relation(rel, 256).agg({"w": "max"}).first()[0] >= 2


def test_tfidf(spark):
    rel = spark.createDataFrame([("d1", "a", 1.0), ("d1", "b", 2.0), ("d2", "a", 1.0)], "src string, dst string, w double")
    w = {(r.src, r.dst): r.w for r in vectors.tfidf(rel).collect()}
    assert w[("d1", "b")] == pytest.approx(1) and w[("d1", "a")] == 0 and w[("d2", "a")] == 0


def test_messages(spark):
    m = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (1, "a", 3.0)], "qid long, id string, w double")
    assert {r.qid: r.w for r in messages.row_sum(m).collect()} == {0: 3, 1: 3}
    assert {r.id: r.w for r in messages.column_mean(m, 4).collect()} == {"a": 1.0, "b": 0.5}
    assert messages.stack([m, m]).agg({"qid": "max"}).first()[0] == 3
    assert {r.qid for r in messages.selected(m, 1, 9).collect()} == {0}
    assert messages.repeat(m.filter("qid = 0").drop("qid"), 3).count() == 6
    assert {r.qid for r in messages.shuffled(m, 5).collect()} == {0, 1}
    assert tuple(messages.summary(m).first()) == (2, 2, 3, 3.0)
    assert {(r.qid, r.id): r.w for r in messages.altered(m, lambda w, row: w / F.sum(w).over(row)).collect()} == {(0, "a"): 1 / 3, (0, "b"): 2 / 3, (1, "a"): 1.0}
    assert {r.id: (r.entries, r.total, r.largest) for r in messages.columns(m).collect()} == {"a": (2, 4.0, 3.0), "b": (1, 2.0, 2.0)}
    assert messages.map_weights(m, lambda w: w * 2).agg({"w": "sum"}).first()[0] == 12


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_symbols_are_told_without_sums(spark):
    """The symbols of facts take one aggregation over one scan, whatever the sums of equal facts take."""
    from weft.catalog import Database

    db = Database(spark).add("has", spark.range(12).selectExpr("concat('a', id % 3) AS src", "concat('b', id % 2) AS dst"))
    assert {r.id for r in db.symbols().collect()} == {"a0", "a1", "a2", "b0", "b1", "__NULL__", "__OOV__"}
    assert _plan(db.symbols()).count("Aggregate") == 1 and _plan(db.symbols()).count("Range") == 1


def test_tfidf_makes_its_rows_once(spark):
    plan = _plan(vectors.tfidf(spark.range(12).selectExpr("concat('a', id % 3) AS src", "concat('b', id) AS dst", "1.0D AS w").groupBy("src", "dst").agg(F.sum("w").alias("w"))))
    assert plan.count("Join") == 2 and "Range" not in plan


def test_ends_and_hubs_are_told_without_sums(spark, monkeypatch):
    """Symbols of an end and hubs come from facts as they were added; a relation dealt by an end is shuffled once."""
    from weft import catalog
    from weft.catalog import Database
    from weft.functions.vectors import embed

    facts = [("a", "x"), ("a", "y"), ("a", "x"), ("b", "x"), (None, "z"), ("c", None)]
    db = Database(spark, hub_rows=10).add("f", spark.createDataFrame(facts, "src string, dst string"))
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert {r.id for r in db.ends("f", "src").collect()} == {"a", "b"} and {r.id for r in db.ends("f", "dst").collect()} == {"x", "y"}
    assert shuffles(db.ends("f", "src")) == 1
    dealt = db.dealt("f", "src")
    assert {tuple(r) for r in dealt.collect()} == {("a", "x", 2.0), ("a", "y", 1.0), ("b", "x", 1.0)}
    assert shuffles(embed(dealt.select(F.col("src").alias("qid"), F.col("dst").alias("id"), "w"), 1 << 62)) == 1
    seen, was = [], catalog.hubs_at
    monkeypatch.setattr(catalog, "hubs_at", lambda rows, *more: seen.append(shuffles(rows)) or was(rows, *more))
    db.hubs("f")
    assert seen == [0]
    db.set_parameter("f", 2, db.binary("f").filter("src = 'a'"))  # a replaced relation's own facts
    assert {r.id for r in db.ends("f", "src").collect()} == {"a"} and {tuple(r) for r in db.dealt("f", "src").collect()} == {("a", "x", 2.0), ("a", "y", 1.0)}
    db = Database(spark, hub_rows=1).add("f", spark.createDataFrame(facts, "src string, dst string"))
    monkeypatch.undo()
    assert db.dealt("f", "src").count() == 3


def test_links_count_repeated_triples_and_loops(spark):
    """Against all pairs of rows; a pair's triples are told once, by its list of relations."""
    rng = random.Random(5)
    rows = [(f"e{rng.randint(0, 4)}", rng.choice("pqr"), f"e{rng.randint(0, 4)}") for _ in range(60)] + [("e1", "p", "e1")] * 3 + [(None, "p", "e1"), ("e1", "q", None)]
    of = Counter(r for _, r, _ in rows)
    same, back = Counter(), Counter()
    for (h, p, t), (h2, q, t2) in itertools.product(rows, rows):
        if None not in (h, t, h2, t2):
            same[(p, q)] += (h, t) == (h2, t2) and p != q
            back[(p, q)] += (h, t) == (t2, h2)
    triples = spark.createDataFrame(rows, "head string, relation string, tail string")
    for found, want in ((mining.entailments(triples), same), (mining.inversions(triples), back)):
        assert {(r.p, r.q): (r.n, round(r.score, 9)) for r in found.collect()} == {k: (n, round(math.log(n / of[k[1]]), 9)) for k, n in want.items() if n}
    alike = spark.createDataFrame([(f"a{i}", r, f"b{i}") for i in range(50) for r in "pq"] + [(f"a{i}", "r", f"c{i}") for i in range(50)], triples.schema)
    assert [(r.loop, len(r.links), r.pairs) for r in mining.links(alike).collect()] == [(False, 2, 50)]
