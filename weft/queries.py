"""Driver queries of the rule engine over the star-schema tables, and their SQL.

Relations count the rows behind each pair; symbols carry a prefix of their
kind, so that kinds never mix.  Every query asks all its inputs at once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.catalog import Database
from weft.engine import Engine, Settings
from weft.functions import mining, vectors
from weft.learn import Gradients, L2Regulariser, Learner, accuracy, ranked, ranked_answers, updated
from weft.operators.hubs import promised_bytes
from weft.scratch import bucketed, buckets_for, fine_tasks, written
from weft.sources.examples import Dataset, from_pairs

#: name: (table, left symbol, right symbol or None, condition), in SQL that both engines read.
RELATIONS: dict[str, tuple[str, str, str | None, str]] = {
    "placed": ("orders", "concat('c', o_custkey)", "concat('o', o_orderkey)", "true"),
    "contains": ("lineitem", "concat('o', l_orderkey)", "concat('p', l_partkey)", "true"),
    "supplied": ("lineitem", "concat('p', l_partkey)", "concat('s', l_suppkey)", "true"),
    "c_nation": ("customer", "concat('c', c_custkey)", "concat('n', c_nationkey)", "true"),
    "s_nation": ("supplier", "concat('s', s_suppkey)", "concat('n', s_nationkey)", "true"),
    "in_region": ("nation", "concat('n', n_nationkey)", "concat('r', n_regionkey)", "true"),
    "brand": ("part", "concat('p', p_partkey)", "p_brand", "true"),
    "ptype": ("part", "concat('p', p_partkey)", "p_type", "true"),
    "priority": ("orders", "concat('o', o_orderkey)", "o_orderpriority", "true"),
    "did": ("events", "concat('u', user_id)", "event_type", "true"),
    "quality": ("labels", "concat('d', doc_id)", "concat('q', quality)", "true"),
    "urgent": ("orders", "concat('o', o_orderkey)", None, "o_orderpriority = '1-URGENT'"),
    "building": ("customer", "concat('c', c_custkey)", None, "c_mktsegment = 'BUILDING'"),
    "eastern": ("supplier", "concat('s', s_suppkey)", None, "s_nationkey IN (8, 18)"),
    "big": ("part", "concat('p', p_partkey)", None, "p_size > 25"),
}
_WORDS = "SELECT concat('d', doc_id) AS src, word AS dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY ALL"
#: Brands that share a part type, as a stored relation, unweighted.
_CO = "SELECT DISTINCT a.p_brand AS src, b.p_brand AS dst, 1.0::DOUBLE AS w FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand <> b.p_brand"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("src"), "text")


def _words(texts: DataFrame) -> DataFrame:
    return texts.select("src", F.explode(F.split(F.lower("text"), " ", -1)).alias("dst")).filter("dst <> ''")


def counted_words(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """``has_word`` by way of texts that are dealt out by document, into ``parts``
    if told, so that words are counted where they are and none is shuffled."""
    fine_tasks(spark)
    texts = _texts(spark, sf_dir).dropna(subset=["src"])
    return _words(texts.repartition(parts, "src") if parts else texts.repartition("src")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def database(spark: SparkSession, sf_dir: str, names: list[str], store_words: bool = False) -> Database:
    """A database with the relations named; ``store_words`` where ``has_word`` is used many times."""
    db = Database(spark)
    for name in names:
        if name == "has_word":
            rel = _words(_texts(spark, sf_dir))
        elif name == "co":
            part = _table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
            a, b = part.withColumnRenamed("p_brand", "src"), part.withColumnRenamed("p_brand", "dst")
            rel = a.join(b, "p_type").filter("src <> dst").select("src", "dst").distinct()
        else:
            table, left, right, where = RELATIONS[name]
            rel = _table(spark, sf_dir, table).filter(where)
            rel = rel.selectExpr(f"{left} src", f"{right} dst") if right else rel.selectExpr(f"{left} id")
        db.add(name, rel)
    if store_words:  # by document, as gradients and counts by label meet it there
        parts = buckets_for(promised_bytes(_texts(spark, sf_dir)))
        db.set_parameter("has_word", 2, bucketed(counted_words(spark, sf_dir, parts), "has_word", "src", parts))
    return db


def _cte(name: str) -> str:
    if name in ("has_word", "co"):
        return f"{name} AS ({_WORDS if name == 'has_word' else _CO})"
    table, left, right, where = RELATIONS[name]
    cols = f"{left} AS src, {right} AS dst" if right else f"{left} AS id"
    return f"{name} AS (SELECT {cols}, CAST(count(*) AS DOUBLE) AS w FROM {table} WHERE {where} GROUP BY ALL)"


def with_relations(names: list[str], sql: str) -> str:
    return "WITH " + ", ".join(map(_cte, names)) + ("," if sql.lstrip().startswith(",") else " ") + sql.lstrip().removeprefix(",")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _inputs(db: Database, of: str) -> DataFrame:
    """(x): the distinct symbols of ``relation`` or ``relation.dst``."""
    name, _, col = of.partition(".")
    return db.binary(name).select(F.col(col or "src").alias("x")).distinct()


def rule_query(name: str, relations: str, rules: str, mode: str, inputs: str, sql: str, how: str = "none", depth: int = 10, store_inputs: bool = False, **options) -> None:
    """Register a rule's proof counts, or its normalised answers; ``store_inputs``
    where their size is asked for before they are answered."""
    names = relations.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(database(spark, sf_dir, names, store_words="has_word" in names), rules, Settings(max_depth=depth, normalise=how), **options)
        asked = _inputs(engine.db, inputs)
        out = engine.inference(mode, written(asked, "inputs") if store_inputs else asked)
        return out if how == "none" else out.select("x", "y", F.round("w", 6).alias("w"))

    QUERIES[name] = run
    ORACLE_SQL[name] = with_relations(names, sql)


SOFTMAX = """, n AS (SELECT x, y, sum(w) AS w FROM (SELECT x, y, w FROM s UNION ALL SELECT x, '__NULL__', -10.0::DOUBLE FROM q) GROUP BY x, y HAVING sum(w) <> 0),
e AS (SELECT x, y, exp(w - max(w) OVER (PARTITION BY x)) AS w FROM n)
SELECT x, y, round(w / sum(w) OVER (PARTITION BY x), 6) AS w FROM e QUALIFY w > 0"""

rule_query("proof_direct", "supplied", "r(P,S) :- supplied(P,S).", "r/io", "supplied", "SELECT src AS x, dst AS y, w FROM supplied")
rule_query("proof_reverse", "supplied", "r(S,P) :- supplied(P,S).", "r/io", "supplied.dst", "SELECT dst AS x, src AS y, w FROM supplied")
rule_query("proof_output_to_input", "supplied", "r(P,S) :- supplied(P,S).", "r/oi", "supplied.dst", "SELECT dst AS x, src AS y, w FROM supplied")
rule_query("proof_chain2", "placed contains", "r(C,P) :- placed(C,O), contains(O,P).", "r/io", "placed", "SELECT a.src AS x, b.dst AS y, sum(a.w * b.w) AS w FROM placed a JOIN contains b ON a.dst = b.src GROUP BY ALL")
_CHAIN5 = """, c1 AS (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM placed a JOIN contains b ON a.dst = b.src GROUP BY ALL),
c2 AS (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM c1 a JOIN supplied b ON a.dst = b.src GROUP BY ALL),
c3 AS (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM c2 a JOIN s_nation b ON a.dst = b.src GROUP BY ALL)"""
CHAIN5 = "r(C,R) :- placed(C,O), contains(O,P), supplied(P,S), s_nation(S,N), in_region(N,R)."
CHAIN5_RELATIONS = "placed contains supplied s_nation in_region"
rule_query("proof_chain5", CHAIN5_RELATIONS, CHAIN5, "r/io", "placed", _CHAIN5 + " SELECT a.src AS x, b.dst AS y, sum(a.w * b.w) AS w FROM c3 a JOIN in_region b ON a.dst = b.src GROUP BY ALL")
rule_query("chain5_softmax", CHAIN5_RELATIONS, CHAIN5, "r/io", "placed", _CHAIN5 + ", s AS (SELECT a.src AS x, b.dst AS y, sum(a.w * b.w) AS w FROM c3 a JOIN in_region b ON a.dst = b.src GROUP BY ALL), q AS (SELECT DISTINCT src AS x FROM placed)" + SOFTMAX, how="softmax")
rule_query("filter_unary", "placed urgent contains", "r(C,P) :- placed(C,O), urgent(O), contains(O,P).", "r/io", "placed", "SELECT a.src AS x, b.dst AS y, sum(a.w * u.w * b.w) AS w FROM placed a JOIN urgent u ON a.dst = u.id JOIN contains b ON a.dst = b.src GROUP BY ALL")
rule_query("filter_input", "building placed", "r(C,O) :- building(C), placed(C,O).", "r/io", "placed", "SELECT a.src AS x, a.dst AS y, a.w * u.w AS w FROM placed a JOIN building u ON a.src = u.id")
rule_query("preimage_tail", "placed contains", "r(C,O) :- placed(C,O), contains(O,P).", "r/io", "placed", "SELECT a.src AS x, a.dst AS y, a.w * sum(b.w) AS w FROM placed a JOIN contains b ON a.dst = b.src GROUP BY a.src, a.dst, a.w")
rule_query("side_weight", "c_nation placed", "r(C,N) :- c_nation(C,N), placed(C,O).", "r/io", "c_nation", "SELECT a.src AS x, a.dst AS y, a.w * sum(b.w) AS w FROM c_nation a JOIN placed b ON a.src = b.src GROUP BY a.src, a.dst, a.w")
rule_query("side_weight_sq", "c_nation placed", "r(C,N) :- c_nation(C,N), placed(C,O1), placed(C,O2).", "r/io", "c_nation", "SELECT a.src AS x, a.dst AS y, a.w * sum(b.w) * sum(b.w) AS w FROM c_nation a JOIN placed b ON a.src = b.src GROUP BY a.src, a.dst, a.w")
rule_query("const_output", "placed urgent", "r(C,Y) :- assign(Y,yes), placed(C,O), urgent(O).", "r/io", "placed", "SELECT a.src AS x, 'yes' AS y, sum(a.w * u.w) AS w FROM placed a JOIN urgent u ON a.dst = u.id GROUP BY ALL")
rule_query("const_in_goal", "placed priority", "r(C,O) :- placed(C,O), priority(O,'1-URGENT').", "r/io", "placed", "SELECT a.src AS x, a.dst AS y, a.w * u.w AS w FROM placed a JOIN priority u ON a.dst = u.src AND u.dst = '1-URGENT'")
rule_query("disjunction", "brand ptype", "r(P,Y) :- brand(P,Y). r(P,Y) :- ptype(P,Y).", "r/io", "brand", "SELECT x, y, sum(w) AS w FROM (SELECT src AS x, dst AS y, w FROM brand UNION ALL SELECT src, dst, w FROM ptype) GROUP BY ALL")
_NESTED = ", h AS (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM placed a JOIN contains b ON a.dst = b.src GROUP BY ALL)"
rule_query("nested_call", "placed contains brand", "h(C,P) :- placed(C,O), contains(O,P). r(C,B) :- h(C,P), brand(P,B).", "r/io", "placed", _NESTED + " SELECT h.src AS x, b.dst AS y, sum(h.w * b.w) AS w FROM h JOIN brand b ON h.dst = b.src GROUP BY ALL")
rule_query("reused_call", "placed contains brand ptype", "h(C,P) :- placed(C,O), contains(O,P). r(C,B) :- h(C,P), brand(P,B). r(C,T) :- h(C,P), ptype(P,T).", "r/io", "placed", _NESTED + " SELECT h.src AS x, b.dst AS y, sum(h.w * b.w) AS w FROM h JOIN (SELECT * FROM brand UNION ALL SELECT * FROM ptype) b ON h.dst = b.src GROUP BY ALL")
rule_query("call_as_filter", "brand supplied big", "h(B,P) :- brand(P,B). r(S,P) :- supplied(P,S), h(B,P), big(P).", "r/io", "supplied.dst", "SELECT a.dst AS x, a.src AS y, a.w * b.w AS w FROM supplied a JOIN brand b ON a.src = b.src JOIN big g ON a.src = g.id")
rule_query("reorder", "placed contains brand", "r(C,B) :- brand(P,B), contains(O,P), placed(C,O).", "r/io", "placed", _NESTED + " SELECT h.src AS x, b.dst AS y, sum(h.w * b.w) AS w FROM h JOIN brand b ON h.dst = b.src GROUP BY ALL")
_SAME = "same(A,B) :- co(A,B). same(A,B) :- co(A,Z), same(Z,B)."
for _d in (1, 2, 3):
    _levels = ", l0 AS (SELECT src, dst, w FROM co)" + "".join(f", l{i} AS (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM l{i - 1} a JOIN co b ON a.dst = b.src GROUP BY ALL)" for i in range(1, _d + 1))
    rule_query(f"recursion_d{_d}", "co", _SAME, "same/io", "co", _levels + " SELECT src AS x, dst AS y, sum(w) AS w FROM (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(_d + 1)) + ") GROUP BY ALL", depth=_d)
rule_query("mutual_modes", "supplied", "p(X,Y) :- supplied(X,Y). p(X,Y) :- p(Y,X).", "p/io", "supplied", "SELECT src AS x, dst AS y, w * 3 AS w FROM supplied", depth=4)
rule_query("depth_zero", "brand ptype", "h(P,T) :- ptype(P,T). r(P,Y) :- brand(P,Y). r(P,Y) :- h(P,Y).", "r/io", "brand", "SELECT src AS x, dst AS y, w FROM brand", depth=0)
_DID = ", s AS (SELECT src AS x, dst AS y, w FROM did), q AS (SELECT DISTINCT src AS x FROM did)"
rule_query("softmax", "did", "r(U,E) :- did(U,E).", "r/io", "did", _DID + SOFTMAX, how="softmax")
rule_query("softmax_no_answer", "placed urgent", "r(C,Y) :- assign(Y,yes), placed(C,O), urgent(O).", "r/io", "placed", ", s AS (SELECT a.src AS x, 'yes' AS y, sum(a.w * u.w) AS w FROM placed a JOIN urgent u ON a.dst = u.id GROUP BY ALL), q AS (SELECT DISTINCT src AS x FROM placed)" + SOFTMAX, how="softmax")
rule_query("log_softmax", "did", "r(U,E) :- did(U,E).", "r/io", "did", ", s AS (SELECT src AS x, dst AS y, ln(1 + w) AS w FROM did), q AS (SELECT DISTINCT src AS x FROM did)" + SOFTMAX, how="log+softmax")
rule_query("unnormalised", "did", "r(U,E) :- did(U,E).", "r/io", "did", "SELECT src AS x, dst AS y, w FROM did")
rule_query("rule_weights", "brand ptype", "r(P,Y) :- brand(P,Y) {b1}. r(P,Y) :- ptype(P,Y) {t1}.", "r/io", "brand", "SELECT x, y, sum(w) AS w FROM (SELECT src AS x, dst AS y, w * 0.5 AS w FROM brand UNION ALL SELECT src, dst, w * 0.5 FROM ptype) GROUP BY ALL", epsilon=0.5)
rule_query("feature_weights", "quality has_word", "r(D,L) :- quality(D,L) {wt(F) : has_word(D,F)}.", "r/io", "quality", ", wt AS (SELECT dst AS f, least(1.0, sum(w)) AS w FROM has_word GROUP BY dst) SELECT q.src AS x, q.dst AS y, q.w * sum(h.w * t.w) AS w FROM quality q JOIN has_word h ON q.src = h.src JOIN wt t ON h.dst = t.f GROUP BY q.src, q.dst, q.w")
rule_query("community_vote", "co brand contains", "near(A,B) :- co(A,B). near(A,B) :- co(A,Z), near(Z,B). r(O,B) :- contains(O,P), brand(P,A), near(A,B).", "r/io", "contains", ", n AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM co UNION ALL SELECT a.src, b.dst, a.w * b.w FROM co a JOIN co b ON a.dst = b.src) GROUP BY ALL), ob AS (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM contains a JOIN brand b ON a.dst = b.src GROUP BY ALL) SELECT ob.src AS x, n.dst AS y, sum(ob.w * n.w) AS w FROM ob JOIN n ON ob.dst = n.src GROUP BY ALL", depth=2, store_inputs=True)

rule_query("demanded_table", "supplied eastern brand", "makes(S,B) :- supplied(P,S), brand(P,B). r(P,B) :- supplied(P,S), eastern(S), makes(S,B).", "r/io", "supplied", ", m AS (SELECT a.dst AS src, b.dst, sum(a.w * b.w) AS w FROM supplied a JOIN brand b ON a.src = b.src GROUP BY ALL) SELECT a.src AS x, m.dst AS y, sum(a.w * e.w * m.w) AS w FROM supplied a JOIN eastern e ON a.dst = e.id JOIN m ON m.src = a.dst GROUP BY ALL")


#: ``co`` with weights that sum to nine tenths for each brand, so that sums over any depth stay finite.
_LIKELY = ", likely AS (SELECT src, dst, w * 0.9 / sum(w) OVER (PARTITION BY src) AS w FROM co)"


def _deep(name: str, rules: str, mode: str, depth: int, sql: str) -> None:
    """Register a linear recursion of a given depth."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir, ["co"])
        co = db.binary("co")
        db.add("likely", co.join(co.groupBy("src").agg(F.sum("w").alias("all")), "src").select("src", "dst", (F.col("w") * 0.9 / F.col("all")).alias("w")))
        db.relations[("likely", 2)] = written(db.binary("likely"), "likely")
        engine = Engine(db, rules, Settings(max_depth=depth, normalise="none"))
        return engine.inference(mode, _inputs(db, "co")).select("x", "y", F.round("w", 8).alias("w"))

    QUERIES[name] = run
    ORACLE_SQL[name] = with_relations(["co"], sql).replace("WITH ", "WITH RECURSIVE ", 1)


for _d in (16, 64, 99):
    _deep(f"recursion_d{_d}", "reach(A,B) :- likely(A,B). reach(A,B) :- likely(A,Z), reach(Z,B).", "reach/io", _d, _LIKELY + f", l(k, x, y, w) AS (SELECT 0, src, dst, w FROM likely UNION ALL SELECT l.k + 1, l.x, c.dst, sum(l.w * c.w) FROM l JOIN likely c ON l.y = c.src WHERE l.k < {_d} GROUP BY l.k + 1, l.x, c.dst) SELECT x, y, round(sum(w), 8) AS w FROM l GROUP BY ALL")
_deep("recursion_backward", "reach(A,B) :- likely(A,B). reach(A,B) :- reach(A,Z), likely(Z,B).", "reach/oi", 40, _LIKELY + ", l(k, x, y, w) AS (SELECT 0, dst, src, w FROM likely UNION ALL SELECT l.k + 1, l.x, c.src, sum(l.w * c.w) FROM l JOIN likely c ON l.y = c.dst WHERE l.k < 40 GROUP BY l.k + 1, l.x, c.src) SELECT x, y, round(sum(w), 8) AS w FROM l GROUP BY ALL")


def register(name: str, sql: str | None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


@register("duplicates_sum", with_relations(["supplied"], "SELECT src, dst, w FROM supplied WHERE w > 1"))
def duplicates_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, ["supplied"]).binary("supplied").filter("w > 1")


def _quality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels")
    return rows.select(F.lit("predict/io").alias("mode"), F.col("doc_id").alias("qid"), F.concat(F.lit("d"), "doc_id").alias("x"), F.concat(F.lit("q"), "quality").alias("y"))


@register("oov_examples", with_relations(["has_word"], ", k AS (SELECT DISTINCT src FROM has_word) SELECT doc_id AS qid, coalesce(k.src, '__OOV__') AS id FROM labels LEFT JOIN k ON k.src = concat('d', doc_id)"))
def oov_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, ["has_word"])
    return from_pairs(_quality_pairs(spark, sf_dir), db).x.select("qid", "id")


@register("label_normalise", with_relations(["did"], "SELECT src AS x, dst AS y, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM did"))
def label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _table(spark, sf_dir, "events")
    rows = ev.select(F.lit("r/io").alias("mode"), F.col("user_id").alias("qid"), F.concat(F.lit("u"), "user_id").alias("x"), F.col("event_type").alias("y"))
    data = from_pairs(rows)
    return data.y.select(F.concat(F.lit("u"), "qid").alias("x"), F.col("id").alias("y"), F.round("w", 6).alias("w"))


TEXT_RULES = "predict(D,L) :- assign(L,q0) {w0(F) : has_word(D,F)}. predict(D,L) :- assign(L,q1) {w1(F) : has_word(D,F)}."
#: First weights of the text task: each word's share of its mentions in documents of either quality.
_TEXT = """, m AS (SELECT h.dst AS f, q.dst AS l, sum(h.w) AS w FROM has_word h JOIN quality q ON h.src = q.src GROUP BY ALL),
t AS (SELECT f, l, w / sum(w) OVER (PARTITION BY f) AS w FROM m),
s AS (SELECT q.src AS x, t.l AS y, sum(h.w * t.w) AS w FROM quality q JOIN has_word h ON q.src = h.src JOIN t ON t.f = h.dst GROUP BY ALL),
q AS (SELECT DISTINCT src AS x FROM quality)"""
_P = """, n AS (SELECT x, y, sum(w) AS w FROM (SELECT x, y, w FROM s UNION ALL SELECT x, '__NULL__', -10.0::DOUBLE FROM q) GROUP BY x, y HAVING sum(w) <> 0),
e AS (SELECT x, y, exp(w - max(w) OVER (PARTITION BY x)) AS w FROM n),
p AS (SELECT x, y, w / sum(w) OVER (PARTITION BY x) AS w FROM e)"""


def text_task(spark: SparkSession, sf_dir: str) -> tuple[Engine, Dataset]:
    """Documents to their quality by words, with counted weights."""
    db = database(spark, sf_dir, ["has_word", "quality"], store_words=True)
    counts = db.binary("has_word").join(db.binary("quality").select("src", F.col("dst").alias("l")), "src").groupBy("dst", "l").agg(F.sum("w").alias("w"))
    total = F.sum("w").over(Window.partitionBy("dst"))
    share = written(counts.select(F.col("dst").alias("id"), "l", (F.col("w") / total).alias("w")), "weights")
    engine = Engine(db, TEXT_RULES, initial_weights=False)
    for label in ("0", "1"):
        db.set_parameter(f"w{label}", 1, share.filter(F.col("l") == f"q{label}"))
    pairs = _quality_pairs(spark, sf_dir).join(db.binary("has_word").select(F.col("src").alias("x")).distinct(), "x", "left_semi").select("mode", "qid", "x", "y")
    return engine, from_pairs(written(pairs, "pairs"))  # used many times: queries, labels and their numbers


@register("predict_quality", with_relations(["has_word", "quality"], _TEXT + SOFTMAX))
def predict_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, data = text_task(spark, sf_dir)
    p = engine.inference_batch("predict/io", data.queries("predict/io"))
    return p.select(F.concat(F.lit("d"), "qid").alias("x"), F.col("id").alias("y"), F.round("w", 6).alias("w"))


@register("accuracy", with_relations(["has_word", "quality"], _TEXT + _P + ", b AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY w DESC, y) AS k FROM p) SELECT round(avg(CASE WHEN l.dst = b.y THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM b JOIN quality l ON l.src = b.x WHERE k = 1"))
def accuracy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, data = text_task(spark, sf_dir)
    x = data.queries("predict/io")
    return accuracy(data.labels("predict/io"), engine.inference_batch("predict/io", x), x.select("qid")).select(F.round("accuracy", 6).alias("accuracy"), "n")


@register("cross_entropy", with_relations(["has_word", "quality"], _TEXT + _P + " SELECT round(sum(-ln(p.w)) / (SELECT count(*) FROM q JOIN (SELECT DISTINCT src FROM has_word) h ON h.src = q.x), 6) AS cross_entropy, (SELECT count(*) FROM q JOIN (SELECT DISTINCT src FROM has_word) h ON h.src = q.x) AS n FROM quality l JOIN p ON p.x = l.src AND p.y = l.dst"))
def cross_entropy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, data = text_task(spark, sf_dir)
    return engine.loss("predict/io", data.queries("predict/io"), data.labels("predict/io")).select(F.round("cross_entropy", 6).alias("cross_entropy"), "n")


_DELTA = _P + ", d AS (SELECT x, y, sum(w) AS w FROM (SELECT src AS x, dst AS y, 1.0 AS w FROM quality WHERE src IN (SELECT src FROM has_word) UNION ALL SELECT x, y, -w FROM p) GROUP BY ALL)"
_GRAD_W1 = ", g AS (SELECT t.f AS id, sum(h.w * d.w) AS w FROM t JOIN has_word h ON h.dst = t.f JOIN d ON d.x = h.src WHERE t.l = 'q1' AND d.y = 'q1' GROUP BY t.f)"


def _text_gradient(spark: SparkSession, sf_dir: str, **options) -> tuple[Learner, Gradients]:
    engine, data = text_task(spark, sf_dir)
    learner = Learner(engine, rate=0.1, **options)
    return learner, learner.gradient("predict/io", data.queries("predict/io"), data.labels("predict/io"))


@register("grad_unary", with_relations(["has_word", "quality"], _TEXT + _DELTA + _GRAD_W1 + " SELECT t.f AS id, round(coalesce(g.w, 0), 5) + 0.0 AS w FROM t LEFT JOIN g ON g.id = t.f WHERE t.l = 'q1'"))
def grad_unary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of every parameter, those that no example moves included."""
    learner, g = _text_gradient(spark, sf_dir)
    every = learner.engine.db.unary("w1").select("id").join(g.by_parameter[("w1", 1)], "id", "left")
    return every.select("id", (F.round(F.coalesce("w", F.lit(0.0)), 5) + F.lit(0.0)).alias("w"))  # -0.0 as 0.0


_MOVED = "greatest(0.0, {old} + 0.1 * greatest(-100.0, least(100.0, coalesce(g.w, 0) / (SELECT count(DISTINCT x) FROM d))))"


@register("apply_update", with_relations(["has_word", "quality"], _TEXT + _DELTA + _GRAD_W1 + f" SELECT t.f AS id, round({_MOVED.format(old='t.w')}, 5) AS w FROM t LEFT JOIN g ON g.id = t.f WHERE t.l = 'q1'"))
def apply_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    learner, g = _text_gradient(spark, sf_dir)
    return updated(learner.engine.db.unary("w1"), g.by_parameter[("w1", 1)], 0.1, g.n).select("id", F.round("w", 5).alias("w"))


@register("l2_step", with_relations(["has_word", "quality"], _TEXT + _DELTA + _GRAD_W1 + f" SELECT t.f AS id, round({_MOVED.format(old='t.w * 0.9')}, 5) AS w FROM t LEFT JOIN g ON g.id = t.f WHERE t.l = 'q1'"))
def l2_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    learner, g = _text_gradient(spark, sf_dir, regulariser=L2Regulariser(0.1))
    return updated(learner.regulariser.applied(learner.engine.db.unary("w1")), g.by_parameter[("w1", 1)], 0.1, g.n).select("id", F.round("w", 5).alias("w"))


@register("grad_binary", with_relations(["did", "quality"], """, s AS (SELECT src AS x, dst AS y, w FROM did), q AS (SELECT DISTINCT src AS x FROM did)""" + _P + """,
y AS (SELECT src AS x, arg_max(dst, (w, dst)) AS y FROM did GROUP BY src)
SELECT did.src, did.dst, round(CASE WHEN y.y = did.dst THEN 1.0 ELSE 0.0 END - p.w, 6) + 0.0 AS w
FROM did JOIN y ON y.x = did.src JOIN p ON p.x = did.src AND p.y = did.dst"""))
def grad_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of a whole relation; the label is each user's commonest event."""
    db = database(spark, sf_dir, ["did"])
    db.mark_parameter("did", 2)
    engine = Engine(db, "r(U,E) :- did(U,E).", initial_weights=False)
    best = db.binary("did").groupBy("src").agg(F.max(F.struct("w", "dst")).alias("b"))
    x = best.select(F.col("src").alias("qid"), F.col("src").alias("id"), F.lit(1.0).alias("w"))
    y = best.select(F.col("src").alias("qid"), F.col("b.dst").alias("id"), F.lit(1.0).alias("w"))
    return engine.loss_gradient("r/io", x, y)[("did", 2)].select("src", "dst", (F.round("w", 6) + F.lit(0.0)).alias("w"))


@register("topk", with_relations(["supplied"], "SELECT dst AS x, row_number() OVER (PARTITION BY dst ORDER BY w DESC, src DESC) AS rank, src AS y, w FROM supplied QUALIFY rank <= 10"))
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(database(spark, sf_dir, ["supplied"]), "r(S,P) :- supplied(P,S).")
    p = engine.proof_count("r/io", _inputs(engine.db, "supplied.dst"))
    return ranked(p.select(F.col("x").alias("qid"), F.col("y").alias("id"), "w"), 10).select(F.col("qid").alias("x"), F.col("rank").cast("long").alias("rank"), F.col("id").alias("y"), "w")


@register("ranked_export", with_relations(["did"], """, u AS (SELECT src, CAST(substr(src, 2) AS BIGINT) AS n FROM did GROUP BY src),
r AS (SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst DESC) AS k FROM did)
SELECT format('# proved {}\tr({},X1).\t999 msec', n + 1, src) AS value FROM u
UNION ALL SELECT printf('%d\t%.18f\tr(%s,%s).', k, w, src, dst) FROM r"""))
def ranked_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(database(spark, sf_dir, ["did"]), "r(U,E) :- did(U,E).")
    x = engine.db.binary("did").select("src").distinct().select(F.substring("src", 2, 20).cast("long").alias("qid"), F.col("src").alias("id"), F.lit(1.0).alias("w"))
    return ranked_answers("r/io", x, engine.proof_count_batch("r/io", x))


@register("catalog_sizes", with_relations(["did", "urgent"], """ SELECT 'did' AS functor, 2 AS arity, count(*) AS facts, count(DISTINCT src) AS "left", count(DISTINCT dst) AS "right", false AS parameter FROM did
UNION ALL SELECT 'urgent', 1, count(*), count(*), count(*), false FROM urgent"""))
def catalog_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, ["did", "urgent"]).sizes()


@register("fact_text", with_relations(["supplied"], " SELECT 'supplied' || chr(9) || src || chr(9) || dst || chr(9) || CAST(w AS BIGINT) AS value FROM supplied"))
def fact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, ["supplied"]).fact_text("supplied", 2)


@register("possible_ops", with_relations(["supplied", "brand"], """ SELECT 'brand/io' AS op, count(DISTINCT src) AS inputs FROM brand UNION ALL SELECT 'brand/oi', count(DISTINCT dst) FROM brand
UNION ALL SELECT 'supplied/io', count(DISTINCT src) FROM supplied UNION ALL SELECT 'supplied/oi', count(DISTINCT dst) FROM supplied"""))
def possible_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes that stored relations answer, with the symbols that each has an answer for."""
    db = database(spark, sf_dir, ["supplied", "brand"])
    ops = [(op, *op.split("/")) for op in db.possible_ops()]
    return reduce(DataFrame.union, (db.binary(f).agg(F.countDistinct("src" if pattern == "io" else "dst").alias("inputs")).select(F.lit(op).alias("op"), "inputs") for op, f, pattern in ops))


#: Relations that triples are made of, some of them inverses or compositions of others.
_MINED = ["brand", "ptype", "supplied", "c_nation", "s_nation", "in_region"]
_TRIPLES = """, t AS (
SELECT src AS h, 'brand' AS r, dst AS t FROM brand UNION ALL SELECT src, 'label', dst FROM brand UNION ALL SELECT src, 'ptype', dst FROM ptype UNION ALL
SELECT src, 'supplied', dst FROM supplied UNION ALL SELECT dst, 'supplies', src FROM supplied UNION ALL
SELECT src, 'c_nation', dst FROM c_nation UNION ALL SELECT src, 's_nation', dst FROM s_nation UNION ALL SELECT dst, 'inhabited', src FROM c_nation UNION ALL
SELECT src, 'in_region', dst FROM in_region UNION ALL SELECT a.src, 'c_region', b.dst FROM c_nation a JOIN in_region b ON a.dst = b.src UNION ALL
SELECT a.src, 's_region', b.dst FROM s_nation a JOIN in_region b ON a.dst = b.src), c AS (SELECT r, count(*) AS c FROM t GROUP BY r)"""


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, _MINED)

    def named(name: str, rel: DataFrame, head: str = "src", tail: str = "dst") -> DataFrame:
        return rel.select(F.col(head).alias("head"), F.lit(name).alias("relation"), F.col(tail).alias("tail"))

    region = db.binary("in_region").select(F.col("src").alias("n"), F.col("dst").alias("r"))
    parts = [named(n, db.binary(n)) for n in _MINED] + [named("label", db.binary("brand")), named("inhabited", db.binary("c_nation"), "dst", "src"), named("supplies", db.binary("supplied"), "dst", "src")]
    parts += [named(n, db.binary(of).join(region, F.col("dst") == F.col("n")), "src", "r") for n, of in (("c_region", "c_nation"), ("s_region", "s_nation"))]
    return reduce(DataFrame.union, parts)


@register("mine_entail", with_relations(_MINED, _TRIPLES + " SELECT p, q, n, round(ln(n / c.c), 6) AS score FROM (SELECT a.r AS p, b.r AS q, count(*) AS n FROM t a JOIN t b ON a.h = b.h AND a.t = b.t AND a.r <> b.r GROUP BY ALL) JOIN c ON c.r = q"))
def mine_entail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.entailments(_triples(spark, sf_dir)).withColumn("score", F.round("score", 6))


@register("mine_invert", with_relations(_MINED, _TRIPLES + " SELECT p, q, n, round(ln(n / c.c), 6) AS score FROM (SELECT a.r AS p, b.r AS q, count(*) AS n FROM t a JOIN t b ON a.h = b.t AND a.t = b.h GROUP BY ALL) JOIN c ON c.r = q"))
def mine_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.inversions(_triples(spark, sf_dir)).withColumn("score", F.round("score", 6))


@register("mine_chain", with_relations(_MINED, _TRIPLES + """, j AS (SELECT a.r AS q, b.r AS r, a.h AS x, b.t AS y, count(*) AS k FROM t a JOIN t b ON a.t = b.h GROUP BY ALL),
n AS (SELECT p.r AS p, j.q, j.r, count(*) AS n FROM j JOIN (SELECT DISTINCT h, r, t FROM t) p ON p.h = j.x AND p.t = j.y GROUP BY ALL),
o AS (SELECT q, r, sum(k) AS o FROM j GROUP BY ALL)
SELECT n.p, n.q, n.r, n.n, round(ln(n.n / o.o), 6) AS score FROM n JOIN o ON o.q = n.q AND o.r = n.r"""))
def mine_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.chains(_triples(spark, sf_dir)).withColumn("score", F.round("score", 6))


@register("tfidf", with_relations(["has_word"], """, f AS (SELECT dst, count(*) AS df FROM has_word GROUP BY dst), n AS (SELECT count(DISTINCT src) AS n FROM has_word),
r AS (SELECT src, has_word.dst, ln(1 + w) * ln(n / df) AS w FROM has_word JOIN f ON f.dst = has_word.dst, n)
SELECT src, dst, round(coalesce(w / nullif(sqrt(sum(w * w) OVER (PARTITION BY src)), 0), 0.0), 6) AS w FROM r"""))
def tfidf_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.tfidf(counted_words(spark, sf_dir)).withColumn("w", F.round("w", 6))


@register("plugin_scale", with_relations(["placed", "contains"], "SELECT a.src AS x, b.dst AS y, 2 * sum(a.w * b.w) AS w FROM placed a JOIN contains b ON a.dst = b.src GROUP BY ALL"))
def plugin_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(database(spark, sf_dir, ["placed", "contains"]), "r(C,P) :- placed(C,O), contains(O,Q), double(Q,P).")
    engine.plugin("double/2", lambda m: m.withColumn("w", F.col("w") * 2))
    return engine.proof_count("r/io", _inputs(engine.db, "placed"))


@register("minibatches", "SELECT concat('d', doc_id) AS id, concat('q', quality) AS y, 1 AS batches, true AS full FROM labels")
def minibatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every example and its answer, in how many batches it came, and whether
    all batches but the last hold 64."""
    data = from_pairs(_quality_pairs(spark, sf_dir)).in_batches(64, seed=3)
    rows = data.x.select("mode", "batch", "qid", "id").join(data.y.select("mode", "batch", "qid", F.col("id").alias("y")), ["mode", "batch", "qid"])
    sizes = rows.groupBy("mode", "batch").agg(F.count(F.lit(1)).alias("n")).agg((F.sum((F.col("n") != 64).cast("int")) <= 1).alias("full"))
    return rows.groupBy("id", "y").agg(F.count(F.lit(1)).cast("int").alias("batches")).crossJoin(sizes)


@register("hashed_embedding", with_relations(["did"], "SELECT src AS x, dst AS y, true AS bounded FROM did"))
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events through hashed cells and back: none is lost, none becomes less."""
    did = database(spark, sf_dir, ["did"]).binary("did")
    message = did.select(F.col("src").alias("qid"), F.col("dst").alias("id"), "w")
    back = vectors.unembed(vectors.embed(message, columns=128), did.select(F.col("dst").alias("id")).distinct(), columns=128)
    both = did.select(F.col("src").alias("qid"), F.col("dst").alias("id"), F.col("w").alias("was")).join(back, ["qid", "id"])
    return both.select(F.col("qid").alias("x"), F.col("id").alias("y"), (F.col("w") >= F.col("was")).alias("bounded"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["chain5_softmax"](spark, sf_dir)
