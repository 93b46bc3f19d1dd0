"""Driver queries of sources, sinks, messages, learners and interfaces, and their SQL.

They go over the same tables as :mod:`weft.queries`; what is written on the
way goes to the shared folder.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.builder import Builder
from weft.catalog import Database, row_symbols
from weft.engine import Engine, Session, Settings
from weft.functions import messages, mining, vectors
from weft.learn import AdaGrad, Experiment, FixedRateGD, FixedRateSGD, Gradients, OneModeGD, RecordingTracer, SigmoidLikelihood, WholeDatasetGD, l1_cost, rescaled, sigmoid, sigmoid_cross_entropy
from weft.operators.plugins import EmbeddedEdges
from weft.plans.parse import parse_goal, parse_rules
from weft.queries import _MINED, _TRIPLES, SOFTMAX, _inputs, _quality_pairs, _triples, database, register, with_relations
from weft.scratch import shared_folder, written
from weft.sources import store
from weft.sources.examples import Dataset, example_text, from_pairs, from_relation, load_examples
from weft.sources.facts import FactBuffer, load_files, load_lines


def place(spark: SparkSession, suffix: str) -> str:
    """A path of its own in the shared folder."""
    return posixpath.join(shared_folder(spark), f"weft-{uuid.uuid4().hex[:12]}{suffix}")


def _text(df: DataFrame, suffix: str) -> str:
    path = place(df.sparkSession, suffix)
    df.write.text(path)
    return path


def _facts(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """A fact file of relations of the tables."""
    db = database(spark, sf_dir, list(names))
    out = None
    for f, n in db.relations:
        lines = db.fact_text(f, n)
        out = lines if out is None else out.union(lines)
    return _text(out, ".cfacts")


def _as(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*(F.col(old).alias(new) for new, old in names.items()))


def _message(spark: SparkSession, sf_dir: str, name: str = "did") -> DataFrame:
    """A relation as a message: its left symbols are the queries."""
    return database(spark, sf_dir, [name]).binary(name).select(F.col("src").alias("qid"), F.col("dst").alias("id"), "w")


# -- sources and sinks ---------------------------------------------------------


@register("load_facts", with_relations(["c_nation", "urgent"], "SELECT src AS a, dst AS b, w FROM c_nation UNION ALL SELECT id, NULL, w FROM urgent"))
def load_facts(spark, sf_dir):
    db = load_files(spark, _facts(spark, sf_dir, "c_nation", "urgent"))
    return _as(db.binary("c_nation"), a="src", b="dst", w="w").union(db.unary("urgent").select("id", F.lit(None).cast("string"), "w"))


@register("load_facts_lines", "SELECT 'lies_in' AS functor, concat('n', n_nationkey) AS a, concat('r', n_regionkey) AS b, 2.0::DOUBLE AS w FROM nation UNION ALL SELECT 'code', concat('n', n_nationkey), NULL, n_nationkey / 4 + 0.5 FROM nation")
def load_facts_lines(spark, sf_dir):
    """Lines held in memory: each nation's region twice, its code with a weight, comments and blank lines between."""
    lines = []
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").toLocalIterator():
        lines += [f"lies_in\tn{r.n_nationkey}\tr{r.n_regionkey}", "# a comment", f"lies_in\tn{r.n_nationkey}\tr{r.n_regionkey}", "", f"code\tn{r.n_nationkey}\t{r.n_nationkey / 4 + 0.5}"]
    db = load_lines(spark, lines)
    unary = db.unary("code").select(F.lit("code").alias("functor"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), "w")
    return db.binary("lies_in").select(F.lit("lies_in").alias("functor"), F.col("src").alias("a"), F.col("dst").alias("b"), "w").union(unary)


@register("load_facts_incremental", with_relations(["c_nation", "s_nation"], "SELECT src AS x, dst AS y, w FROM c_nation UNION ALL SELECT src, dst, w FROM s_nation"))
def load_facts_incremental(spark, sf_dir):
    """Two files whose facts of one predicate are loaded together."""
    buffer = FactBuffer(spark)
    for name in ("c_nation", "s_nation"):
        lines = database(spark, sf_dir, [name]).fact_text(name, 2)
        buffer.buffer(_text(lines.select(F.regexp_replace("value", f"^{name}", "lives").alias("value")), ".cfacts"))
    return _as(buffer.flush().binary("lives"), x="src", y="dst", w="w")


@register(
    "declared_types",
    with_relations(["did", "urgent"], "SELECT 'did' AS functor, 'user,event' AS types, true AS trainable, 'did/io' AS asks, count(*) AS facts, sum(w) AS total FROM did UNION ALL SELECT 'urgent', 'order', false, '', count(*), sum(w) FROM urgent"),
)
def declared_types(spark, sf_dir):
    """A file of facts that begins with what they are and what is trained."""
    facts = spark.read.text(_facts(spark, sf_dir, "did", "urgent"))
    said = spark.createDataFrame([("# :- did(user,event)",), ("# :- urgent(order)",), ("# :- trainable(did,2)",)], "value string")
    db = load_files(spark, _text(said.union(facts), ".cfacts"))
    told = [(f, ",".join(t), (f, n) in db.parameters, ",".join(op for op in db.possible_ops("user") if op.startswith(f"{f}/"))) for (f, n), t in db.types.items()]
    sums = [rel.agg(F.count(F.lit(1)).alias("facts"), F.sum("w").alias("total")).select(F.lit(f).alias("functor"), "facts", "total") for (f, _), rel in sorted(db.relations.items())]
    return spark.createDataFrame(told, "functor string, types string, trainable boolean, asks string").join(sums[0].union(sums[1]), "functor")


@register("save_restore", with_relations(["did", "urgent"], "SELECT 'did' AS functor, src AS a, dst AS b, w FROM did UNION ALL SELECT 'urgent', id, NULL, w FROM urgent"))
def save_restore(spark, sf_dir):
    path = place(spark, ".db")
    store.save_database(database(spark, sf_dir, ["did", "urgent"]), path)
    db = store.load_database(spark, path)
    unary = db.unary("urgent").select(F.lit("urgent"), "id", F.lit(None).cast("string"), "w")
    return db.binary("did").select(F.lit("did").alias("functor"), F.col("src").alias("a"), F.col("dst").alias("b"), "w").union(unary)


@register("save_subset", with_relations(["did", "brand"], "SELECT 'did/2' AS relation, count(*) AS facts FROM did"))
def save_subset(spark, sf_dir):
    """Parameters only."""
    db, path = database(spark, sf_dir, ["did", "brand"]), place(spark, ".db")
    db.mark_parameter("did", 2)
    store.save_database(db, path, "parameters")
    return store.load_database(spark, path).sizes().select(F.concat("functor", F.lit("/"), "arity").alias("relation"), "facts")


@register("import_relations", with_relations(["brand", "did"], "SELECT src AS x, dst AS y, w FROM brand"))
def import_relations(spark, sf_dir):
    """One relation of a saved database into another, and as a dictionary."""
    path = place(spark, ".db")
    store.save_database(database(spark, sf_dir, ["brand", "did"]), path)
    db = store.load_database(spark, path, Database(spark), only=[("brand", 2)])
    assert list(db.relations) == [("brand", 2)] == list(store.stored_relations(spark, path, [("brand", 2)]))
    return _as(db.binary("brand"), x="src", y="dst", w="w")


@register("schema_round_trip", "SELECT * FROM (VALUES ('brand', 'part,label', true)) v(functor, types, trainable)")
def schema_round_trip(spark, sf_dir):
    db, path = database(spark, sf_dir, ["brand"]), place(spark, ".db")
    db.declare("brand", "part", "label")
    db.mark_parameter("brand", 2)
    store.save_database(db, path)
    back = store.load_database(spark, path)
    return spark.createDataFrame([(f, ",".join(t), (f, n) in back.parameters) for (f, n), t in back.types.items()], "functor string, types string, trainable boolean")


@register("cached_load", with_relations(["s_nation"], "SELECT src AS x, dst AS y, w, reading FROM s_nation, (VALUES (1), (2)) v(reading)"))
def cached_load(spark, sf_dir):
    """From the source, and then from the cache."""
    source, cache = _facts(spark, sf_dir, "s_nation"), place(spark, ".db")
    first = store.open_database(spark, f"{cache}|{source}").binary("s_nation").withColumn("reading", F.lit(1))
    assert store.fresh(spark, cache, source)
    both = first.union(store.open_database(spark, f"{cache}|{source}").binary("s_nation").withColumn("reading", F.lit(2)))
    return _as(both, x="src", y="dst", w="w", reading="reading")


_LABELLED = "SELECT concat('d', doc_id) AS x, concat('q', quality) AS y, 1.0::DOUBLE AS w FROM labels"


def _answers(data: Dataset, mode: str) -> DataFrame:
    return data.queries(mode).select("qid", F.col("id").alias("x")).join(data.labels(mode).select("qid", F.col("id").alias("y"), "w"), "qid").select("x", "y", "w")


@register("load_exam", _LABELLED)
def load_exam(spark, sf_dir):
    lines = _quality_pairs(spark, sf_dir).select(F.concat_ws("\t", F.lit("predict"), "x", "y").alias("value"))
    return _answers(load_examples(database(spark, sf_dir, ["quality"]), _text(lines, ".exam")), "predict/io")


@register("load_example_goals", _LABELLED)
def load_example_goals(spark, sf_dir):
    goal = "concat('predict(', x, ',Y)\t-predict(', x, ',none)\t+predict(', x, ',', y, ')') AS value"
    lines = _quality_pairs(spark, sf_dir).selectExpr(goal)
    return _answers(load_examples(database(spark, sf_dir, ["quality"]), _text(lines, ".examples")), "predict/io")


@register("examples_of_relation", with_relations(["did"], "SELECT a.src AS x, b.dst AS y, round(sum(b.w / t.w), 6) AS w FROM did a JOIN did b ON b.src = a.src JOIN (SELECT src, sum(w) AS w FROM did GROUP BY src) t ON t.src = a.src GROUP BY ALL"))
def examples_of_relation(spark, sf_dir):
    """An example for each fact, each with all answers of its input."""
    return _answers(from_relation(database(spark, sf_dir, ["did"]), "r/io", "did"), "r/io").groupBy("x", "y").agg(F.round(F.sum("w"), 6).alias("w"))


@register("dataset_round_trip", _LABELLED)
def dataset_round_trip(spark, sf_dir):
    path = place(spark, ".dset")
    store.save_dataset(from_pairs(_quality_pairs(spark, sf_dir)), path)
    return _answers(store.open_dataset(spark, path, Database(spark)), "predict/io")


@register("cached_dataset", _LABELLED)
def cached_dataset(spark, sf_dir):
    db = database(spark, sf_dir, ["quality"])
    lines = _quality_pairs(spark, sf_dir).select(F.concat_ws("\t", F.lit("predict"), "x", "y").alias("value"))
    spec = f"{place(spark, '.dset')}|{_text(lines, '.exam')}"
    store.open_dataset(spark, spec, db)
    return _answers(store.open_dataset(spark, spec, db), "predict/io")


@register("cached_relation_dataset", with_relations(["did"], "SELECT count(*) AS examples, count(DISTINCT src) AS inputs FROM did"))
def cached_relation_dataset(spark, sf_dir):
    db, cache = database(spark, sf_dir, ["did"]), place(spark, ".dset")
    store.cached_relation_dataset(db, cache, "r/io", "did")
    x = store.cached_relation_dataset(db, cache, "r/io", "did").x
    return x.agg(F.countDistinct("qid").alias("examples"), F.countDistinct("id").alias("inputs"))


@register("save_program", with_relations(["placed", "contains"], "SELECT a.src AS x, b.dst AS y, sum(a.w * b.w) AS w FROM placed a JOIN contains b ON a.dst = b.src GROUP BY ALL"))
def save_program(spark, sf_dir):
    path = place(spark, "")
    Engine(database(spark, sf_dir, ["placed", "contains"]), "r(C,P) :- placed(C,O), contains(O,P).").save(path)
    rules, db = store.load_program(spark, path)
    return Engine(db, rules).proof_count("r/io", _inputs(db, "placed"))


@register("example_text", "SELECT 'predict(d' || doc_id || ',Y)' || chr(9) || '+predict(d' || doc_id || ',q' || quality || ')' AS value FROM labels")
def example_lines(spark, sf_dir):
    return example_text(from_pairs(_quality_pairs(spark, sf_dir)), "predict/io")


@register("fact_dictionary", with_relations(["in_region"], "SELECT 'in_region(' || src || ',' || dst || ')' AS fact, w FROM in_region"))
def fact_dictionary(spark, sf_dir):
    facts = database(spark, sf_dir, ["in_region"]).facts("in_region", 2)
    return spark.createDataFrame([(str(g), w) for g, w in facts.items()], "fact string, w double")


@register("rows_as_symbols", with_relations(["in_region"], "SELECT src AS x, dst AS y, w FROM in_region WHERE src IN ('n0', 'n7')"))
def rows_as_symbols(spark, sf_dir):
    engine = Engine(database(spark, sf_dir, ["in_region"]), "r(N,R) :- in_region(N,R).", Settings(normalise="none"))
    got = engine.eval("r/io", ["n0", "n7"])
    return spark.createDataFrame([(("n0", "n7")[q], y, w) for q, row in got.items() for y, w in row.items()], "x string, y string, w double")


def _rules_of_brands(spark: SparkSession, sf_dir: str) -> str:
    """A rule with a weight of its own for each brand, whose name needs quotes."""
    brands = sorted(r.dst for r in database(spark, sf_dir, ["brand"]).binary("brand").select("dst").distinct().collect())
    return "\n".join(f"r(P,Y) :- brand(P,Y), assign(Y,'{b}') {{b{b.split('#')[1]}}}." for b in brands)


@register("rule_ids", "SELECT DISTINCT 'b' || substr(p_brand, 7) AS rule_id FROM part")
def rule_ids(spark, sf_dir):
    engine = Engine(Database(spark), _rules_of_brands(spark, sf_dir), initial_weights=False)
    return spark.createDataFrame([(r,) for r in engine.features.rule_ids], "rule_id string")


# -- constants and messages ------------------------------------------------------


@register("constants", with_relations(["did"], """, s AS (SELECT src AS id FROM did UNION SELECT dst FROM did)
SELECT 'ones' AS kind, id, 1.0::DOUBLE AS w FROM s UNION ALL SELECT 'ones', unnest(['__NULL__', '__OOV__']), 1.0 UNION ALL SELECT 'nulls', '__NULL__', count(DISTINCT src)::DOUBLE FROM did
UNION ALL SELECT 'onehot', unnest(['click', '__OOV__']), 1.0 UNION ALL SELECT 'dimension', NULL, count(*) + 3.0 FROM s"""))
def constants(spark, sf_dir):
    db = database(spark, sf_dir, ["did"])
    nulls = db.nulls(_message(spark, sf_dir)).groupBy("id").agg(F.sum("w").alias("w")).select(F.lit("nulls"), "id", "w")
    one = db.onehot(["click", "no such event"], unknown_as_oov=True).select(F.lit("onehot"), "id", "w")
    size = spark.createDataFrame([("dimension", None, float(db.dimension()))], "kind string, id string, w double")
    assert not db.zeros().head(1)
    return db.ones().select(F.lit("ones").alias("kind"), "id", "w").union(nulls).union(one).union(size)


@register("symbol_numbers", with_relations(["did"], ", s AS (SELECT src AS id FROM did UNION SELECT dst FROM did UNION SELECT unnest(['__NULL__', '__OOV__'])), n AS (SELECT id, true AS back, true AS in_range, true AS distinct_numbers FROM s) SELECT * FROM n UNION ALL SELECT 'nobody', true, false, true"))
def symbol_numbers(spark, sf_dir):
    """Symbols to numbers and back; an unknown symbol has -1."""
    db = database(spark, sf_dir, ["did"])
    asked = db.symbols().union(spark.createDataFrame([("nobody",)], "id string"))
    numbers = db.number_of(asked)
    back = db.symbol_of(numbers.select("number")).select("number", F.col("id").alias("again"))
    n = db.dimension() - 1
    same = F.col("id").eqNullSafe(F.col("again")) | (F.col("number") == -1) & F.col("again").isNull()
    distinct = spark.range(1).select(F.lit(numbers.select("number").distinct().count() == n + 1).alias("distinct_numbers"))
    return numbers.join(back, "number").select("id", same.alias("back"), F.col("number").between(0, n - 1).alias("in_range")).crossJoin(distinct)


@register("message_rows", with_relations(["did"], """SELECT 'sum' AS what, src AS a, sum(w) AS w FROM did GROUP BY src UNION ALL SELECT 'mean', dst, round(sum(w) / (SELECT count(DISTINCT src) FROM did), 6) FROM did GROUP BY dst
UNION ALL SELECT 'column', dst, sum(w) FROM did GROUP BY dst UNION ALL SELECT 'entries', dst, count(*) FROM did GROUP BY dst UNION ALL SELECT 'largest', dst, max(w) FROM did GROUP BY dst
UNION ALL SELECT 'doubled', NULL, 2 * sum(w) FROM did UNION ALL SELECT 'queries', NULL, count(DISTINCT src) FROM did UNION ALL SELECT 'symbols', NULL, count(DISTINCT dst) FROM did UNION ALL SELECT 'rows', NULL, count(*) FROM did UNION ALL SELECT 'most', NULL, max(w) FROM did"""))
def message_rows(spark, sf_dir):
    m = _message(spark, sf_dir)
    n = m.select("qid").distinct().count()
    col = messages.columns(m)
    parts = [
        messages.row_sum(m).select(F.lit("sum").alias("what"), F.col("qid").alias("a"), "w"),
        messages.column_mean(m, n).select(F.lit("mean"), "id", F.round("w", 6)),
        messages.column_sum(m).select(F.lit("column"), "id", "w"),
        col.select(F.lit("entries"), "id", F.col("entries").cast("double")),
        col.select(F.lit("largest"), "id", "largest"),
        messages.map_weights(m, lambda w: 2 * w).agg(F.sum("w")).select(F.lit("doubled"), F.lit(None).cast("string"), "sum(w)"),
        messages.summary(m).selectExpr("stack(4, 'queries', double(queries), 'symbols', double(symbols), 'rows', double(entries), 'most', largest) AS (what, w)").select("what", F.lit(None).cast("string"), "w"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@register("message_altered", with_relations(["did"], "SELECT src AS x, dst AS y, round(w / max(w) OVER (PARTITION BY src), 6) AS w FROM did"))
def message_altered(spark, sf_dir):
    out = messages.altered(_message(spark, sf_dir), lambda w, row: w / F.max(w).over(row))
    return out.select(F.col("qid").alias("x"), F.col("id").alias("y"), F.round("w", 6).alias("w"))


@register("message_numbering", with_relations(["did"], "SELECT src AS x, dst AS y, w, true AS gapless, 'shuffled' AS how FROM did UNION ALL SELECT dst, NULL, sum(w), true, 'repeated, stacked, selected' FROM did GROUP BY dst"))
def message_numbering(spark, sf_dir):
    """Shuffled queries keep their rows, under numbers without gaps."""
    m = _message(spark, sf_dir)
    number = messages.numbered(m.select("qid").distinct(), "number", "qid", seed=5)
    ends = number.agg((F.max("number") + 1 == F.count("number")).alias("a"), (F.countDistinct("number") == F.count("number")).alias("b"), (F.min("number") == 0).alias("c")).select(F.expr("a AND b AND c").alias("gapless"))
    mixed = messages.shuffled(m.join(number, "qid").select(F.col("number").alias("qid"), F.concat("qid", F.lit("|"), "id").alias("id"), "w"), 9)
    rows = mixed.select(F.substring_index("id", "|", 1).alias("x"), F.substring_index("id", "|", -1).alias("y"), "w").crossJoin(ends).withColumn("how", F.lit("shuffled"))
    total = messages.column_sum(m)
    stacked = messages.stack([messages.repeat(total, 2), messages.repeat(total, 3)])
    one = messages.selected(stacked, 3, 4)
    return rows.union(one.select("id", F.lit(None).cast("string"), "w", (F.col("qid") == 0), F.lit("repeated, stacked, selected")))


@register("dataset_modes", "SELECT 'predict/io' AS mode, count(*) AS examples, true AS known FROM labels UNION ALL SELECT 'predict/oi', 0, false")
def dataset_modes(spark, sf_dir):
    data = from_pairs(_quality_pairs(spark, sf_dir))
    return spark.createDataFrame([(m, data.extract(m).size(), m in data.modes() and data.has_mode(m)) for m in ("predict/io", "predict/oi")], "mode string, examples long, known boolean")


@register("dataset_shuffle", "SELECT concat('d', doc_id) AS x, concat('q', quality) AS y, true AS in_range FROM labels")
def dataset_shuffle(spark, sf_dir):
    data = from_pairs(_quality_pairs(spark, sf_dir)).shuffled(seed=4)
    n = data.x.select("qid").distinct().count()
    both = data.x.select("qid", F.col("id").alias("x")).join(data.y.select("qid", F.col("id").alias("y")), "qid")
    return both.select("x", "y", (F.col("qid").between(0, data.size() - 1) & F.lit(n == data.size())).alias("in_range"))


# -- rules ------------------------------------------------------------------------

_TWO = with_relations(["placed", "contains"], "SELECT a.src AS x, b.dst AS y, sum(a.w * b.w) AS w FROM placed a JOIN contains b ON a.dst = b.src GROUP BY ALL")


@register("pythonic_rules", _TWO)
def pythonic_rules(spark, sf_dir):
    engine = Engine(database(spark, sf_dir, ["placed", "contains"]), "r(C,P) <= placed(C,O) & contains(O,P)", Settings(syntax="pythonic"))
    return engine.proof_count("r/io", _inputs(engine.db, "placed"))


@register("built_rules", _TWO)
def built_rules(spark, sf_dir):
    b = Builder(spark)
    c, o, p = b.variables("C O P")
    r, placed, contains = b.predicates("r placed contains")
    b += r(c, p) <= placed(c, o) & contains(o, p)
    engine = Engine(database(spark, sf_dir, ["placed", "contains"]), b.rule_set)
    return engine.proof_count("r/io", _inputs(engine.db, "placed"))


@register("rule_printing", "WITH b AS (SELECT DISTINCT p_brand AS b, substr(p_brand, 7) AS n FROM part) SELECT 'r(P,Y) :- brand(P,Y), assign(Y,''' || b || ''') {b' || n || '}.' AS text FROM b UNION ALL SELECT 'r(P,Y) <= brand(P,Y) & assign(Y,''' || b || ''') // b' || n FROM b")
def rule_printing(spark, sf_dir):
    """Rules of both syntaxes as text; names that need quotes keep them."""
    rules = parse_rules(_rules_of_brands(spark, sf_dir))
    return spark.createDataFrame([(line.strip(),) for how in ("classic", "pythonic") for line in rules.to_text(how).splitlines() if line.strip()], "text string")


@register("typed_weights", with_relations(["did"], "SELECT DISTINCT dst AS id, 0.5::DOUBLE AS w FROM did UNION ALL SELECT unnest(['__NULL__', '__OOV__']), 0.5"))
def typed_weights(spark, sf_dir):
    """Typed, a generated feature starts with one weight for every symbol of its inferred type."""
    db = database(spark, sf_dir, ["did"])
    db.declare("did", "user", "event")
    Engine(db, "r(U,E) :- did(U,E) {wt(F) : did(U,F)}.", epsilon=0.5)
    return db.unary("wt").select("id", "w")


@register("inferred_types", "SELECT * FROM (VALUES ('r/io', 'user', 'event'), ('r/oi', 'event', 'user')) v(mode, input, output)")
def inferred_types(spark, sf_dir):
    db = database(spark, sf_dir, ["did"])
    db.declare("did", "user", "event")
    engine = Engine(db, "h(A,B) :- did(A,B). r(A,B) :- h(A,B).")
    return spark.createDataFrame([(m, engine.program.input_type(m), engine.program.output_type(m)) for m in ("r/io", "r/oi")], "mode string, input string, output string")


@register("composed_answers", with_relations(["brand", "ptype"], "SELECT x, y, sum(w) AS w FROM (SELECT src AS x, dst AS y, 2 * w AS w FROM brand UNION ALL SELECT src, dst, w FROM ptype) GROUP BY ALL"))
def composed_answers(spark, sf_dir):
    """Answers of two predicates put together outside the rules."""
    engine = Engine(database(spark, sf_dir, ["brand", "ptype"]), "b(P,Y) :- brand(P,Y). t(P,Y) :- ptype(P,Y).")
    x = _inputs(engine.db, "brand")
    both = engine.proof_count("b/io", x).withColumn("w", 2 * F.col("w")).union(engine.proof_count("t/io", x))
    return both.groupBy("x", "y").agg(F.sum("w").alias("w"))


@register("numbers_checked", with_relations(["placed", "contains"], """, m AS (SELECT src AS x, dst AS y, w, CAST(substr(dst, 2) AS BIGINT) % 7 = 0 AS bad FROM placed),
n AS (SELECT m.x, c.dst AS y, sum(m.w * c.w) AS w, bool_or(bad) AS bad FROM m JOIN contains c ON c.src = m.y GROUP BY ALL), b AS (SELECT 'placed' AS step, w, bad FROM m UNION ALL SELECT 'contains', w, bad FROM n)
SELECT 'step(' || step || ', forward)' AS node, count(*) AS rows, count_if(bad) AS not_a_number, min(w) FILTER (NOT bad) AS least, max(w) FILTER (NOT bad) AS largest, sum(w) FILTER (NOT bad) AS total FROM b GROUP BY step"""))
def numbers_checked(spark, sf_dir):
    """Messages counted where a seventh of all orders have a weight that is no number."""
    db = database(spark, sf_dir, ["placed", "contains"])
    bad = F.expr("CAST(substr(dst, 2) AS BIGINT) % 7 = 0")
    db.set_parameter("placed", 2, db.binary("placed").withColumn("w", F.when(bad, F.lit(float("nan"))).otherwise(F.col("w"))))
    engine = Engine(db, "r(C,P) :- placed(C,O), contains(O,P).")
    return engine.message_counts("r/io", _inputs(engine.db, "placed.src")).filter("node LIKE 'step%'").drop("number")


@register("session_listing", "SELECT unnest(['rules', 'facts', 'plan', 'answers', 'help']) AS shown")
def session_listing(spark, sf_dir):
    """What a session shows of rules, facts, a plan, answers and itself."""
    session = Session(Engine(database(spark, sf_dir, ["in_region"]), "r(N,R) :- in_region(N,R).", Settings(normalise="none")))
    session.set(echo=0, depth=3)
    seen = {"rules": "r(N,R)" in session.list("r/2"), "facts": "25 facts" in session.list("in_region/2"), "plan": "step(in_region, forward)" in session.list("r/io"), "answers": len(session.eval("r/io", "n3")) == 1, "help": "eval" in session.help()}
    return spark.createDataFrame([(k,) for k, v in seen.items() if v], "shown string")


@register("messages_and_deltas", "SELECT * FROM (VALUES ('message', 'step(in_region, forward)'), ('message', 'input'), ('delta', 'step(in_region, forward)')) v(kind, node)")
def messages_and_deltas(spark, sf_dir):
    """The debugger's nodes, forward and back."""
    db = database(spark, sf_dir, ["in_region"])
    db.mark_parameter("in_region", 2)
    engine = Engine(db, "r(N,R) :- in_region(N,R).", initial_weights=False)
    x = db.onehot(["n0"])
    forward, back = engine.show_messages("r/io", ["n0"]), engine.show_deltas("r/io", x, db.onehot(["r1"]))
    rows = [(kind, line.split(": ")[0].split(" ", 1)[1]) for kind, text in (("message", forward), ("delta", back)) for line in text.splitlines()]
    return spark.createDataFrame(rows, "kind string, node string")


# -- plugins ------------------------------------------------------------------------


@register("plugin_unary", with_relations(["placed", "urgent"], "SELECT a.src AS x, a.dst AS y, a.w * 0.25 AS w FROM placed a JOIN urgent u ON a.dst = u.id"))
def plugin_unary(spark, sf_dir):
    db = database(spark, sf_dir, ["placed", "urgent"])
    engine = Engine(db, "r(C,O) :- placed(C,O), some(O).")
    engine.plugin("some/1", lambda: db.unary("urgent").withColumn("w", F.lit(0.25)))
    return engine.proof_count("r/io", _inputs(db, "placed"))


@register("plugin_softmax", with_relations(["did"], ", e AS (SELECT src, dst, exp(w - max(w) OVER (PARTITION BY src)) AS w FROM did) SELECT src AS x, dst AS y, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM e"))
def plugin_softmax(spark, sf_dir):
    """A plugin that looks at a whole row."""
    engine = Engine(database(spark, sf_dir, ["did"]), "r(U,E) :- did(U,F), best(F,E).")
    engine.plugin("best/2", lambda m: messages.altered(messages.altered(m, lambda w, row: F.exp(w - F.max(w).over(row))), lambda w, row: w / F.sum(w).over(row)))
    return engine.proof_count("r/io", _inputs(engine.db, "did")).withColumn("w", F.round("w", 6))


@register("plugin_identity", with_relations(["did"], "SELECT src AS x, dst AS y, w FROM did"))
def plugin_identity(spark, sf_dir):
    engine = Engine(database(spark, sf_dir, ["did"]), "r(U,E) :- did(U,F), same(F,E).")
    engine.plugin("same/2", lambda m: m)
    return engine.proof_count("r/io", _inputs(engine.db, "did"))


# -- learning ---------------------------------------------------------------------

#: One step on ``did`` towards each user's commonest event, at rate 0.5.
_STEP = """, s AS (SELECT src AS x, dst AS y, w FROM did), q AS (SELECT DISTINCT src AS x FROM did),
n AS (SELECT x, y, sum(w) AS w FROM (SELECT x, y, w FROM s UNION ALL SELECT x, '__NULL__', -10.0::DOUBLE FROM q) GROUP BY x, y HAVING sum(w) <> 0),
e AS (SELECT x, y, exp(w - max(w) OVER (PARTITION BY x)) AS w FROM n),
p AS (SELECT x, y, w / sum(w) OVER (PARTITION BY x) AS w FROM e),
best AS (SELECT src AS x, arg_max(dst, (w, dst)) AS y FROM did GROUP BY src),
g AS (SELECT did.src, did.dst, did.w, (CASE WHEN best.y = did.dst THEN 1.0 ELSE 0.0 END - p.w) / (SELECT count(*) FROM q) AS g
      FROM did JOIN best ON best.x = did.src JOIN p ON p.x = did.src AND p.y = did.dst)"""
_MOVED = _STEP + " SELECT src AS x, dst AS y, round(greatest(0.0, w + 0.5 * g), 8) AS w FROM g"


def _best_event(spark: SparkSession, sf_dir: str) -> tuple[Engine, Dataset]:
    db = database(spark, sf_dir, ["did"])
    db.mark_parameter("did", 2)
    best = db.binary("did").groupBy("src").agg(F.max(F.struct("w", "dst")).alias("b"))
    rows = best.select(F.lit("r/io").alias("mode"), F.substring("src", 2, 20).cast("long").alias("qid"), F.col("src").alias("x"), F.col("b.dst").alias("y"))
    return Engine(db, "r(U,E) :- did(U,E).", initial_weights=False), from_pairs(rows)


def learner_query(name: str, make, sql: str = _MOVED) -> None:
    """Register one epoch of a learner."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, data = _best_event(spark, sf_dir)
        make(engine).train(data)
        return _as(engine.db.binary("did"), x="src", y="dst", w="w").withColumn("w", F.round("w", 8))

    register(name, with_relations(["did"], sql))(run)


learner_query("learn_fixed_rate", lambda e: FixedRateGD(e, epochs=1, rate=0.5))
learner_query("learn_one_mode", lambda e: OneModeGD(e, epochs=1, rate=0.5))


@register(
    "learn_minibatch",
    with_relations(["did"], _STEP + ", c AS (SELECT CASE WHEN count(*) % 3 = 0 THEN count(*) // 3 WHEN count(*) % 2 = 0 THEN count(*) // 2 ELSE count(*) END AS size, count(*) AS n FROM q) SELECT src AS x, dst AS y, round(greatest(0.0, w + 0.5 * g * (SELECT n FROM c) / (SELECT size FROM c)), 8) AS w FROM g"),
)
def learn_minibatch(spark, sf_dir):
    """Three batches, or two, whichever come out full, each a step of its own:
    a user's facts move with the batch that the user is in, by its mean."""
    engine, data = _best_event(spark, sf_dir)
    n = data.size()
    FixedRateSGD(engine, epochs=1, rate=0.5, batch=next(n // k for k in (3, 2, 1) if n % k == 0)).train(data)
    return _as(engine.db.binary("did"), x="src", y="dst", w="w").withColumn("w", F.round("w", 8))


learner_query("learn_whole_dataset", lambda e: WholeDatasetGD(e, epochs=1, rate=0.5))
learner_query("learn_adagrad", lambda e: AdaGrad(e, epochs=1, rate=0.5), _STEP + " SELECT src AS x, dst AS y, round(greatest(0.0, w + 0.5 * g / sqrt(g * g + 0.1)), 8) AS w FROM g")
learner_query("learn_softplus", lambda e: FixedRateGD(e, epochs=1, rate=0.5, positive=True), _STEP + ", v AS (SELECT src, dst, CASE WHEN w > 30 THEN w ELSE ln(greatest(exp(w) - 1, 1e-12)) END + 0.5 * g * (1 - exp(-w)) AS v FROM g) SELECT src AS x, dst AS y, round(CASE WHEN v > 30 THEN v ELSE ln(1 + exp(v)) END, 8) AS w FROM v")


# -- embedded edges and other losses ------------------------------------------------

_SPOTS = """, vec AS (SELECT concat('p', p_partkey) AS id, 0 AS k, p_size / 50.0::DOUBLE AS v FROM part UNION ALL SELECT concat('p', p_partkey), 1, p_retailprice::DOUBLE / 2000 FROM part
  UNION ALL SELECT concat('s', s_suppkey), 0, s_acctbal::DOUBLE / 10000 FROM supplier UNION ALL SELECT concat('s', s_suppkey), 1, s_nationkey / 25.0::DOUBLE FROM supplier),
u AS (SELECT id, sum(v) AS u FROM vec GROUP BY id),
e AS (SELECT s.src, s.dst, s.w AS stored, a.u - b.u AS d, s.w * (greatest(a.u - b.u, 0) + ln(1 + exp(-abs(a.u - b.u)))) AS w FROM supplied s JOIN u a ON a.id = s.src JOIN u b ON b.id = s.dst),
s AS (SELECT e.src AS x, n.dst AS y, sum(e.w * n.w) AS w FROM e JOIN s_nation n ON n.src = e.dst GROUP BY ALL),
best AS (SELECT src AS x, arg_max(dst, (w, dst)) AS y FROM (SELECT a.src, n.dst, sum(a.w * n.w) AS w FROM supplied a JOIN s_nation n ON n.src = a.dst GROUP BY ALL) GROUP BY src), q AS (SELECT DISTINCT src AS x FROM supplied)"""
#: From delta(x, y, g) over n examples to one step of the vectors.
_SPOTS_MOVED = """, ge AS (SELECT e.src, e.dst, sum(delta.g * n.w) * any_value(e.stored) / (1 + exp(-any_value(e.d))) AS g FROM e JOIN s_nation n ON n.src = e.dst JOIN delta ON delta.x = e.src AND delta.y = n.dst GROUP BY e.src, e.dst),
gi AS (SELECT id, sum(g) AS g FROM (SELECT src AS id, g FROM ge UNION ALL SELECT dst, -g FROM ge) GROUP BY id)
SELECT vec.id, vec.k, round(v + {rate} * greatest(-100, least(100, g / (SELECT n FROM examples))), 8) AS v FROM vec JOIN gi ON gi.id = vec.id"""


def _spots(spark: SparkSession, sf_dir: str) -> tuple[Engine, Dataset]:
    """Parts to nations over suppliers whose distance from a part their vectors tell."""
    db = database(spark, sf_dir, ["supplied", "s_nation"])
    db.store_dealt("supplied", "src")  # used many times below, by part
    part, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier"))
    vectors = part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.array(F.col("p_size") / 50.0, F.col("p_retailprice").cast("double") / 2000).alias("v"))
    db.add_vectors("spot", vectors.unionByName(supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.array(F.col("s_acctbal").cast("double") / 10000, F.col("s_nationkey") / 25.0).alias("v"))))
    db.mark_parameter("spot", 0)
    engine = Engine(db, "r(P,N) :- near(P,S), s_nation(S,N).", initial_weights=False)
    engine.plugin("near/2", EmbeddedEdges(db, "supplied", "spot"))
    to = db.binary("supplied").withColumnRenamed("dst", "mid").join(db.binary("s_nation").select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("w").alias("nw")), "mid")
    best = to.groupBy("src", "to").agg(F.sum(F.col("w") * F.col("nw")).alias("w")).groupBy("src").agg(F.max(F.struct("w", "to")).alias("b"))
    # a part is its own query's name, so that its rows stay with its facts
    return engine, from_pairs(best.select(F.lit("r/io").alias("mode"), F.col("src").alias("qid"), F.col("src").alias("x"), F.col("b.to").alias("y"))).stored()


def _moved_spots(engine: Engine) -> DataFrame:
    return engine.db.parameter("spot", 0).select("id", "k", F.round("w", 8).alias("v"))


@register(
    "learn_embedded_edges",
    with_relations(
        ["supplied", "s_nation"],
        _SPOTS
        + """, m AS (SELECT x, y, w FROM s UNION ALL SELECT x, NULL, -10.0::DOUBLE FROM q), x AS (SELECT x, y, exp(w - max(w) OVER (PARTITION BY x)) AS w FROM m),
p AS (SELECT x, y, w / sum(w) OVER (PARTITION BY x) AS p FROM x), delta AS (SELECT p.x, p.y, (CASE WHEN best.y = p.y THEN 1.0 ELSE 0.0 END) - p.p AS g FROM p JOIN best ON best.x = p.x WHERE p.y IS NOT NULL), examples AS (SELECT count(*) AS n FROM q)"""
        + _SPOTS_MOVED.format(rate=5.0),
    ),
)
def learn_embedded_edges(spark, sf_dir):
    """One step of the vectors behind a plugin's edges, through a relation that comes after it."""
    engine, data = _spots(spark, sf_dir)
    FixedRateGD(engine, epochs=1, rate=5.0).train(data)
    return _moved_spots(engine)


_LOGISTIC = _SPOTS + """, l AS (SELECT s.x, s.y, s.w, CASE WHEN best.y = s.y THEN 1.0 ELSE 0.0 END AS label, 0.5 * s.w - 1 AS t FROM s JOIN best ON best.x = s.x), examples AS (SELECT count(*) AS n FROM l)"""


@register("learn_sigmoid", with_relations(["supplied", "s_nation"], _LOGISTIC + ", delta AS (SELECT x, y, 0.5 * (label - 1 / (1 + exp(-t))) AS g FROM l)" + _SPOTS_MOVED.format(rate=50.0)))
def learn_sigmoid(spark, sf_dir):
    """The same step up the likelihood of a yes or no for every pair."""
    engine, loss = _logistic(spark, sf_dir)[:2]
    return _moved_spots(engine)


@register(
    "learn_slope_and_bias",
    with_relations(
        ["supplied", "s_nation"],
        _LOGISTIC
        + """ SELECT round(avg(greatest(t, 0) - t * label + ln(1 + exp(-abs(t)))), 8) AS loss, round(0.5 + 50 * greatest(-100, least(100, avg((label - 1 / (1 + exp(-t))) * w))), 8) AS slope, round(-1 + 50 * greatest(-100, least(100, avg(label - 1 / (1 + exp(-t))))), 8) AS bias FROM l""",
    ),
)
def learn_slope_and_bias(spark, sf_dir):
    """The loss before that step, and slope and bias after it."""
    _, loss, before = _logistic(spark, sf_dir)
    slope, bias = loss.scalars()
    return before.select(F.round("loss", 8).alias("loss"), F.round(F.lit(slope), 8).alias("slope"), F.round(F.lit(bias), 8).alias("bias"))


def _logistic(spark: SparkSession, sf_dir: str) -> tuple[Engine, SigmoidLikelihood, DataFrame]:
    engine, data = _spots(spark, sf_dir)
    loss = SigmoidLikelihood(engine.db)
    engine.db.set_parameter("logistic", 0, spark.createDataFrame([("slope", 0, 0.5), ("bias", 0, -1.0)], "id string, k int, w double"))
    before = written(loss.cost(engine.proof_count_batch("r/io", data.queries("r/io")), data.labels("r/io")), "loss")
    FixedRateGD(engine, epochs=1, rate=50.0, loss=loss).train(data)
    return engine, loss, before


@register("gradients_merged", with_relations(["did"], _STEP + " SELECT src AS x, dst AS y, round(2 * g * (SELECT count(*) FROM q), 6) + 0.0 AS w FROM g"))
def gradients_merged(spark, sf_dir):
    """Gradients of two halves of a batch, twice each, added up."""
    engine, data = _best_event(spark, sf_dir)
    learner, total = FixedRateGD(engine), Gradients()
    for half in (0, 1, 0, 1):
        x, y = (d.filter(F.col("qid") % 2 == half) for d in (data.queries("r/io"), data.labels("r/io")))
        total = total.added(learner.gradient("r/io", x, y))
    return _as(total.by_parameter[("did", 2)], x="src", y="dst", w="w").withColumn("w", F.round("w", 6) + F.lit(0.0))


@register("experiment", "SELECT unnest([0, 1]) AS epoch, true AS better, true AS traced")
def experiment(spark, sf_dir):
    """Training and its records: the likelihood of the labels grows."""
    engine, data = _best_event(spark, sf_dir)
    tracer = RecordingTracer()
    out = Experiment(FixedRateGD(engine, epochs=2, rate=50.0, tracer=tracer), data, data).run()
    better = out["train_cross_entropy_after"] < out["train_cross_entropy_before"] and out["test_accuracy_after"] >= out["test_accuracy_before"]
    return spark.createDataFrame([(r["epoch"], better, {"seconds", "cross_entropy", "accuracy", "regularised"} <= set(r)) for r in tracer.records], "epoch int, better boolean, traced boolean")


@register("logistic_loss", with_relations(["did"], """, best AS (SELECT src, arg_max(dst, (w, dst)) AS dst FROM did GROUP BY src), s AS (SELECT did.src, did.dst, w, CASE WHEN best.src IS NULL THEN 0.0 ELSE 1.0 END AS y FROM did LEFT JOIN best ON best.src = did.src AND best.dst = did.dst)
SELECT round(avg(greatest(w, 0) - w * y + ln(1 + exp(-abs(w)))), 6) AS loss, (SELECT round(sum(1 / (1 + exp(-(0.5 * w - 1)))), 6) FROM did) AS logistic, (SELECT sum(abs(w)) FROM did) AS l1, (SELECT round(sum(w * 0.1), 6) FROM did) AS tenth FROM s"""))
def logistic_loss(spark, sf_dir):
    engine, data = _best_event(spark, sf_dir)
    did = engine.db.binary("did")
    scores = did.select(F.substring("src", 2, 20).cast("long").alias("qid"), F.col("dst").alias("id"), "w")
    loss = sigmoid_cross_entropy(data.labels("r/io"), scores).select(F.round("loss", 6).alias("loss"))
    logistic = sigmoid(scores, 0.5, -1.0).agg(F.round(F.sum("w"), 6).alias("logistic"))
    return loss.crossJoin(logistic).crossJoin(l1_cost(did)).crossJoin(rescaled(did, 0.1).agg(F.round(F.sum("w"), 6).alias("tenth")))


@register("partner_database", with_relations(["did"], "SELECT 'own' AS whose, sum(w) AS total FROM did UNION ALL SELECT 'partner', 3 * sum(w) FROM did"))
def partner_database(spark, sf_dir):
    """A partner's parameters are its own."""
    db = database(spark, sf_dir, ["did"])
    db.mark_parameter("did", 2)
    other = db.partner()
    other.set_parameter("did", 2, rescaled(db.binary("did"), 3.0))
    rows = [d.parameter("did", 2).agg(F.sum("w").alias("total")).select(F.lit(n).alias("whose"), "total") for n, d in (("own", db), ("partner", other))]
    return rows[0].union(rows[1])


@register("mined_rules", with_relations(_MINED, _TRIPLES + """, e AS (SELECT a.r AS p, b.r AS q, count(*) AS n FROM t a JOIN t b ON a.h = b.h AND a.t = b.t AND a.r <> b.r GROUP BY ALL),
i AS (SELECT a.r AS p, b.r AS q, count(*) AS n FROM t a JOIN t b ON a.h = b.t AND a.t = b.h GROUP BY ALL),
j AS (SELECT a.r AS q, b.r AS r, a.h AS x, b.t AS y, count(*) AS k FROM t a JOIN t b ON a.t = b.h GROUP BY ALL),
n AS (SELECT p.r AS p, j.q, j.r, count(*) AS n FROM j JOIN (SELECT DISTINCT h, r, t FROM t) p ON p.h = j.x AND p.t = j.y GROUP BY ALL),
o AS (SELECT q, r, sum(k) AS o FROM j GROUP BY ALL)
SELECT printf('%s(X,Y):-%s(X,Y) {if_%s_%s}.' || chr(9) || '#score %.3f', p, q, p, q, ln(n / c.c)) AS value FROM e JOIN c ON c.r = q
UNION ALL SELECT printf('%s(X,Y):-%s(Y,X) {ifInv_%s_%s}.' || chr(9) || '#score %.3f', p, q, p, q, ln(n / c.c)) FROM i JOIN c ON c.r = q
UNION ALL SELECT printf('%s(X,Y):-%s(X,Z),%s(Z,Y) {chain_%s_%s_%s}.' || chr(9) || '#score %.3f', n.p, n.q, n.r, n.p, n.q, n.r, ln(n.n / o.o)) FROM n JOIN o ON o.q = n.q AND o.r = n.r"""))
def mined_rules(spark, sf_dir):
    return mining.rule_text(_triples(spark, sf_dir))


@register("eval_softmax", with_relations(["in_region"], ", s AS (SELECT src AS x, dst AS y, w FROM in_region WHERE src IN ('n1', 'n2')), q AS (SELECT DISTINCT x FROM s)" + SOFTMAX))
def eval_softmax(spark, sf_dir):
    engine = Engine(database(spark, sf_dir, ["in_region"]), "r(N,R) :- in_region(N,R).")
    rows = row_symbols(engine.inference_batch("r/io", engine.db.onehot(["n1", "n2"])))
    return spark.createDataFrame([(("n1", "n2")[q], y, round(w, 6)) for q, row in rows.items() for y, w in row.items()], "x string, y string, w double")


@register("hub_steps", with_relations(["c_nation", "in_region", "s_nation"], """ SELECT c.src AS x, s.src AS y, sum(c.w * r.w * b.w * s.w) AS w FROM c_nation c JOIN in_region r ON r.src = c.dst
JOIN in_region b ON b.dst = r.dst JOIN s_nation s ON s.dst = b.src GROUP BY ALL"""))
def hub_steps(spark, sf_dir):
    """Customers to all suppliers of their region: nations and regions are hubs, split from 100 facts on."""
    db = database(spark, sf_dir, ["c_nation", "in_region", "s_nation"])
    db.hub_rows = 100
    engine = Engine(db, "r(C,S) :- c_nation(C,N), in_region(N,R), in_region(M,R), s_nation(S,M).", Settings(normalise="none"))
    return engine.proof_count("r/io", _inputs(db, "c_nation.src"))


def _prepared(spark: SparkSession, sf_dir: str, names: list[str], rules: str, modes: list[str], inputs: list[str], how: str) -> DataFrame:
    """Answers looked up in a prepared question, of all symbols of some ends."""
    db = database(spark, sf_dir, names)
    ready = Engine(db, rules, Settings(normalise=how)).prepare(*modes)
    asked = _inputs(db, inputs[0])
    for end in inputs[1:]:
        asked = asked.union(_inputs(db, end))
    return ready.ask(asked)


@register("prepared_answers", with_relations(["supplied", "brand"], """, m AS (SELECT a.dst AS s, b.dst AS b, sum(a.w * b.w) AS w FROM supplied a JOIN brand b ON a.src = b.src GROUP BY ALL)
SELECT 'makes/io' AS mode, s AS x, b AS y, w FROM m UNION ALL SELECT 'makes/oi', b, s, w FROM m"""))
def prepared_answers(spark, sf_dir):
    """Suppliers' brands and brands' suppliers, prepared together and asked in one batch."""
    return _prepared(spark, sf_dir, ["supplied", "brand"], "makes(S,B) :- supplied(P,S), brand(P,B).", ["makes/io", "makes/oi"], ["supplied.dst", "brand.dst"], "none")


@register("prepared_softmax", with_relations(["supplied", "eastern", "brand"], ", s AS (SELECT a.src AS x, a.dst AS y, a.w * e.w AS w FROM supplied a JOIN eastern e ON a.dst = e.id), q AS (SELECT src AS x FROM supplied UNION SELECT dst FROM brand)" + SOFTMAX.replace("SELECT x, y, round", "SELECT 'r/io' AS mode, x, y, round")))
def prepared_softmax(spark, sf_dir):
    """Parts' eastern suppliers; parts without any, and brands, which are no inputs of it, have the null entity alone."""
    out = _prepared(spark, sf_dir, ["supplied", "eastern", "brand"], "r(P,S) :- supplied(P,S), eastern(S).", ["r/io"], ["supplied", "brand.dst"], "softmax")
    return out.select("mode", "x", "y", F.round("w", 6).alias("w"))


#: Columns of sketches that are wide enough for a symbol's cells to be its own, at any size of the tables.
_WIDE = 1 << 62


@register("cells_product", with_relations(["placed", "priority"], "SELECT a.src AS x, b.dst AS y, sum(a.w * b.w) AS w FROM placed a JOIN priority b ON a.dst = b.src GROUP BY ALL"))
def cells_product(spark, sf_dir):
    """Customers' priorities by a step taken in hashed cells and read back."""
    db = database(spark, sf_dir, ["placed", "priority"])
    message = db.binary("placed").select(F.col("src").alias("qid"), F.col("dst").alias("id"), "w")
    moved = vectors.step_cells(vectors.embed(message, _WIDE), db.binary("priority"), _WIDE)
    back = vectors.unembed(moved, db.binary("priority").select(F.col("dst").alias("id")).distinct(), _WIDE)
    return back.select(F.col("qid").alias("x"), F.col("id").alias("y"), F.round("w", 6).alias("w"))


@register("cells_contain", with_relations(["contains"], "SELECT dst AS x, count(*) AS orders FROM contains WHERE w >= 1 GROUP BY ALL"))
def cells_contain(spark, sf_dir):
    """In how many orders' sketches each part is found."""
    db = database(spark, sf_dir, ["contains"])
    rel = db.dealt("contains", "src")
    message = rel.select(F.col("src").alias("qid"), F.col("dst").alias("id"), "w")
    found = vectors.contains(vectors.embed(message, _WIDE), db.ends("contains", "dst"), columns=_WIDE)
    return found.groupBy(F.col("id").alias("x")).agg(F.count(F.lit(1)).alias("orders"))
