"""Fact files: tab-separated lines, and type directives among the comments.

  pred⇥arg   pred⇥arg⇥weight   pred⇥arg⇥arg   pred⇥arg⇥arg⇥weight
  # :- pred(type[,type])       # :- trainable(pred,arity)

A line of three fields may be a weighted unary or a plain binary fact.  With
types declared, the declaration decides; where it is undecided, and without
types, a number in the third field makes the fact unary.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalog import Database, log
from weft.plans.parse import NoRule, parse_goal
from weft.scratch import paths_of, written

NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


class BadFact(ValueError):
    """A line that is no fact."""


def _directives(lines: Iterable[str], db: Database) -> None:
    for line in lines:
        m = re.match(r"#\s*:-\s*(.*)", line)
        if not m:
            continue
        try:
            goal = parse_goal(m.group(1).strip())
        except NoRule:
            log.warning("not a declaration: %s", line)
            continue
        if goal.functor == "trainable" and goal.arity == 2 and goal.args[1] in ("1", "2"):
            db.mark_parameter(goal.args[0], int(goal.args[1]))
        else:
            db.declare(goal.functor, *goal.args)


def parsed(lines: DataFrame, db: Database, weighted_tuples: bool = True) -> DataFrame:
    """(functor, arity, a, b, w) of each fact line of (value)."""
    parts = F.split(F.rtrim(F.regexp_replace("value", r"[\r\n]+$", "")), "\t")
    f = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select(parts.alias("f"), F.size(parts).alias("n"))
    f = f.withColumns({"functor": F.trim(F.get("f", F.lit(0))), "a": F.get("f", F.lit(1)), "x": F.get("f", F.lit(2)), "y": F.get("f", F.lit(3))})
    number = F.col("x").rlike(NUMBER)
    if db.typed:
        one = sorted(k for k, n in db.types if n == 1)
        two = sorted(k for k, n in db.types if n == 2)
        only_one, only_two = [k for k in one if k not in two], [k for k in two if k not in one]
        unary3 = F.col("functor").isin(only_one) | ~F.col("functor").isin(only_two) & number & (F.col("x").try_cast("double") > 0)
    else:
        unary3 = number if weighted_tuples else F.lit(False)
    unary = (F.col("n") == 2) | (F.col("n") == 3) & unary3
    weight = F.when(F.col("n") == 4, F.col("y").try_cast("double")).when((F.col("n") == 3) & unary, F.col("x").try_cast("double")).otherwise(1.0)
    rows = f.select("functor", F.when(unary, 1).otherwise(2).alias("arity"), "a", F.when(~unary, F.col("x")).alias("b"), weight.alias("w"), "n")
    bad = rows.filter(~F.col("n").isin(2, 3, 4) | F.col("w").isNull() | (F.col("w") < 0) & ((F.col("n") == 4) | F.lit(db.typed))).head(1)
    if bad:
        raise BadFact(f"not a fact: {bad[0].functor} {bad[0].a} {bad[0].b} {bad[0].w}")
    return rows.drop("n")


def _load(db: Database, lines: DataFrame, weighted_tuples: bool, split: bool = False) -> Database:
    # directives are as many as there are predicates; other comments stay where they are
    _directives((r.value for r in lines.filter(F.col("value").rlike(r"^#\s*:-")).select("value").collect()), db)
    rows = parsed(lines, db, weighted_tuples)
    if split:  # the text is read once, and each relation then reads its own facts
        rows = written(rows, "facts", by=["functor", "arity"])
    for r in rows.groupBy("functor", "arity").count().sort("functor", "arity").collect():
        key = (r.functor, r.arity)
        if db.typed and key not in db.types:
            log.warning("no types are declared for %s/%d: its facts are skipped", *key)
            continue
        own = rows.filter((F.col("functor") == r.functor) & (F.col("arity") == r.arity))
        db.add(r.functor, own.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w") if r.arity == 2 else own.select(F.col("a").alias("id"), "w"))
    return db


def load_files(spark: SparkSession, spec: str | list[str], db: Database | None = None, weighted_tuples: bool = True) -> Database:
    """Facts of a ``:``-separated list of files, or of several paths; all files
    of a predicate are loaded together."""
    paths = spec if isinstance(spec, list) else paths_of(spec)
    return _load(db or Database(spark), spark.read.text(paths), weighted_tuples, split=True)


def load_lines(spark: SparkSession, lines: Iterable[str], db: Database | None = None, weighted_tuples: bool = True) -> Database:
    """Facts of lines in memory."""
    rows = [(x.rstrip("\r\n"),) for x in lines]
    return _load(db or Database(spark), spark.createDataFrame(rows, "value string"), weighted_tuples)


class FactBuffer:
    """Several files that are loaded at once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def buffer(self, path: str) -> None:
        self.paths.append(path)

    def flush(self, db: Database | None = None) -> Database:
        return load_files(self.spark, self.paths, db)
