"""Questions asked in many small batches: answered once for all inputs, then looked up.

A batch costs Spark the same fixed time whether it has ten inputs or ten
million.  Where many batches will be asked of the same rules and facts, the
answers of all inputs are made in one go, with joins ordered for that size, and
stored by a hash of the input; a batch is then one look-up without a shuffle
of the store.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.lower import NULL, Evaluation
from weft.plans.nodes import in_order
from weft.plans.planner import UnsupportedRule
from weft.plans.terms import Mode
from weft.scratch import written

#: Answers in a part of the store by estimate, the most parts, and the files that a part's answers are dealt to.
ROWS_A_PART, MOST_PARTS, FILES_A_PART = 2_000_000, 10_000, 4
#: Listed symbols that are broadcast, as one literal; more are joined like a DataFrame's.
MOST_LISTED = 5_000


class Stale(ValueError):
    """Facts or parameters have been replaced since a question was prepared."""


class Prepared:
    """Modes of an engine with the answers of every input that has any.

    The inputs are the symbols at those ends of relations that a mode's rules
    begin with; a mode whose rules don't tell them, or that calls a plugin, is
    an ``UnsupportedRule``.  Answers are rows, not lists, and an input's are
    dealt to several files, so no input is too large for a task.  More than
    ``most_rows`` answers by estimate are an error: such a question is
    better asked as it is.
    """

    def __init__(self, engine, modes: Iterable[str | Mode], most_rows: float = 1e11):
        self.engine, self.normalise = engine, engine.normalise
        self.modes = [str(Mode.parse(m)) for m in modes]
        self._used: dict[tuple[str, int], DataFrame] = {}
        self._prepare(most_rows)

    def _prepare(self, most_rows: float) -> None:
        engine, db, expected, answers = self.engine, self.engine.db, 0.0, None
        for mode in self.modes:
            domain = engine.program.domain(Mode.parse(mode))
            if domain is None:
                raise UnsupportedRule(f"the inputs of {mode} can't be told from its rules")
            plan = engine.program.plan(mode)
            names = {(n.detail[0], 1 if n.kind == "unary" else 2) for n in in_order(plan) if n.kind in ("unary", "preimage", "step")}
            if any(n.kind == "ones" for n in in_order(plan)):
                names |= set(db.relations)
            self._used |= {n: db.relations[n] for n in names | {(f, a) for f, a, _ in domain}}
            ids = Evaluation(db, db.onehot([]), program=engine.program).inputs(domain)
            batch = ids.select(F.col("id").alias("qid"), "id", F.lit(1.0).alias("w"))
            expected += Evaluation(db, batch, program=engine.program).size(plan).rows
            if expected > most_rows:
                raise ValueError(f"about {expected:.3g} answers, more than {most_rows:.3g}")
            one = engine.inference_batch(mode, batch, own_ids=True).select(F.lit(mode).alias("mode"), F.col("qid").alias("x"), F.col("id").alias("y"), "w")
            answers = one if answers is None else answers.unionByName(one)
        self.parts = min(max(ceil(expected / ROWS_A_PART), 1), MOST_PARTS)
        dealt = answers.withColumn("part", self._part()).repartition(F.col("part"), F.pmod(F.xxhash64("y"), F.lit(FILES_A_PART)))
        self.answers = written(dealt.sortWithinPartitions("mode", "part", "x"), "prepared", by=["mode", "part"])
        self.known = None
        if self.normalise != "none":  # inputs that aren't known have the null entity alone
            self.known = written(self.answers.select("mode", "part", "x").distinct().repartition("mode", "part"), "known", by=["mode", "part"])

    def _part(self):
        return F.pmod(F.xxhash64("x"), F.lit(self.parts)).cast("int")

    def stale(self) -> list[str]:
        """Relations that have been replaced since their answers were stored."""
        return sorted(f"{f}/{n}" for (f, n), was in self._used.items() if self.engine.db.relations.get((f, n)) is not was)

    def ask(self, inputs: DataFrame | Iterable[str], modes: Iterable[str] | None = None) -> DataFrame:
        """(mode, x, y, w), as ``engine.inference`` gives it for each mode.

        ``inputs`` are symbols, or a DataFrame with a column x; repeated ones
        count once, null ones not at all, and unknown ones have no answer.
        Of listed symbols only their parts are read, and up to
        ``MOST_LISTED`` of them are broadcast.  A DataFrame is broadcast where Spark knows it to be small, and shuffled
        where not.
        """
        if self.stale():
            raise Stale(f"replaced since: {', '.join(self.stale())}")
        if self.engine.normalise != self.normalise:
            raise Stale(f"prepared with normalisation {self.normalise}")
        modes = self.modes if modes is None else [str(Mode.parse(m)) for m in modes]
        if unknown := set(modes) - set(self.modes):
            raise ValueError(f"not prepared: {', '.join(sorted(unknown))}")
        few, parts = False, None
        if isinstance(inputs, DataFrame):
            asked = inputs.select(F.col("x").cast("string").alias("x")).filter("x is not null").distinct()
        else:
            listed, spark = sorted({x for x in inputs if x is not None}), self.engine.db.spark
            few = len(listed) <= MOST_LISTED
            if few:  # one literal: no rows are sent from Python
                asked = spark.range(0, 1, 1, 1).select(F.explode(F.from_json(F.lit(json.dumps(listed)), "array<string>")).alias("x"))
                parts = sorted(r.part for r in asked.select(self._part().alias("part")).distinct().collect()) if self.parts > 1 else None
                asked = F.broadcast(asked)
            else:
                asked = spark.createDataFrame([(x,) for x in listed], "x string")
        every = asked.withColumn("part", self._part()).withColumn("mode", F.explode(F.array(*map(F.lit, modes))))

        def stored(table: DataFrame) -> DataFrame:
            pruned = table if parts is None else table.filter(F.col("part").isin(parts))
            return pruned.filter(F.col("mode").isin(modes)).join(F.broadcast(every) if few else every, ["mode", "part", "x"])

        found = stored(self.answers).select("mode", "x", "y", "w")
        if self.known is None:
            return found
        known = stored(self.known).select("mode", "x")
        if few:  # at most a row for each listed symbol and mode
            known = F.broadcast(known)
        alone = every.join(known, ["mode", "x"], "left_anti").select("mode", "x", F.lit(NULL).alias("y"), F.lit(1.0).alias("w"))
        return found.unionByName(alone)
