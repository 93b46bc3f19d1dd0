"""Datasets: queries and the answers they should have, by mode."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalog import OOV, Database
from weft.functions.messages import numbered
from weft.plans.terms import Mode
from weft.scratch import written


class BadExample(ValueError):
    """A line that is no example."""


#: Folders that shuffled examples are written to, at most about so many.
FOLDERS = 2_000


@dataclass
class Dataset:
    """x: (mode, qid, id, w), one entry a query; y: (mode, qid, id, w), the
    distribution of its right answers."""

    x: DataFrame
    y: DataFrame

    def modes(self) -> list[str]:
        return sorted(r.mode for r in self.x.select("mode").distinct().collect())

    def has_mode(self, mode: str) -> bool:
        return bool(self.x.filter(F.col("mode") == str(mode)).head(1))

    def extract(self, mode: str) -> Dataset:
        return Dataset(self.x.filter(F.col("mode") == str(mode)), self.y.filter(F.col("mode") == str(mode)))

    def queries(self, mode: str) -> DataFrame:
        return self.x.filter(F.col("mode") == str(mode)).select("qid", "id", "w")

    def labels(self, mode: str) -> DataFrame:
        return self.y.filter(F.col("mode") == str(mode)).select("qid", "id", "w")

    def stored(self) -> Dataset:
        """The same examples, written, so that they are made once for all that read them."""
        return Dataset(written(self.x, "examples"), written(self.y, "examples"))

    def size(self) -> int:
        return self.x.select("mode", "qid").distinct().count()

    def shuffled(self, seed: int = 0) -> Dataset:
        """New numbers in the order of a seeded hash, the same for x and y."""
        new = numbered(self.x.select("mode", "qid").distinct(), "new", "qid", within=("mode",), seed=seed)

        def renumber(df: DataFrame) -> DataFrame:
            return df.join(new, ["mode", "qid"]).select("mode", F.col("new").alias("qid"), "id", "w")

        return Dataset(renumber(self.x), renumber(self.y))

    def _shelved(self, size: int, seed: int) -> tuple[DataFrame, DataFrame, dict[str, int], int]:
        """(x, y, examples by mode, batches a folder): the shuffled examples with
        their ``batch``, stored in folders of some batches each."""
        mixed = self.shuffled(seed)
        counts = {r["mode"]: r["n"] for r in mixed.x.groupBy("mode").agg(F.countDistinct("qid").alias("n")).collect()}
        parts = sum(-(-n // size) for n in counts.values())
        shelf = max(1, -(-parts // FOLDERS))
        number = F.coalesce(*(F.when(F.col("mode") == m, F.lit(k)) for k, m in enumerate(sorted(counts)))) if counts else F.lit(0)
        spread = int(mixed.x.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, as small tables that make many files are written by few tasks otherwise

        def shelved(df: DataFrame) -> DataFrame:
            df = df.withColumn("batch", F.floor(F.col("qid") / size).cast("long")).withColumn("of_mode", number).withColumn("folder", F.floor(F.col("batch") / shelf).cast("long"))
            return written(df.repartition(min(spread, max(1, parts // shelf)), "of_mode", "folder"), "batches", by=["of_mode", "folder"])

        return shelved(mixed.x), shelved(mixed.y), counts, shelf

    def in_batches(self, size: int = 100, seed: int = 0) -> Dataset:
        """All of :meth:`batches` as one dataset, whose tables have the number of
        the batch in its mode, ``batch``, too: for work on all batches at once."""
        x, y, _, _ = self._shelved(size, seed)
        return Dataset(x.drop("of_mode", "folder"), y.drop("of_mode", "folder"))

    def batches(self, size: int = 100, seed: int = 0) -> Iterator[tuple[str, Dataset]]:
        """Every example once, in batches of one mode each, in random order;
        a mode's last batch may be short.

        The shuffled examples are written once, with a folder for each batch
        (or for several, where there would be over FOLDERS), and a batch is read
        from its folder alone.
        """
        import random

        x, y, counts, shelf = self._shelved(size, seed)
        parts = [(k, m, i) for k, (m, n) in enumerate(sorted(counts.items())) for i in range(-(-n // size))]
        random.Random(seed).shuffle(parts)
        for k, mode, i in parts:
            here = (F.col("of_mode") == k) & (F.col("folder") == i // shelf) & (F.col("batch") == i)
            yield mode, Dataset(x.filter(here).drop("of_mode", "folder", "batch"), y.filter(here).drop("of_mode", "folder", "batch"))


def normalise_labels(y: DataFrame) -> DataFrame:
    """Each query's labels as a distribution: with k answers, 1/k each."""
    total = y.groupBy("mode", "qid").agg(F.sum("w").alias("total"))
    return y.join(total, ["mode", "qid"]).select("mode", "qid", "id", (F.col("w") / F.col("total")).alias("w"))


def from_pairs(rows: DataFrame, db: Database | None = None, normalise: bool = True, input_type: str | None = None, output_type: str | None = None) -> Dataset:
    """From (mode, qid, x, y), a row for each right answer; answers that the
    database doesn't know become the unknown entity."""
    x = rows.select("mode", "qid", F.col("x").alias("id")).distinct().withColumn("w", F.lit(1.0))
    y = rows.filter("y is not null").groupBy("mode", "qid", F.col("y").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    if db is not None:
        known_x, known_y = db.symbols(input_type).withColumnRenamed("id", "known"), db.symbols(output_type).withColumnRenamed("id", "known")
        swap = F.when(F.col("known").isNull(), OOV).otherwise(F.col("id")).alias("id")
        x = x.join(known_x, F.col("id") == F.col("known"), "left").select("mode", "qid", swap, "w")
        y = y.join(known_y, F.col("id") == F.col("known"), "left").select("mode", "qid", swap, "w").groupBy("mode", "qid", "id").agg(F.sum("w").alias("w"))
    return Dataset(x, normalise_labels(y) if normalise else y)


def load_examples(db: Database | None, path: str, normalise: bool = True, spark: SparkSession | None = None) -> Dataset:
    """``.exam``: ``pred⇥x⇥y1…yk``; ``.examples``: ``p(x,Y)⇥+p(x,y)⇥-p(x,y2)``.

    Without a database any symbol is known, and ``spark`` reads the file.  In
    the second form a line that isn't a query and signed answers to it, of
    its own predicate and input, raises :class:`BadExample`.
    """
    lines = (spark or db.spark).read.text(path).filter(F.trim("value") != "").withColumn("qid", F.monotonically_increasing_id())
    if path.endswith(".examples"):
        goal = r"^\s*(\w+)\((\w+),(\w+)\)"
        rows = lines.select("qid", "value", F.transform(F.split(F.rtrim("value"), "\t"), F.trim).alias("f"))
        first, answer = F.get("f", F.lit(0)), r"^[+-](\w+)\((\w+),(\w+)\)\.?$"
        answers = F.filter(F.slice("f", F.lit(2), F.size("f")), lambda g: g != "")
        own = F.forall(answers, lambda g: g.rlike(answer) & (F.regexp_extract(g, answer, 1) == F.regexp_extract(first, goal, 1)) & (F.regexp_extract(g, answer, 2) == F.regexp_extract(first, goal, 2)))
        bad = rows.filter(~(first.rlike(goal) & own)).head(1)
        if bad:
            raise BadExample(f"not an example: {bad[0].value!r}")
        ys = F.transform(F.filter(answers, lambda g: g.startswith("+")), lambda g: F.regexp_extract(g, answer, 3))
        rows = rows.select("qid", F.concat(F.regexp_extract(first, goal, 1), F.lit("/io")).alias("mode"), F.regexp_extract(first, goal, 2).alias("x"), ys.alias("ys"))
    else:
        f = F.split(F.rtrim("value"), "\t")
        rows = lines.select("qid", F.concat(F.get(f, F.lit(0)), F.lit("/io")).alias("mode"), F.get(f, F.lit(1)).alias("x"), F.slice(f, F.lit(3), F.size(f)).alias("ys"))
    # answers come apart after all else is read from the line, not once for each of them
    return from_pairs(rows.select("qid", "mode", "x", F.explode_outer("ys").alias("y")), db, normalise)


def from_relation(db: Database, mode: str | Mode, functor: str, normalise: bool = True) -> Dataset:
    """One example for each stored fact; an input with k answers comes k
    times, each with all its answers."""
    mode = Mode.parse(mode)
    near, far = ("src", "dst") if mode.pattern == "io" else ("dst", "src")
    rel = db.binary(functor).select(F.col(near).alias("x"), F.col(far).alias("y"), "w")
    facts = rel.select("x", F.concat(F.length("x").cast("string"), F.lit(":"), "x", "y").alias("qid"))  # tells any two facts apart
    x = facts.select(F.lit(str(mode)).alias("mode"), "qid", F.col("x").alias("id"), F.lit(1.0).alias("w"))
    y = facts.join(rel, "x").select(F.lit(str(mode)).alias("mode"), "qid", F.col("y").alias("id"), "w")
    return Dataset(x, normalise_labels(y) if normalise else y)


def example_text(data: Dataset, mode: str | Mode) -> DataFrame:
    """(value): examples as lines ``p(x,Y)⇥+p(x,y)…``."""
    mode = Mode.parse(mode)
    x = data.queries(str(mode)).select("qid", F.col("id").alias("x"))
    y = data.labels(str(mode)).groupBy("qid").agg(F.sort_array(F.collect_list("id")).alias("ys"))
    atoms = F.transform(F.coalesce("ys", F.array().cast("array<string>")), lambda v: F.concat(F.lit(f"+{mode.functor}("), F.col("x"), F.lit(","), v, F.lit(")")))
    return x.join(y, "qid", "left").select(F.concat_ws("\t", F.concat(F.lit(f"{mode.functor}("), F.col("x"), F.lit(",Y)")), atoms).alias("value"))
