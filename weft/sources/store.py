"""Databases, programs and datasets on disk: Parquet for relations, text for the rest."""

from __future__ import annotations

import json
import posixpath

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from weft.catalog import BINARY, UNARY, VECTORS, Database
from weft.plans.parse import parse_rules
from weft.plans.terms import RuleSet
from weft.scratch import paths_of
from weft.sources.facts import load_files


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    rows = [(i, x) for i, x in enumerate(text.split("\n"))]
    spark.createDataFrame(rows, "line int, value string").coalesce(1).write.mode("overwrite").parquet(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.parquet(path).sort("line").collect())


def save_database(db: Database, path: str, which: str = "all") -> None:
    """``which``: all relations, ``parameters`` only, or ``fixed`` ones only."""
    kept = {k: r for k, r in db.relations.items() if which == "all" or (k in db.parameters) == (which == "parameters")}
    for (functor, arity), rel in kept.items():
        rel.write.mode("overwrite").parquet(posixpath.join(path, "relations", f"{functor.encode().hex()}-{arity}"))
    meta = {"relations": sorted(map(list, kept)), "types": [[f, list(t)] for (f, _), t in sorted(db.types.items())], "parameters": sorted(map(list, db.parameters)), "typed": db.typed}
    _write_text(db.spark, posixpath.join(path, "schema"), json.dumps(meta))


def _schema(spark: SparkSession, path: str) -> dict:
    return json.loads(_read_text(spark, posixpath.join(path, "schema")))


def stored_relations(spark: SparkSession, path: str, only: Iterable[tuple[str, int]] | None = None) -> dict[tuple[str, int], DataFrame]:
    """Relations of a saved database by (name, arity), without making a
    database of them: all, or ``only`` those named, which must be there."""
    there = {(f, n) for f, n in _schema(spark, path)["relations"]}
    wanted = there if only is None else set(only)
    if wanted - there:
        raise KeyError(f"{path} has no {sorted(wanted - there)}")
    return {(f, n): spark.read.schema((VECTORS, UNARY, BINARY)[n]).parquet(posixpath.join(path, "relations", f"{f.encode().hex()}-{n}")) for f, n in sorted(wanted)}


def load_database(spark: SparkSession, path: str, into: Database | None = None, only: Iterable[tuple[str, int]] | None = None) -> Database:
    """A saved database, or ``only`` some of its relations; merged into
    ``into`` where one is given, whose relations of the same name are replaced."""
    db, meta = into or Database(spark), _schema(spark, path)
    found = stored_relations(spark, path, only)
    db.relations |= found
    db.types |= {(f, len(t)): tuple(t) for f, t in meta["types"] if only is None or (f, len(t)) in found}
    db.parameters |= {(f, n) for f, n in meta["parameters"] if only is None or (f, n) in found}
    db.typed = db.typed or meta["typed"]
    return db


def cached_database(spark: SparkSession, cache: str, sources: str) -> Database:
    """The cache, made again when it is missing or a source is newer."""
    if not fresh(spark, cache, sources):
        save_database(load_files(spark, sources), cache)
    return load_database(spark, cache)


def _written_at(spark: SparkSession, path: str) -> int | None:
    """When a file, or the newest file below a folder, was written, in
    milliseconds; None if there is nothing.  On any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return None
    below, newest = files.listFiles(where, True), files.getFileStatus(where).getModificationTime()
    while below.hasNext():
        newest = max(newest, below.next().getModificationTime())
    return newest


def fresh(spark: SparkSession, cache: str, sources: str) -> bool:
    """Whether a cache is there and no source was written after it."""
    made = _written_at(spark, cache)
    times = [_written_at(spark, s) for s in paths_of(sources)]
    if None in times:
        raise FileNotFoundError(sources)
    return made is not None and made >= max(times)


def cached_relation_dataset(db: Database, cache: str, mode: str, functor: str, sources: str | None = None):
    """The examples of a stored relation from a cache, made when it is missing
    or older than ``sources``, the files that the relation came from."""
    from weft.sources.examples import from_relation

    if (_written_at(db.spark, cache) is None) if sources is None else not fresh(db.spark, cache, sources):
        save_dataset(from_relation(db, mode, functor), cache)
    return load_dataset(db.spark, cache)


def save_program(rules: RuleSet, db: Database, path: str) -> None:
    save_database(db, posixpath.join(path, "db"))
    _write_text(db.spark, posixpath.join(path, "rules"), rules.to_text("classic"))


def load_program(spark: SparkSession, path: str) -> tuple[RuleSet, Database]:
    return parse_rules(_read_text(spark, posixpath.join(path, "rules"))), load_database(spark, posixpath.join(path, "db"))


def save_dataset(data, path: str) -> None:
    data.x.write.mode("overwrite").parquet(posixpath.join(path, "x"))
    data.y.write.mode("overwrite").parquet(posixpath.join(path, "y"))


def load_dataset(spark: SparkSession, path: str):
    from weft.sources.examples import Dataset

    return Dataset(spark.read.parquet(posixpath.join(path, "x")), spark.read.parquet(posixpath.join(path, "y")))


def open_database(spark: SparkSession, spec: str) -> Database:
    """``dir.db``, ``a.cfacts:b.cfacts``, or ``cache.db|sources``."""
    if "|" in spec:
        return cached_database(spark, *spec.split("|", 1))
    return load_database(spark, spec) if spec.endswith(".db") else load_files(spark, spec)


def open_dataset(spark: SparkSession, spec: str, db: Database):
    """``dir.dset``, ``file.exam``, ``file.examples``, or ``cache.dset|source``."""
    from weft.sources.examples import load_examples

    if "|" in spec:
        cache, source = spec.split("|", 1)
        if not fresh(spark, cache, source):
            save_dataset(load_examples(db, source), cache)
        return load_dataset(spark, cache)
    return load_dataset(spark, spec) if spec.endswith(".dset") else load_examples(db, spec)

