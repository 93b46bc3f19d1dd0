"""A corpus pipeline: language, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import posixpath

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weft.llm.bpe import round_trip
from weft.llm.exact_dedup import deduplicated
from weft.llm.language_id import fit, with_known_language
from weft.llm.mixing import mixed
from weft.llm.near_dedup import without_near_copies
from weft.llm.shared import clear_scratch, scratch, staged_so_far

#: Words of a shingle and percent of similarity of near copies.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: The mixture's weights over the sources by name, and how often a document may come.
WEIGHTS, MAX_REPEATS = (5, 2, 1), 3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents and parse all: those without any language go, the others get the language found."""
    return with_known_language(docs, fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return without_near_copies(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixed(docs, weights=WEIGHTS, max_repeats=MAX_REPEATS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode: a row of digests for each document."""
    return round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokens)]

#: Language, similarity and tokens have no SQL; tests hold each stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = posixpath.join(root, f"{k}-{name}")
        before = staged_so_far(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        clear_scratch(spark, before)
        docs = spark.read.parquet(path)
    return docs
