"""Stages keep the caller's columns, whatever these are called."""

import re
from collections import Counter
from pathlib import Path

import pytest

from weft.llm import exact_dedup, language_id, mixing, near_dedup, sharding

#: Every name that the code of the stages gives a column.
NAMES = sorted({n for f in (exact_dedup, near_dedup, mixing, language_id, sharding) for n in re.findall(r'alias\("(\w+)"\)|withColumn\("(\w+)"', Path(f.__file__).read_text()) for n in n if n} | {"_key", "_copy", "_sha", "_id", "_copies", "_rep_key", "_keep_id", "_keep_sha", "_worded", "shard", "slot"})
NAMES = [n for n in NAMES if n.lower() not in ("doc_id", "text", "lang", "source")]


@pytest.fixture(scope="module")
def clashing(spark, messy, tmp_path_factory):
    """A row number in a column of each name, so that a lost or changed one shows."""
    path = f"file://{tmp_path_factory.mktemp('clash')}/documents"
    rows = messy[:40] + messy[88:]
    spark.createDataFrame([(*r, *[i] * len(NAMES)) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in NAMES)).write.parquet(path)
    return spark.read.parquet(path), rows


def whole(got, rows, columns, fixed=("doc_id", "text", "source")):
    """How often each of the given rows came out, all of its columns as they were."""
    assert got.columns == columns
    out = Counter()
    for r in got.collect():
        (i,) = {r[n] for n in NAMES}
        assert all(r[c] == rows[i][("doc_id", "text", "lang", "source").index(c)] for c in fixed)
        out[i] += 1
    return out


@pytest.mark.parametrize("distinct", [False, True])
def test_stages(clashing, distinct):
    docs, rows = clashing
    if distinct:  # another way where ids don't repeat
        docs = docs.filter("doc_id is not null and doc_id <> 116")
    there = [i for i, r in enumerate(rows) if not distinct or r[0] not in (None, 116)]
    got = whole(exact_dedup.deduplicated(docs), rows, docs.columns)
    assert set(got) <= set(there) and set(got.values()) == {1} and len(got) == len({(rows[i][1] or "").lower() for i in there})
    got = whole(near_dedup.without_near_copies(docs), rows, docs.columns)
    assert set(got) <= set(there) and set(got.values()) == {1} and len(got) < len(there)
    got = whole(mixing.mixed(docs), rows, docs.columns)
    assert set(got) <= set(there) and max(got.values()) <= 3
    if not distinct:
        sample = language_id.fit(docs)
        got = whole(language_id.with_known_language(docs, sample), rows, docs.columns)
        assert set(got.values()) == {1}


def test_shards_keep_all_rows(clashing, tmp_path):
    docs, rows = clashing
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(docs, path, shards=4)
    got = docs.sparkSession.read.parquet(path)
    assert {"shard_", "slot_"} <= set(got.columns)
    assert whole(got.select(*docs.columns), rows, docs.columns, ("doc_id", "text", "lang", "source")) == Counter(range(len(rows)))
    assert all(sorted(r.slot_ for r in got.filter(f"shard_ = {s}").collect()) == list(range(got.filter(f"shard_ = {s}").count())) for s in range(4))
