"""The manifest against a plain tree over each group."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from weft.llm import merkle


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, i):
    """(siblings by level, whether the node stands right of them)."""
    return [(level[j ^ 1] if (j := i >> k) ^ 1 < len(level) else "", j % 2) for k, level in enumerate(tree[:-1])]


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = levels([leaf_of(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    root, out = top[-1][0], []
    for gi, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = way(trees[g], i) + way(top, gi)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            x = leaf_of((*r[:3], r[3] + 1, r[4])) if hit else leaf_of(r)
            for s, right in steps:
                x = h(s + x if right else x + s)
            out.append((r[0], leaf_of(r), trees[g][-1][0], root, h("".join(s for s, _ in steps)), x, x == root))
            assert hit != (x == root)
    return out


@pytest.mark.parametrize("stretch,wider", [(1 << 14, 1 << 10), (3, 2), (7, 4)])
def test_manifest(spark, messy, tmp_path, monkeypatch, stretch, wider):
    """In one stretch, and over many rounds of short ones."""
    monkeypatch.setattr(merkle, "LEAVES_A_STRETCH", stretch)
    monkeypatch.setattr(merkle, "WIDER", wider)
    rng = random.Random(2)
    rows = [(i, s, lang, None if t is None else len(t), t) for i, t, lang, s in messy]
    rows += [(rng.randrange(400), "x", rng.choice(["en", "ß", "Z", "", None]), rng.choice([None, -1, 7]), rng.choice(["a", "é", "", None])) for _ in range(150)]
    rows += [(500, "x", "alone", 1, "y")]
    path = f"file://{tmp_path}/docs"
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    for c in ("name", "leaf", "row", "place", "stretch", "group", "size", "index", "level"):
        df = df.selectExpr("*", f"'x' AS `{c}`")
    df.write.parquet(path)
    got = merkle.manifest(spark.read.parquet(path)).collect()
    assert Counter(map(tuple, got)) == Counter(plain(rows))


def test_one_row_and_none(spark, tmp_path):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([(1, None, None, 2, "a")], schema).write.parquet(path)
    docs = spark.read.parquet(path)
    assert [tuple(r) for r in merkle.manifest(docs).collect()] == plain([(1, None, None, 2, "a")])
    got = merkle.manifest(docs.filter("doc_id > 1"))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and got.count() == 0


def test_parents_wait_for_all_their_children():
    trees, leaves = merkle.Trees(), [h(str(i)) for i in range(11)]
    order = list(range(11))
    random.Random(1).shuffle(order)
    for i in order:
        assert ("g", 4, 0) not in trees.done
        trees.add("g", 11, 0, i, leaves[i])
    assert list(trees.frontier()) == [("g", 4, 0, levels(leaves)[-1][0])]
    for i in range(11):
        beside = trees.siblings("g", 0, i, {("g", 4, 0): ""})
        assert merkle.fold(leaves[i], i, 11, beside) == (levels(leaves)[-1][0], "")
