"""Repeated passages against a plain count of all strings of the width."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from weft.llm import suffix_dedup


def repeated(texts, width):
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    return [[i for i in range(len(t) - width + 1) if count[t[i : i + width]] > 1] for t in texts]


def plain_result(texts, width):
    out = []
    for t, starts in zip(texts, repeated(texts, width)):
        gone = np.zeros(len(t), bool)
        for i in starts:
            gone[i : i + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def random_pieces(rng, width):
    alphabet = rng.choice([b"a", b"ab", b"abc \x00", bytes(range(97, 123))])
    base = bytes(rng.choice(alphabet) for _ in range(60))
    out = set()
    for _ in range(rng.randint(1, 8)):
        p = bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        if rng.random() < 0.7:
            k = rng.randint(0, 30)
            p += base[k : k + rng.randint(1, 50)]
        out.add(p + bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 20))))
    return sorted(p for p in out if len(p) >= width)


def test_two_stages_give_the_suffix_order():
    rng = random.Random(3)
    for _ in range(120):
        width = rng.choice([8, 20, 40])
        pieces = random_pieces(rng, width)
        if not pieces:
            continue
        begin = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])
        symbols = np.zeros(begin[-1] + 72, np.uint8)
        wanted = np.zeros(len(symbols), bool)
        for p, a in zip(pieces, begin.tolist()):
            symbols[a : a + len(p)] = np.frombuffer(p, np.uint8) + 1
            wanted[a : a + len(p)] = True
        plain = [p[i:] for p in pieces for i in range(len(p))]
        got = suffix_dedup.suffix_order(symbols, wanted, 64).tolist()
        own = {a + i: p[i:] for p, a in zip(pieces, begin.tolist()) for i in range(len(p))}
        assert [own[i] for i in got] == sorted(plain)
        eights = suffix_dedup._eights(symbols)
        prefixes = suffix_dedup.common_prefixes(np.array(got), eights, 5).tolist()
        for (a, b), n in zip(zip(got, got[1:]), prefixes):
            assert own[a][:n] == own[b][:n] and (n == 5 or own[a][: n + 1] != own[b][: n + 1] or min(len(own[a]), len(own[b])) <= n)
        for found, want in zip(suffix_dedup.repeated_starts(pieces, [1] * len(pieces), width), repeated(pieces, width)):
            assert [i for a, b in found.reshape(-1, 2).tolist() for i in range(a, b + 1)] == want


@pytest.mark.parametrize("k", [1, 7, 32, 49, 50])
def test_equal_strings_have_equal_anchors(k, monkeypatch):
    rng = np.random.default_rng(k)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    anchor, first, last = suffix_dedup.anchored(text, np.array([0, 1500, 4000]), 50, k)
    assert (last - first + 1).sum() == 1451 + 2451
    of = {}
    for a, lo, hi in zip(anchor.tolist(), first.tolist(), last.tolist()):
        for s in range(lo, hi + 1):
            assert of.setdefault(text[s : s + 50].tobytes(), a) == a
    whole = suffix_dedup._pieces(text, np.array([0, 4000]), 50, k)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    cut = suffix_dedup._pieces(text, np.array([0, 4000]), 50, k)
    assert int(whole[2].sum()) == int(cut[2].sum()) == 3951 and np.array_equal(np.sort(np.concatenate([np.arange(a, a + n) for a, n in zip(cut[1], cut[2])])), np.arange(3951))


def rows_of(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_messy(docs, messy):
    texts = [(t or "").encode() for _, t, *_ in messy]
    want = Counter((i, *r) for (i, *_), r in zip(messy, plain_result(texts, 200)))
    assert rows_of(suffix_dedup.without_repeats(docs)) == want


def test_empty(empty):
    assert suffix_dedup.without_repeats(empty).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert suffix_dedup.without_repeats(empty).count() == 0


@pytest.mark.parametrize("pieces", [512, 3])
def test_hot_passages(spark, tmp_path, monkeypatch, pieces):
    """Passages within unlike surroundings, runs of one character, copies, repeated
    rows; with few pieces an anchor, all rounds of cutting are needed."""
    monkeypatch.setattr(suffix_dedup, "PIECES_AN_ANCHOR", pieces)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 600)
    rng = random.Random(8)
    letters = "abcdefghij é日"
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage, line = draw(330), draw(90)
    texts = [draw(rng.randint(0, 260)) + passage + draw(rng.randint(0, 260)) for _ in range(40)]
    texts += [draw(100) + passage[:195] + draw(100), "-" * 2000, "-" * 150, "ab" * 700 + draw(50), (line + "\n") * 9, "x" + line * 3, "", None]
    texts += [texts[0]] * 3 + [draw(150) + texts[1] + draw(20)]
    table = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 5
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(path)
    want = Counter((i, *r) for (i, _), r in zip(table, plain_result([(t or "").encode() for _, t in table], 200)))
    assert rows_of(suffix_dedup.without_repeats(spark.read.parquet(path))) == want
