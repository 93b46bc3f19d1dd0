"""Operators on documents against plain versions, over a messy table."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from plain import ascii_lower, plain_phrases
from pyspark.sql import functions as F

from weft.llm import bpe, exact_dedup, language_id, license_scan, mixing, near_dedup, sharding, shared, token_store


def groups(messy):
    out = defaultdict(list)
    for doc_id, text, *_ in messy:
        out[ascii_lower(text)].append(doc_id)
    return out


@pytest.mark.parametrize("bits", [None, 2])
def test_exact_dedup(docs, messy, bits):
    """With two bits of fingerprint nearly all texts collide, and results stay the same."""
    got = exact_dedup.exact_dedup(docs, chunk_bytes=64, moduli_bits=bits).collect()
    want = groups(messy)
    assert len(got) == len(messy)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(by_sha.keys())


def test_one_id_in_many_groups(spark):
    """Each row's own text is compared: an id with many repeated texts marks no
    fingerprint as differing, and no text meets another's candidates."""
    rows = [(i % 2, f"Text {i // 4}") for i in range(400)] + [(7, "alone"), (0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    prints = exact_dedup.fingerprints(docs)
    assert exact_dedup.differing(docs, prints).count() == 0
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == 402 and Counter(r.group_size for r in got) == {4: 400, 1: 2} and sum(r.kept for r in got) == 102


def test_fingerprints_combine():
    data = np.random.default_rng(1).integers(0, 256, 10_000, dtype=np.uint8)
    for prime, base in exact_dedup.MODULI:
        whole = exact_dedup.combine(exact_dedup.chunk_hashes(data, 10_000, base, prime), base, prime)
        for chunk in (1, 7, 999):
            assert exact_dedup.combine(exact_dedup.chunk_hashes(data, chunk, base, prime), base, prime) == whole
        value = 0
        for b in data[::-1].tolist():
            value = (value * base + b) % prime
        assert whole == (value, 10_000)


def test_windows_of_a_huge_text(monkeypatch):
    rng = np.random.default_rng(4)
    raw = rng.integers(0, 256, 100_003).astype(np.uint8)
    hasher = exact_dedup._Hasher(1000)
    whole = [int(h[0]) for h in hasher(raw, np.array([0, len(raw)]))]
    for window in (999, 4096, 100_002):
        monkeypatch.setattr(exact_dedup, "WINDOW", window)
        assert [int(h[0]) for h in hasher(raw, np.array([0, len(raw)]))] == whole


def test_hot_keys_stay_in_place(spark):
    many = spark.range(9000).selectExpr("if(id < 4000, 0, if(id < 6500, 1, id)) k", "id v")
    one = many.groupBy("k").count().withColumnRenamed("count", "n").filter("k <> 1 and k <> 7000")
    hot = shared.hot_keys(many.groupBy("k").agg({"v": "count"}).toDF("k", "n"), ["k"])
    assert sorted(r.k for r in hot.collect()) == [0, 1]
    for how in ("inner", "left"):
        want = Counter(map(tuple, many.join(one, ["k"], how).collect()))
        assert Counter(map(tuple, shared.keyed_join(many, one, ["k"], hot, how).collect())) == want


def test_copies_of_a_representative(spark):
    """Neither they nor what one of them serves grow as the group does."""
    for n, want in ((1, 1), (64, 1), (65, 2), (4096, 64), (10_000, 100), (10**10, 10**5)):
        got = spark.range(1).select(shared.salts(F.lit(n))).first()[0]
        assert got == want


def test_deduplicated(docs, messy):
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    assert Counter(ascii_lower(r.text) for r in left.select("text").collect()) == Counter(groups(messy).keys())


def test_language(docs, messy):
    got = {(r.doc_id, r.lang_pred): r for r in language_id.identify(docs).collect()}
    truth = {i: lang for i, t, lang, _ in messy if lang and t and len(t.split()) > 4}
    right = [i for i, _ in got if i in truth and (i, truth[i]) in got]
    assert len(right) >= 0.95 * len([1 for i, _ in got if i in truth])
    for doc_id, text, *_ in messy:
        r = next(r for r in got.values() if r.doc_id == doc_id)
        lettered = bool(text) and any(c.isalpha() for c in text)
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1
        if doc_id is not None:
            assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)


@pytest.mark.parametrize("block", [16, 2048])
def test_texts_that_repeat_themselves(monkeypatch, block):
    """Parses of pieces that never agree: as a plain parse, and in time that grows with the text."""
    import time

    monkeypatch.setattr(language_id, "BLOCK", block)
    sample = language_id.Sample(("a", "b"), ("-----ab ab abc" + "ab" * 20 + "x" * 37, "the cat, " * 5 + "  ---"), "".join(sorted(set("-abc xthe,"))))
    rng = random.Random(block)
    probes = ["-" * 5000, "ab" * 3000 + "c" + "ab" * 100, " " * 2500, "x" * 4100 + "the cat", "".join(rng.choice("abx-") for _ in range(3000)), "xxxxx" * 900 + "ab", "a", ""]
    probes += ["".join(rng.choice(["ab", "x" * rng.randint(1, 90), "--"]) for _ in range(300)) for _ in range(3)]
    got = language_id.phrases(sample, probes)
    known = [{t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)} for t in sample.texts]
    assert got.tolist() == [[plain_phrases(t, k) for k in known] for t in probes]
    if block == 2048:
        took = []
        for n in (200_000, 800_000):
            began = time.perf_counter()
            language_id.phrases(sample, ["x" * n])
            took.append(time.perf_counter() - began)
        assert took[1] < 8 * took[0] + 1


def test_phrases_are_longest_matches():
    texts = ("abracadabra", "the cat sat on the mat")
    sample = language_id.Sample(("a", "b"), texts, "abcdehmnorst ")

    def plain(text, known):
        n, at = 0, 0
        while at < len(text):
            k = 1
            while at + k < len(text) and text[at : at + k + 1] in known and text[at] in known:
                k += 1
            n, at = n + 1, at + k
        return n

    for probe in ("abra", "the mat cat", "xyz", "cadabra the", "aaaa"):
        assert language_id.phrases(sample, [probe])[0].tolist() == [plain(probe, t) for t in texts]
    # the automaton has every substring and nothing else
    moves, _ = language_id.suffix_automaton([ord(c) for c in texts[0]])
    for a, b in itertools.combinations(range(len(texts[0]) + 1), 2):
        state = 0
        for c in texts[0][a:b]:
            state = moves[state][ord(c)]


@pytest.mark.parametrize("block", [1, 3, 17, 64])
def test_pieces_of_a_text_make_no_difference(monkeypatch, block):
    """Phrases span pieces, also several, and pieces of many texts are put right together."""
    rng = random.Random(block)
    samples = ("".join(rng.choice("ab") for _ in range(400)), "abcabcabdab" * 30, "the cat sat on the mat and the rat ate the hat")
    sample = language_id.Sample(("a", "b", "c"), samples, "".join(sorted(set("".join(samples)))))
    probes = [samples[0][50:250], samples[1][3:200] + "zz" + samples[1][:90], "the mat and the rat " * 9, "", "q" * 40, "x", samples[0][:33] + samples[2]]
    probes += ["".join(rng.choice("abc d") for _ in range(rng.randint(0, 150))) for _ in range(30)]
    monkeypatch.setattr(language_id, "BLOCK", block)
    assert language_id.phrases(sample, probes).tolist() == [[plain_phrases(p, t) for t in samples] for p in probes]


def test_identify_equals_a_plain_parse(docs, messy):
    sample = language_id.fit(docs.filter(~language_id.held_out()))
    got = defaultdict(list)
    for r in language_id.identify(docs).collect():
        got[r.doc_id].append(r)
    for doc_id, text, *_ in messy:
        if doc_id is None or text is None or len(text) > 5_000:
            continue
        cost = [plain_phrases(text, t) * math.log2(len(t)) for t in sample.texts]
        lettered = any(c.isalpha() for c in text)
        want = sample.languages[cost.index(min(cost))] if lettered else "und"
        score = 1 - sorted(cost)[0] / sorted(cost)[1] if lettered else 0
        assert all(r.lang_pred == want and r.score == pytest.approx(score) for r in got[doc_id])


def test_samples_come_from_anywhere(spark):
    rows = [(i, "".join(chr(0x4E00 + (97 * i + k) % 5000) for k in range(3000)), "zh") for i in range(60)]
    sample = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    at = [t.index(piece[:50]) for piece in sample.texts[0].split("\n") for _, t, _ in rows if piece[:50] in t and len(piece) >= 50]
    assert len(at) >= 50 and min(at) < 500 and max(at) > 2200


def test_scripts_of_any_size(spark):
    """Every character of the samples counts: large alphabets, and few documents beside many."""
    rng = random.Random(8)
    latin = "abcdefghijklmnopqrstuvwxyzàâäçéèêëîïôöùûüßñ0123456789 ,.!?;:()-ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    spans = {"el": (0x3B1, 25, 3), "ja": (0x3041, 80, 3), "ko": (0xAC00, 1500, 3), "ru": (0x430, 32, 3), "uk": (0x430, 48, 3), "zh": (0x4E00, 2500, 3)}
    letters = {"la": latin} | {k: "".join(chr(a + i) for i in range(n)) for k, (a, n, _) in spans.items()}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(2, 5))) for _ in range(150)] for k, v in letters.items()}

    def text(lang, n):
        return " ".join(rng.choice(words[lang]) for _ in range(n))

    rows = [(i, text("la", 100), "la") for i in range(200)]
    rows += [(1000 * k + i, text(lang, 60), lang) for k, lang in enumerate(spans, 1) for i in range(spans[lang][2])]
    sample = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(sample.symbols) == set("".join(sample.texts)) and len(sample.symbols) > 500
    probes = [(i, text(lang, 30)) for i, lang in enumerate(sample.languages)]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(probes, "doc_id long, text string"), sample).collect()}
    assert [got[i].lang_pred for i, _ in probes] == list(sample.languages) and min(r.score for r in got.values()) > 0.1

    def plain(probe, known):
        n = at = 0
        while at < len(probe):
            k = 1
            while at + k < len(probe) and probe[at : at + k + 1] in known:
                k += 1
            n, at = n + 1, at + k
        return n

    for _, probe in probes:
        assert language_id.phrases(sample, [probe])[0].tolist() == [plain(probe, t) for t in sample.texts]


def test_labels_come_from_the_texts(spark, docs, messy):
    """Each text is parsed whatever its label, and no corpus is lost for want of labels."""
    sample = language_id.fit(docs)
    lettered = [r for r in messy if r[1] and any(c.isalpha() for c in r[1])]
    want = Counter((r.doc_id, r.lang_pred) for r in language_id.predict(docs, sample).collect() if r.lang_pred != "und")
    names = sorted({r[2] for r in lettered if r[2]})
    for label in (None, "xx", *names):
        table = docs.withColumn("lang", F.lit(label).cast("string"))
        got = language_id.with_known_language(table, sample)
        assert got.columns == docs.columns and Counter((r.doc_id, r.lang) for r in got.select("doc_id", "lang").collect()) == want
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    got = language_id.with_known_language(blank, language_id.fit(blank)).select("doc_id", "text", "lang").collect()
    assert Counter(map(tuple, got)) == Counter((i, t, "und") for i, t, *_ in lettered)


def test_licences(spark, docs, messy, tmp_path):
    more = [
        (1, "Released under the MIT License.\nCC BY-NC 4.0; cc-by nc", None, None),
        (2, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause\ncode", None, None),
        (3, "SPDX-License-Identifier: MIT AND", None, None),
        (4, "under the mit license version 2 apache license version 2 0 under the mit license", None, None),
    ]
    table = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    got = license_scan.scan(table).collect()
    assert len(got) == len(messy) + 4
    rows = defaultdict(list)
    for r in got:
        rows[r.doc_id].append(r)
    for doc_id, text, *_ in messy[:114]:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
        assert len(words) in [r.n_words for r in rows[doc_id]]
    last = {k: v[-1] for k, v in rows.items()}
    found = {r.labels for r in rows[2]}
    assert "bsd-3-clause,gpl-2.0-only with classpath-exception-2.0,mit" in found
    assert any(r.n_invalid == 1 and r.n_expressions == 0 for r in rows[3])
    four = max(rows[4], key=lambda r: r.n_base)
    assert (four.n_base, four.first_word, four.last_word, four.base_labels) == (3, 0, 11, "apache-2,mit")
    assert last[110].labels == "" and last[110].first_word is None


def test_base_places_equal_a_plain_scan(spark):
    """Texts full of whole, broken, overlapping and repeated phrases."""
    rng = random.Random(12)
    bits = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "MIT", "é", "licensé", "x1"] + list(license_scan.BASE_PHRASES)
    marks = [" ", "\n", ", ", "-", ".", "\t(", "\x7f", "  "]
    texts = ["".join(rng.choice(bits) + rng.choice(marks) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    texts += ["under the mit license " * 5_000, "cc by nc", "", None, "cc by ncx cc by nc"]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
        places, labels = [], set()
        for phrase, label in license_scan.BASE_PHRASES.items():
            p = phrase.split(" ")
            here = [k for k in range(len(words) - len(p) + 1) if words[k] == p[0] and words[k : k + len(p)] == p]
            places += here
            labels |= {label} if here else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(","))


@pytest.mark.parametrize("text,ids,permissive", [("MIT", {"mit"}, True), ("GPL-3.0-only OR MIT", {"gpl-3.0-only", "mit"}, True), ("GPL-3.0-only AND MIT", {"gpl-3.0-only", "mit"}, False), ("A OR B AND C", {"a", "b", "c"}, False), ("(MIT OR X) AND Apache-2.0", {"mit", "x", "apache-2.0"}, True)])
def test_expressions(text, ids, permissive):
    assert license_scan.evaluate(license_scan.to_postfix(text)) == (ids, permissive)


@pytest.mark.parametrize("text", ["", "AND MIT", "MIT OR", "(MIT", "MIT)", "()"])
def test_bad_expressions(text):
    with pytest.raises(ValueError):
        license_scan.to_postfix(text)


def test_expression_ends_where_prose_begins():
    assert license_scan.to_postfix("MIT and then some */") == ["mit", "then", "and"]
    assert license_scan.to_postfix("MIT */") == ["mit"]


def test_mixing(docs, messy):
    got = mixing.mix(docs).collect()
    assert len(got) == len(messy)
    size = {None: 0}
    by_source = defaultdict(int)
    for doc_id, text, _, source in messy:
        by_source[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    sizes = [by_source[s] for s in names]
    targets = mixing.water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], sum(sizes), 3)
    assert sum(targets) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-6 for t, s in zip(targets, sizes))
    source_of = {i: s for i, _, _, s in messy}
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r["size"] and r.taken == r["size"] * r.copies
        s = source_of[r.doc_id]
        assert r.source_size == by_source[s] and r.target == pytest.approx(targets[names.index(s)])
        taken[s] += r.taken
    assert size[None] == 0
    for s, t in zip(names, targets):  # s3 has one text that is most of it, and longer than the target
        assert abs(taken[s] - t) <= (1 if s != "s3" else 15_000)
    again = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)


def test_mixed_repeats_rows(docs):
    counts = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    rows = Counter(r.doc_id for r in mixing.mixed(docs).select("doc_id").collect())
    assert all(rows[i] == counts[i] for i in counts if i not in (None, 116)) and mixing.mixed(docs).columns == docs.columns


def test_knapsack_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lengths = rng.choice(np.arange(1, 40), 5, replace=False)
        counts = rng.integers(0, 4, 5)
        budget = int(rng.integers(0, 120))
        best = max(s for s in (int((np.array(c) * lengths).sum()) for c in itertools.product(*(range(n + 1) for n in counts))) if s <= budget)
        take = mixing.bounded_knapsack(lengths, counts, budget)
        assert (take <= counts).all() and int((take * lengths).sum()) == best


def test_sources_come_as_near_as_documents_allow():
    rng = np.random.default_rng(7)
    for _ in range(200):
        lengths = np.sort(rng.choice(np.arange(1, 60), 4, replace=False))
        counts = rng.integers(1, 4, 4)
        words = int((lengths * counts).sum())
        target = float(rng.uniform(0, 3 * words))
        whole, extra = mixing.fit_source(lengths, counts, words, target, 3)
        copies = whole * counts + extra
        assert (copies >= 0).all() and (copies <= 3 * counts).all()
        assert abs(int((copies * lengths).sum()) - target) <= lengths.max() / 2 + 1


def test_sharding(docs, messy):
    got = sharding.shard(docs, shards=6).collect()
    assert len(got) == len(messy)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in messy)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(6))
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_overfull_ranges_are_cut_whatever_the_sample(spark, monkeypatch):
    monkeypatch.setattr(sharding, "sample_keys", lambda *_: np.zeros(0, np.int64))
    keys = [3**k for k in range(39)] + [-(3**k) for k in range(39)] + list(range(200)) + [7] * 100
    records = spark.createDataFrame([(i, 100, 0, k) for i, k in enumerate(keys)], "doc_id long, size long, text_crc32 long, key long").coalesce(1).cache()
    bounds, found = sharding.splitters(records, 1)
    most = sharding.OVERFULL * 100 * len(keys) / sharding.RANGES_A_SHARD
    inside = defaultdict(list)
    for k in keys:
        inside[int(np.searchsorted(bounds, k, "right"))].append(k)
    assert {r: 100 * len(ks) for r, ks in inside.items()} == found.bytes.to_dict()
    assert all(100 * len(ks) <= most or len(set(ks)) == 1 for ks in inside.values())


def test_sharding_splits_what_fills_a_shard(spark, tmp_path):
    rows = [(i, "copy " * 40 if i % 3 else f"text {i} " * 20) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/d")
    got = sharding.shard(spark.read.parquet(f"file://{tmp_path}/d"), shards=8).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8


def shingles(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", ascii_lower(text)) if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_one_near_copy_stays_whatever_the_ids(spark, tmp_path):
    rng = random.Random(9)

    def copies(n):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        return [" ".join([*base[:-1], f"end{k}"]) for k in range(n)]

    nulls, some, same, apart = copies(4), copies(3), copies(2), copies(1)
    rows = [(None, t, "nulls") for t in nulls]  # a component without ids
    rows += [(1, some[0], "some"), (None, some[1], "some"), (2, some[2], "some")]  # a null id goes beside others
    rows += [(2, same[0], "same"), (2, same[1], "same"), (2, same[1], "same")]  # one id, two texts, a repeated row
    rows += [(1, apart[0], "apart"), (1, apart[0], "apart"), (None, "", "empty"), (None, None, "empty"), (5, " ", "empty"), (5, " ", "empty")]
    path = f"file://{tmp_path}/rows"
    spark.createDataFrame(rows, "doc_id long, text string, name string").repartition(3).write.parquet(path)
    table = spark.read.parquet(path)
    left = near_dedup.without_near_copies(table)
    assert left.columns == table.columns
    got = [tuple(r) for r in left.collect()]
    assert Counter(n for *_, n in got) == {"nulls": 1, "some": 1, "same": 1, "apart": 1, "empty": 4}
    assert set(got) <= set(rows) and (1, some[0], "some") in got and {i for i, _, n in got if n == "same"} == {2}


@pytest.mark.parametrize("words,percent,small", [(3, 85, 24), (5, 80, 24), (3, 85, 1)])
def test_near_dedup(docs, messy, monkeypatch, words, percent, small):
    """Also with every bucket taken as a large one of many blocks."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_dedup, "NODES_A_BLOCK", 512 if small > 1 else 3)
    got = near_dedup.near_dedup(docs, words=words, percent=percent).collect()
    sets = [shingles(t, words) for _, t, *_ in messy]
    root = list(range(len(messy)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(messy)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = defaultdict(list)
    for i, row in enumerate(messy):
        if row[0] is not None:
            least[find(i)].append(row[0])
    want = Counter((row[0], len(sets[i]), min(least[find(i)], default=None)) for i, row in enumerate(messy))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_estimates_follow_similarity():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.85, 1.0):
        a = rng.integers(0, 1 << 62, 4000, dtype=np.uint64)
        b = a.copy()
        k = int(len(a) * (1 - share) / (1 + share))
        b[:k] = rng.integers(0, 1 << 62, k, dtype=np.uint64)
        values = near_dedup.minima(np.concatenate([a, b]), np.array([4000, 8000]))
        agree = (values[0] % 16 == values[1] % 16).mean()
        assert abs((agree - 1 / 16) / (1 - 1 / 16) - (4000 - k) / (4000 + k)) < 0.17


def in_process(texts, path):
    """(ids of each text) through the steps of the distinct-word table, without Spark; and the encoded words."""
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    pages = list(bpe._split(path)(iter([rows])))
    met = pa.Table.from_batches(pages).select(["block", "first_new", "n_new", "new"]).filter(pc.greater(pc.field("n_new"), 0)).to_batches()
    words = pa.Table.from_batches(list(bpe._new_words(met))).sort_by("word")
    packs = pa.Table.from_batches(list(bpe._encode_sorted(path)(iter(words.to_batches(max_chunksize=7)))))
    out = {}
    for p in pages:
        known = bpe._Words(bpe.special_tokens(path)[1], packs.filter(pc.equal(packs["block"], p.column(0)[0])))
        ids, ends = known.page(bpe._unpressed(p.column(4)[0].as_py()), bpe._unpressed(p.column(3)[0].as_py()))
        for doc, a, b in zip(p.column(2)[0].as_py(), [0, *ends[:-1]], ends):
            out[doc] = ids[a:b].tolist()
    return [out[i] for i in range(len(texts))], words


@pytest.mark.parametrize("case", ["plain", "small blocks", "equal hashes", "equal high bits"])
def test_words_of_any_block(messy, word_bpe, monkeypatch, case):
    """Blocks that close early, and different words with one hash."""
    whole = bpe.word_hashes
    if case == "small blocks":
        for name, value in (("SLICE", 300), ("WORDS_A_BLOCK", 40), ("BYTES_A_BLOCK", 2000), ("WORDS_A_PACK", 11)):
            monkeypatch.setattr(bpe, name, value)
    if case == "equal hashes":
        monkeypatch.setattr(bpe, "word_hashes", lambda *a: ((h := whole(*a))[0] % np.uint64(5), h[1]))
    if case == "equal high bits":
        monkeypatch.setattr(bpe, "word_hashes", lambda *a: ((h := whole(*a))[0] & np.uint64(0xF000_0000_0000_000F), h[1]))
    texts = [t for _, t, *_ in messy if not t or len(t) < 5000]
    texts += ["<|endoftext|>", "a<|startoftext|>b<|ENDOFTEXT|> <|endoftext|><|endoftext|>é", "<|endof", "text|>", "<|startoftext|", "|><|endoftext|>\u0301x", "İ<|endoftext|>'s don't"]
    tok = bpe.tokenizer(word_bpe)
    got, words = in_process(texts, word_bpe)
    assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    if case == "plain":
        assert len(words) == len(set(words["word"].to_pylist()))


def test_only_tokenizers_that_can_be_cut(word_bpe):
    bpe.check_cuts(word_bpe)
    with pytest.raises(ValueError):
        bpe.check_cuts(word_bpe.replace("word_bpe_49k", "byte_bpe_50k"))


def test_bpe_equals_the_library(docs, messy, word_bpe):
    tok = bpe.tokenizer(word_bpe)
    want = Counter()
    for doc_id, text, *_ in messy:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want[(doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(docs, word_bpe).collect()) == want
    encoded = bpe.encode(docs, word_bpe)
    texts = Counter((r.doc_id, r.text) for r in bpe.decode(encoded, word_bpe).collect())
    assert texts == Counter((i, tok.decode(tok.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t, *_ in messy)


def test_token_store(docs, messy, word_bpe, tmp_path):
    tok = bpe.tokenizer(word_bpe)
    root = f"file://{tmp_path}/store"
    got = token_store.stored(docs, word_bpe, root=root).collect()
    rows = sorted(((i, tok.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, *_ in messy), key=lambda r: (r[0] is not None, r[0] or 0))
    starts, at = [], 0
    for i, ids in rows:
        starts.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert Counter(tuple(r) for r in got) == Counter(starts)
    pack = next((tmp_path / "store" / "packs").glob("*.pack"))
    data = bytearray(pack.read_bytes())
    data[len(data) // 2] ^= 1
    pack.write_bytes(data)
    with pytest.raises(Exception):
        token_store.read_store(docs.sparkSession, root).collect()


def test_cuts_follow_content():
    rng = np.random.default_rng(8)
    shared = rng.integers(0, 49_000, 20_000).astype(np.uint32)
    a, b = np.concatenate([rng.integers(0, 49_000, 777).astype(np.uint32), shared]), shared
    chunks = []
    for ids in (a, b):
        cuts, _ = token_store.cut_points(ids, np.array([len(ids)]))
        chunks.append({ids[s:e].tobytes() for s, e in zip([0, *cuts[:-1]], cuts)})
        assert cuts[-1] == len(ids)
    assert len(chunks[0] & chunks[1]) > 0.8 * len(chunks[1])


def test_empty_tables(empty, word_bpe):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert language_id.identify(empty).count() == 0
    assert license_scan.scan(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert sharding.shard(empty).count() == 0
    assert near_dedup.near_dedup(empty).count() == 0
    assert bpe.round_trip(empty, word_bpe).count() == 0
    assert token_store.stored(empty, word_bpe).count() == 0
