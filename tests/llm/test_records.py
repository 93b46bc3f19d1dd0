"""Archives, embeddings, components and the pipeline against plain versions."""

import base64
import hashlib
import heapq
import importlib.util
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from plain import ascii_lower, plain_phrases

from weft.llm import bpe, components, embedding_dedup, language_id, mixing, warc


@pytest.fixture(scope="module")
def page_rows():
    rng = random.Random(4)
    rows = [(i, rng.choice([f"http://www.Example{i % 5}.com/a/{i % 7}?b=2&a=1", f"https://x.org:8080/{i}", None, "not a url"]), rng.choice(["<p>same</p>", f"<p>{i}</p>", "", None, "é" * 300])) for i in range(60)]
    return rows + [(70, "http://a.b/", "<p>twice</p>")] * 3 + [(71, "http://a.b/c", "<p>twice</p>"), (None, None, "<p>no id</p>")]


@pytest.fixture(scope="module")
def pages(spark, page_rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('pages')}/pages"
    spark.createDataFrame(page_rows, "page_id long, url string, html string").selectExpr("*", "'x' AS content", "'y' AS length").repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("smallest", [0, 6])
def test_archives(pages, page_rows, smallest):
    got = warc.archived(pages, smallest=smallest).collect()
    lead = {}
    for i, _, h in page_rows:
        lead.setdefault(h or "", []).append(-1 if i is None else i)
    want, leads = Counter(), Counter()
    for i, _, h in page_rows:
        data = (h or "").encode()
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    for r in got:
        ids = lead[next(h for h in lead if base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() == r.payload_digest)]
        if r.record_type == "response":
            leads[r.payload_digest] += 1
            assert r.refers_to is None and (r.payload_bytes < smallest or r.page_id in (max(ids), None))
        else:
            assert r.payload_bytes >= smallest and r.refers_to == max(ids)
    for h, ids in lead.items():
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert leads[digest] == (1 if len(h.encode()) >= smallest else len(ids))


def test_histories_are_in_global_order(pages, tmp_path):
    root = f"file://{tmp_path}/warc"
    index = warc.write_archives(pages, root, fan_in=2)
    rows = warc.read_archives(index, root, with_payload=True).sort("part", "row").collect()
    keys = [(r.url_key, r.date) for r in rows]
    assert keys == sorted(keys) and len(keys) == pages.count()


def test_no_pages(pages, spark):
    none = spark.createDataFrame([], pages.schema)
    assert warc.archived(none).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.choice("abc"), rng.randint(0, 5), i) for _ in range(rng.randint(0, 9))) for i in range(k)]
        assert [e[:2] for e in warc.LoserTree([iter(r) for r in runs])] == [e[:2] for e in heapq.merge(*runs)]


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/A?b=2&a=1") == "com,example)/a?a=1&b=2"
    assert warc.url_key("https://x.org:8080") == "org,x:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def plain_links(rows, cosine):
    good = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    links = defaultdict(set)
    for a, b in itertools.combinations(good, 2):
        x, y = good[a], good[b]
        if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
            links[a].add(b)
            links[b].add(a)
    return links


@pytest.mark.parametrize("home_rows", [8192, 16])
def test_similar_vectors(spark, tmp_path, monkeypatch, home_rows):
    """Also with many small slabs and shares."""
    monkeypatch.setattr(embedding_dedup, "HOME_ROWS", home_rows)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(6, 24))
    rows = [(i, (base[i % 6] * (1 + i) + rng.normal(size=24) * (0.02 + 0.02 * (i % 9)) * (1 + i)).tolist()) for i in range(150)]
    rows += [(200, rows[3][1]), (200, rows[3][1]), (None, rows[4][1]), (201, None), (202, []), (203, [0.0] * 24), (204, [float("nan")] * 24), (205, [1.0, None] * 12), (206, [float("inf")] * 24), (207, [1.0, 2.0]), (208, [2.0, 4.0]), (209, [1e-30] * 24)]
    path = f"file://{tmp_path}/v"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "'x' AS node").write.parquet(path)
    table = spark.read.parquet(path)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    links = plain_links(rows, 0.95)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, bs in links.items():
        for b in bs:
            root[find(b)] = find(a)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)].append(i)
    want = Counter((i, len(links[k]), min(ids[find(k)], default=None)) for k, (i, _) in enumerate(rows))
    got = embedding_dedup.similar_vectors(table, 0.95).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert embedding_dedup.similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_many_lengths(spark):
    """Each length is a table of its own, however many there are."""
    rows = [(2 * n + k, [1.0 + 0.001 * k] + [0.5] * (n - 1)) for n in range(1, 1004) for k in (0, 1)]
    got = embedding_dedup.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(2 * n + k, 1, 2 * n) for n in range(1, 1004) for k in (0, 1)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 60), 100 + rng.randint(0, 60)) for _ in range(50)] + [(200, 201 + i) for i in range(30)] + [(5, 5), (None, 3)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: find(i) for i in root}


def plain_language(rows):
    """The language stage: what a plain parse says of each text with a letter."""

    def stage(spark, now):
        sample = language_id.fit(now)
        out = []
        for doc_id, text, _, source in rows:
            if text and any(c.isalpha() for c in text):
                cost = [plain_phrases(text, t) * math.log2(len(t)) for t in sample.texts]
                out.append((doc_id, text, sample.languages[cost.index(min(cost))], source))
        return out

    return stage


def plain_exact(rows):
    best = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        best[ascii_lower(r[1])] = r
    return list(best.values())


def plain_near(rows):
    sets = []
    for _, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    out = []
    for i, a in enumerate(sets):  # rows in order of id, null last: a row stays if no earlier one reaches it
        reached, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = [j for j, b in enumerate(sets) if j not in reached and sets[k] and b and 100 * len(sets[k] & b) >= 80 * len(sets[k] | b)]
            reached.update(new)
            todo += new
        if i == min(reached):
            out.append(rows[i])
    return out


@pytest.mark.skipif(importlib.util.find_spec("public_tokenizers") is None, reason="needs the tokenizer files")
def test_pipeline_stages(spark, docs, messy, tmp_path):
    """Each stage against a plain version on what the stage before it kept; then run()."""
    import corpus_pipeline
    import public_tokenizers

    tok = bpe.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    now, rows = docs, messy
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, None).write.parquet(f"file://{tmp_path}/{k}")
        before, now = now, spark.read.parquet(f"file://{tmp_path}/{k}")
        if name == "tokens":
            want = Counter()
            for doc_id, text, *_ in rows:
                ids = tok.encode(text, add_special_tokens=False).ids
                want[(doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
            assert Counter(map(tuple, now.collect())) == want
            continue
        assert now.columns == docs.columns
        got = Counter(map(tuple, now.select("doc_id", "text", "lang", "source").collect()))
        if name == "mixture":
            mix = {r.doc_id: r for r in mixing.mix(before).collect()}
            assert got == Counter({r: mix[r[0]].copies for r in rows if mix[r[0]].copies})
            words, taken = defaultdict(int), defaultdict(int)
            for r in rows:
                words[r[3]] += mix[r[0]].size
                taken[r[3]] += mix[r[0]].taken
            names = sorted(words, key=lambda s: (s is None, s or ""))
            targets = mixing.water_fill([words[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], sum(words.values()), 3)
            for s, t in zip(names, targets):  # half of a source's one very long text at worst
                longest = max(mix[r[0]].size for r in rows if r[3] == s)
                assert abs(taken[s] - t) <= (longest / 2 if longest > 1000 else 1)
            rows = [r for r, n in got.items() for _ in range(n)]
            continue
        rows = plain_language(rows)(spark, before) if name == "language" else plain_exact(rows) if name == "exact" else plain_near(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))
        assert got == Counter(rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mixture", "tokens"]
    docs.write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    assert Counter(map(tuple, corpus_pipeline.run(spark, f"file://{tmp_path}/sf").collect())) == want


@pytest.mark.skipif(importlib.util.find_spec("public_tokenizers") is None, reason="needs the tokenizer files")
def test_pipeline_of_no_documents(spark, empty):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, None).count() == 0


def test_registered_queries():
    from weft.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
