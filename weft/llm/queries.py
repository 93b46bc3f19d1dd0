"""Driver queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.warc import archived

    return archived(_table(spark, sf_dir, "pages"), smallest=0)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"), shards=40)


def _word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.token_store import stored

    return stored(_table(spark, sf_dir, "documents"), _word_bpe(), end_id=1)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.near_dedup import near_dedup

    return near_dedup(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), _word_bpe())


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.embedding_dedup import similar_vectors

    return similar_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.suffix_dedup import without_repeats

    return without_repeats(_table(spark, sf_dir, "documents"), width=200)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.merkle import manifest

    return manifest(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.ranked_search import ranked

    return ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


# What SQL can say of the operators whose whole result it can't express.


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's columns on the base phrases."""
    return op3_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's sizes and targets, whether no document exceeds its repeats, and whether its source comes near the target."""
    source = Window.partitionBy("source_size", "target")
    near = F.abs(F.sum("taken").over(source) - F.col("target")) <= 0.01 * F.col("target")
    return op4_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("taken") <= 3 * F.col("size")).alias("within"), near.alias("near"))


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 by shard: whether slots have no gaps, and whether no shard is larger
    than the mean by more than a hundredth and the largest record."""
    rows = op6_sharding(spark, sf_dir)
    by = rows.groupBy("shard").agg(F.count("slot").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    total = by.agg((F.sum("bytes") / 40).alias("mean"), F.max("largest").alias("most"))
    gapless = (F.col("n") == F.col("d")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)
    return by.crossJoin(F.broadcast(total)).select("shard", gapless.alias("gapless"), (F.col("bytes") <= 1.01 * F.col("mean") + F.col("most")).alias("near_equal"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "license_base_places": license_base_places,
    "mixing_targets": mixing_targets,
    "sharding_law": sharding_law,
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_mixing": op4_mixing,
    "op5_warc": op5_warc,
    "op6_sharding": op6_sharding,
    "op7_token_store": op7_token_store,
    "op8_near_dedup": op8_near_dedup,
    "op9_bpe": op9_bpe,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    "license_base_places": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM documents),
        p(phrase, label) AS (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')),
        h AS (
            SELECT doc_id, label, unnest(list_filter(range(0, greatest(0, len(ws) - len(phrase) + 1)), lambda i: ws[i + 1] = phrase[1] AND ws[i + 1:i + len(phrase)] = phrase)) AS place
            FROM w, p)
        SELECT w.doc_id, len(ws) AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
        FROM w LEFT JOIN h ON h.doc_id = w.doc_id GROUP BY w.doc_id, ws""",
    "mixing_targets": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS words, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
        l AS (  -- the level that fills those not yet full, from the first to be full on
            SELECT *, 3.0 * words / weight AS full_at,
                   (sum(words) OVER () - coalesce(sum(3 * words) OVER (ORDER BY 3.0 * words / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (ORDER BY 3.0 * words / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM s),
        v AS (SELECT arg_min(level, full_at) FILTER (WHERE level < full_at) AS level FROM l)
        SELECT doc_id, size, words AS source_size, round(least(3.0 * words, weight * v.level), 4) AS target, true AS within, true AS near
        FROM d JOIN l ON l.source IS NOT DISTINCT FROM d.source, v""",
    "sharding_law": "SELECT range::INT AS shard, true AS gapless, true AS near_equal FROM range(40)",
    "op1_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op5_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
        q AS (
            SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS lead, page_id = max(page_id) OVER (PARTITION BY h) AS leads,
                   list_transform(range(0, 8), lambda i: ('0x' || substr(x, 5 * i::INT + 1, 5))::BIGINT) AS g
            FROM p)
        SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
               array_to_string(list_transform(g, lambda v: list_aggregate(list_transform([15, 10, 5, 0],
                   lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1)), 'string_agg', '')), '') AS payload_digest,
               CASE WHEN leads THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN leads THEN NULL ELSE lead END AS refers_to
        FROM q""",
    "op8_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
            JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
        SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept
        FROM c LEFT JOIN n ON n.doc_id = c.doc_id""",
    "op10_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
              AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
        l AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        r AS (
            SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept
        FROM c""",
    "op12_merkle_manifest": """
        WITH RECURSIVE f AS (
            SELECT doc_id, lang, crc32x % 7 = 0 AS hit, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, n_chars,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
                   coalesce(strlen(text) || ':' || text, '-') AS z
            FROM (SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
                    lambda x, y: list_reduce(list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda u, v: CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384::UBIGINT) ELSE u // 2 END)), 4294967295::UBIGINT) AS crc32x
                  FROM documents)),
        d AS (
            SELECT doc_id, lang, i, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
                   CASE WHEN hit THEN sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || z) END AS changed
            FROM f),
        t(lang, lvl, l) AS (
            SELECT lang, 0, list(leaf ORDER BY i) FROM d GROUP BY lang
            UNION ALL
            SELECT lang, lvl + 1, list_transform(range(0, (len(l) + 1) // 2), lambda k: sha256(l[2 * k + 1] || coalesce(l[2 * k + 2], ''))) FROM t WHERE len(l) > 1),
        g AS (SELECT lang, l[1] AS subroot, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS gi FROM t WHERE len(l) = 1),
        u(lvl, l) AS (
            SELECT 0, list(subroot ORDER BY gi) FROM g
            UNION ALL
            SELECT lvl + 1, list_transform(range(0, (len(l) + 1) // 2), lambda k: sha256(l[2 * k + 1] || coalesce(l[2 * k + 2], ''))) FROM u WHERE len(l) > 1),
        s AS (  -- the sibling of each step up, if any, and whether the node is on the right
            SELECT d.doc_id, t.lvl AS step, t.l[xor(d.i >> t.lvl, 1) + 1] AS sib, (d.i >> t.lvl) % 2 = 1 AS at_right
            FROM d JOIN t ON t.lang IS NOT DISTINCT FROM d.lang WHERE len(t.l) > 1
            UNION ALL
            SELECT d.doc_id, g.height + u.lvl, u.l[xor(g.gi >> u.lvl, 1) + 1], (g.gi >> u.lvl) % 2 = 1
            FROM d JOIN g ON g.lang IS NOT DISTINCT FROM d.lang, u WHERE len(u.l) > 1),
        p AS (SELECT doc_id, sha256(coalesce(string_agg(sib, '' ORDER BY step), '')) AS proof_sha256 FROM s GROUP BY doc_id),
        w(doc_id, step, h) AS (
            SELECT doc_id, 0, coalesce(changed, leaf) FROM d
            UNION ALL
            SELECT w.doc_id, w.step + 1, sha256(CASE WHEN at_right THEN sib || h ELSE h || coalesce(sib, '') END) FROM w JOIN s ON s.doc_id = w.doc_id AND s.step = w.step),
        e AS (SELECT doc_id, arg_max(h, step) AS folded_root FROM w GROUP BY doc_id),
        r AS (SELECT l[1] AS root FROM u WHERE len(l) = 1)
        SELECT d.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM d JOIN g ON g.lang IS NOT DISTINCT FROM d.lang JOIN e ON e.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id, r""",
    "op13_ranked_search": r"""
        WITH d AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents WHERE text IS NOT NULL),
        p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
        l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
        c AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM l),
        w AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, nn),
        q AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark WHERE text IS NOT NULL),
        s AS (
            SELECT item_id, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
            FROM q JOIN p ON p.term = q.term JOIN w ON w.term = p.term JOIN l ON l.doc_id = p.doc_id, c
            GROUP BY item_id, p.doc_id HAVING score > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
}
