"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is a pair of polynomials over its bytes, ``sum b[i] *
BASE**i`` modulo a prime.  Hashes of neighbouring chunks combine by a length
shift, ``h(xy) = h(x) + BASE**len(x) * h(y)``, so chunks are hashed
independently and a huge text needs no pass in one piece.

Texts with equal fingerprint and length are then compared chunk by chunk with
one representative.  A fingerprint whose texts turn out to differ is regrouped
by SHA-256, so a collision never merges different texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.shared import arrow_map, hot_keys, keyed_join, lowered, own_names, salts, slices, staged, text_bytes

#: Primes below 2**31, so that products of two residues fit 64 bits, and a base for each.
MODULI = ((2147483647, 1103515245), (2147483629, 905432189))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of one text that are hashed at once.
WINDOW = 4 << 20


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo prime, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, prime))
        out[done : 2 * done] = out[: min(done, n - done)] * step % np.uint64(prime)
        done *= 2
    return out[:n]


def chunk_hashes(data: np.ndarray, chunk: int, base: int, prime: int) -> list[tuple[int, int]]:
    """(hash, length) of each chunk of a byte array; chunks are independent."""
    powers = _powers(base, prime, min(chunk, len(data)))
    return [(int((data[i : i + chunk].astype(np.uint64) * powers[: len(data[i : i + chunk])] % np.uint64(prime)).sum() % np.uint64(prime)), len(data[i : i + chunk])) for i in range(0, len(data), chunk)]


def combine(parts: list[tuple[int, int]], base: int, prime: int) -> tuple[int, int]:
    """(hash, length) of consecutive parts put together."""
    value, length = 0, 0
    for h, n in parts:
        value = (value + pow(base, length, prime) * h) % prime
        length += n
    return value, length


class _Hasher:
    """Fingerprints of all texts of a slice at once."""

    def __init__(self, chunk: int):
        self.chunk = chunk
        self.powers: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(MODULI)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        if len(offsets) == 2 and len(raw) > WINDOW:  # one huge text: windows of it, combined
            windows = [(self(raw[a : a + WINDOW], np.array([0, len(raw[a : a + WINDOW])])), len(raw[a : a + WINDOW])) for a in range(0, len(raw), WINDOW)]
            return [np.array([combine([(int(h[k][0]), n) for h, n in windows], base, prime)[0]]) for k, (prime, base) in enumerate(MODULI)]
        lengths = np.diff(offsets)
        pieces = np.maximum(1, -(-lengths // self.chunk))
        doc = np.repeat(np.arange(len(lengths)), pieces)
        first = np.cumsum(pieces) - pieces
        shift = (np.arange(len(doc)) - first[doc]) * self.chunk  # of the chunk in its text
        start, stop = offsets[doc] + shift, np.minimum(offsets[doc] + shift + self.chunk, offsets[doc + 1])
        out = []
        for k, (prime, base) in enumerate(MODULI):
            p = np.uint64(prime)
            if len(self.powers[k]) < self.chunk:
                self.powers[k] = _powers(base, prime, self.chunk)
            place = np.arange(len(raw), dtype=np.int64) - np.repeat(start, stop - start) if len(raw) else np.zeros(0, np.int64)
            terms = raw.astype(np.uint64) * self.powers[k][place]
            total = np.concatenate([[np.uint64(0)], np.cumsum(terms)])
            own = (total[stop] - total[start]) % p  # wraps alike on both sides
            by = np.array([pow(base, int(s), prime) for s in shift], np.uint64) if len(doc) > len(lengths) else np.ones(len(doc), np.uint64)
            out.append((np.add.reduceat(own * by % p, first) % p).astype(np.int64))
        return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 65536, moduli_bits: int | None = None) -> DataFrame:
    """(doc_id, text_key, fp1, fp2, n_bytes, text_sha256) of each row; null text as empty.

    ``text_key`` is a hash of the text as it stands, by which a row's text is
    found again where ids repeat.

    ``moduli_bits`` keeps only that many low bits of each fingerprint; tests
    use it to force collisions.
    """

    def run(batches):
        hasher = _Hasher(chunk_bytes)
        for part in slices(batches, "text"):
            raw, offsets = text_bytes(part.column(2))
            raw = lowered(raw)
            prints = hasher(raw, offsets)
            if moduli_bits is not None:
                prints = [f & ((1 << moduli_bits) - 1) for f in prints]
            view = memoryview(raw)
            sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(prints[0]), pa.array(prints[1]), pa.array(np.diff(offsets)), pa.array(sha, pa.string())], ["doc_id", "text_key", "fp1", "fp2", "n_bytes", "text_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).transform(arrow_map, run, f"doc_id {kind}, text_key long, fp1 long, fp2 long, n_bytes long, text_sha256 string")


def differing(docs: DataFrame, prints: DataFrame, hot: DataFrame | None = None, chunk_bytes: int = 65536) -> DataFrame:
    """The fingerprints (fp1, fp2, n_bytes) that texts with different content share.

    Candidates and one representative for each salt of a fingerprint meet
    chunk by chunk; a group has as many salts as :func:`salts` says, so no task
    gathers it or repeats its representative for all of it.  A candidate without an id can't be looked up: its fingerprint is
    reported as differing, which sends it to the SHA-256 grouping.  ``hot`` are
    the fingerprints that very many rows share.
    """
    key = ["fp1", "fp2", "n_bytes"]
    groups = prints.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "text_key")).alias("rep"), F.count("doc_id").alias("known")).filter("n > 1 and n_bytes > 0")
    unknown = groups.filter("known < n").select(*key)
    groups = groups.filter("known = n").withColumn("salts", salts(F.col("n")))
    member = keyed_join(prints, groups, key, hot).select(*key, "doc_id", "text_key", F.array(F.pmod(F.xxhash64("doc_id", "text_key"), F.col("salts")).cast("int")).alias("salt"), F.lit(1).alias("role"))
    rep = groups.select(*key, F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_key").alias("text_key"), F.sequence(F.lit(0), F.col("salts") - 1).alias("salt"), F.lit(0).alias("role"))
    wanted = member.dropDuplicates([*key, "doc_id", "text_key"]).unionByName(rep)
    text = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.translate(F.col("text").cast("string"), UPPER, LOWER).cast("binary").alias("text"))
    n_chunks = F.ceil(F.octet_length("text") / chunk_bytes).cast("int")
    chunks = (
        text.join(wanted, ["doc_id", "text_key"])
        .filter(F.octet_length("text") > 0)
        .withColumn("salt", F.explode("salt"))
        .select(*key, "salt", "role", "text", F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("chunk"))
        .select(*key, "salt", "chunk", "role", F.substring(F.col("text"), F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("piece"))
    )
    together = Window.partitionBy(*key, "salt", "chunk").orderBy("role")
    return chunks.withColumn("of_rep", F.first("piece").over(together)).filter("piece != of_rep").select(*key).union(unknown).distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 65536, moduli_bits: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  Of equal texts the
    row with the largest id stays; of repeated rows with one id, exactly one.
    Null text counts as empty; a null id is smaller than any other.  An empty
    table gives an empty result; other columns are neither read nor returned.
    ``docs`` is read twice, so it should be a stored table.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = staged(fingerprints(docs, chunk_bytes=chunk_bytes, moduli_bits=moduli_bits).withColumn("uid", F.monotonically_increasing_id()), "prints")
    key = ["fp1", "fp2", "n_bytes"]
    hot = hot_keys(prints.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key)
    bad = staged(differing(docs, prints, hot), "differing")
    if bad.head(1):
        prints = keyed_join(prints, bad.withColumn("bad", F.lit(True)), key, hot, "left").withColumn("tag", F.when(F.col("bad"), F.col("text_sha256")).otherwise("")).drop("bad")
    else:
        prints = prints.withColumn("tag", F.lit(""))
    key.append("tag")
    groups = prints.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "uid")).alias("keep"))
    hot = hot and hot_keys(groups, key, "group_size")
    return keyed_join(prints, groups, key, hot).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("keep.uid")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its exact copies, all columns kept.

    Rows are chosen by id; of rows that share id and text one stays.
    """
    out = exact_dedup(docs, id_col, text_col).filter("kept")
    keep_id, keep_sha, sha = own_names("id", "keep_sha", "sha")
    keep = out.select(F.col("doc_id").alias(keep_id), F.col("text_sha256").alias(keep_sha))
    same_id = F.col(id_col).eqNullSafe(F.col(keep_id))
    if not _repeats(docs, id_col):
        return docs.join(keep.select(keep_id), same_id, "left_semi")
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    return docs.withColumn(sha, F.sha2(text, 256)).join(keep, same_id & (F.col(sha) == F.col(keep_sha)), "left_semi").dropDuplicates([id_col, sha]).drop(sha)


def _repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether some id stands in more than one row."""
    return bool(docs.select(F.col(id_col).alias("id")).groupBy("id").count().filter("count > 1").head(1))
