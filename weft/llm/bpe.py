"""BPE encoding and decoding through a distinct-word table.

Texts are cut into words at places where the tokenizer never joins what stands
on both sides.  Consecutive documents form a block, whose distinct words are
numbered; a document becomes the positions of its words in that numbering.
The words of all blocks meet in one shuffle by word, where every distinct word
is encoded once by the tokenizers library, and its ids are joined back to the
blocks that hold it by (block, number), and from there to the documents by
position.  Decoding joins each id with the relation of ids and pieces, which
has a fixed size.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.shared import arrow_map, lowered, mapped, ragged_binary, scratch, slices, text_bytes

#: Text bytes that are split at once (a page), and words that are encoded at once.
SLICE, WORDS_A_CALL = 4 << 20, 8192
#: Distinct words and bytes of text after which a block is closed.
WORDS_A_BLOCK, BYTES_A_BLOCK = 1 << 19, 64 << 20
#: Words whose ids travel back together, and buckets of pages at most.
WORDS_A_PACK, MOST_BUCKETS = 1 << 17, 100_000
#: Words or ids whose bytes are put together at once.
RUNS_AT_ONCE = 1 << 16


@lru_cache(maxsize=4)
def tokenizer(path: str, special: bool = True):
    """The tokenizer, encoding whole texts: no truncation, no padding.
    Without ``special``, strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    if not special:
        made.encode_special_tokens = True
    return made


@lru_cache(maxsize=2)
def special_tokens(path: str) -> tuple[list[bytes], np.ndarray]:
    """(strings, ids) of the tokens that the library finds in a raw text before
    anything else, longest first."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    for t in added:
        if not t["special"] or any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token {t['content']!r} isn't a plain special token")
    added.sort(key=lambda t: -len(t["content"]))
    return [t["content"].encode() for t in added], np.array([t["id"] for t in added], np.uint32)


@lru_cache(maxsize=2)
def check_cuts(path: str) -> None:
    """Raise unless the tokenizer joins nothing over the cuts that are made here:
    white space is dropped, and ASCII letters and marks stay apart."""
    probe = "Ab cd12,x=(y);z\tIt's don't_go a.b[c]{d}e/f:g é日 本\n#h&i*j+k-l?m@n^o`p~q!r$s%t\"u"
    raw = np.frombuffer(probe.encode(), np.uint8)
    words = [probe.encode()[a:b] for a, b in zip(*(x.tolist() for x in word_spans(raw, np.array([0, len(raw)]))))]
    if encode_words(path, words)[0].tolist() != tokenizer(path).encode(probe, add_special_tokens=False).ids:
        raise ValueError(f"{path}: this tokenizer joins words over white space or marks")


# -- splitting -----------------------------------------------------------------

#: 0: ASCII white space, 1: ASCII letter or digit, 2: ASCII mark that joins neither, 3: the rest, which gives no cut.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[]\\^_`{}~"]] = 2
#: By 16 * (a text begins here) + 4 * class before + class here: whether a word starts here, or ended before.
_STARTS = np.array([here != 0 and (edge or before == 0 or {before, here} == {1, 2}) for edge in (0, 1) for before in range(4) for here in range(4)], np.uint8).tobytes().ljust(256, b"\0")
_ENDS = np.array([before != 0 and (edge or here == 0 or {before, here} == {1, 2}) for edge in (0, 1) for before in range(4) for here in range(4)], np.uint8).tobytes().ljust(256, b"\0")
_PLAIN = _CLASS.copy()
_PLAIN[_CLASS != 0] = 3
_CLASSES = {True: _CLASS.tobytes(), False: _PLAIN.tobytes()}
_KEEP = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(9)], np.uint64)


def word_spans(raw: np.ndarray, offsets: np.ndarray, marks: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts of a slice.

    Cuts are ASCII white space, the ends of texts and, with ``marks``, the
    places between an ASCII letter or digit and an ASCII mark.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = mapped(raw, _CLASSES[marks])
    code = np.empty(len(raw) + 1, np.uint8)
    code[1:-1] = kind[:-1] * np.uint8(4) + kind[1:]
    code[0], code[-1] = kind[0], kind[-1] * 4
    edges = offsets[1:-1]
    code[edges[(edges > 0) & (edges < len(raw))]] |= 16
    return np.flatnonzero(mapped(code, _STARTS).view(bool)), np.flatnonzero(mapped(code, _ENDS).view(bool))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each span; equal words, equal hashes."""
    whole = np.zeros(len(raw) // 8 + 2, np.uint64)
    whole.view(np.uint8)[: len(raw)] = raw
    left = ends - starts
    h0 = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h1 = h0 ^ np.uint64(0xD6E8FEB86659FD93)
    rows: np.ndarray | None = None
    at = starts
    while len(at):  # eight bytes of all words that still have some
        cell, bits = at >> 3, ((at & 7) << 3).astype(np.uint64)
        x = (whole[cell] >> bits) | (whole[cell + 1] << np.uint64(1) << (np.uint64(63) - bits))
        x &= _KEEP[np.minimum(left, 8)]
        a, b = (h0, h1) if rows is None else (h0[rows], h1[rows])
        a = (a ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(29)
        b = (b + x) * np.uint64(0x94D049BB133111EB)
        b ^= b >> np.uint64(31)
        if rows is None:
            h0, h1 = a, b
        else:
            h0[rows], h1[rows] = a, b
        more = np.flatnonzero(left > 8)
        at, left, rows = at[more] + 8, left[more] - 8, more if rows is None else rows[more]
    h0 *= np.uint64(0x9E3779B97F4A7C15)
    h1 *= np.uint64(0xD6E8FEB86659FD93)
    return h0 ^ (h0 >> np.uint64(32)), h1 ^ (h1 >> np.uint64(32))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct value, the number of each place's value), by
    one sort of the values' high bits with the places in the low ones.

    Values that agree in their high bits count as one; whoever uses this
    compares the whole hashes afterwards.
    """
    n = max(1, int(len(h)).bit_length())
    low = np.uint64((1 << n) - 1)
    key = np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64))
    place = (key & low).astype(np.int64)
    key >>= np.uint64(n)
    new = np.ones(len(h), bool)
    new[1:] = key[1:] != key[:-1]
    number = np.empty(len(h), np.int64)
    number[place] = np.cumsum(new) - 1
    return place[new], number


def cut_words(raw: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, which special token or -1) of the words of a slice.

    A special token is a word of its own wherever its string stands in one
    text, and cuts what stands before it from what comes after.
    """
    low = lowered(raw)
    spans = []
    if special:
        data = raw.tobytes()
        if any(s in data for s in special):
            for m in re.finditer(b"|".join(map(re.escape, special)), data):
                if offsets[np.searchsorted(offsets, m.start(), "right")] >= m.end():
                    spans.append((m.start(), m.end(), special.index(m.group())))
    if not spans:
        starts, ends = word_spans(low, offsets)
        return low, starts, ends, np.full(len(starts), -1, np.int64)
    begin, stop, which = np.array(spans, np.int64).T
    starts, ends = word_spans(low, np.union1d(offsets, np.concatenate([begin, stop])))
    inside = np.searchsorted(begin, starts, "right") - 1
    outside = (inside < 0) | (stop[np.maximum(inside, 0)] <= starts)
    starts, ends = starts[outside], ends[outside]
    at = np.searchsorted(starts, begin)
    return low, np.insert(starts, at, begin), np.insert(ends, at, stop), np.insert(np.full(len(starts), -1, np.int64), at, which)


def encode_words(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of ids of each) with one call of the library for many words."""
    tok = tokenizer(path, special=False)
    ids, counts = [], []
    for i in range(0, len(words), WORDS_A_CALL):
        texts = [w.decode("utf-8", "replace") for w in words[i : i + WORDS_A_CALL]]
        lengths = np.array([len(t) + 1 for t in texts])
        found = tok.encode(" ".join(texts), add_special_tokens=False)
        begins = np.array([a for a, _ in found.offsets], np.int64)
        ids.append(np.array(found.ids, np.uint32))
        counts.append(np.diff(np.searchsorted(begins, np.concatenate([[0], np.cumsum(lengths)]), "left")))
    if not ids:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(counts)


# -- blocks and their words --------------------------------------------------------


class _Block:
    """Numbers for the distinct words of consecutive documents, from ``first`` on."""

    def __init__(self, first: int):
        self.name = uuid.uuid4().int >> 65  # rows of a block are written by one attempt, together
        self.bytes, self.pages = 0, 0
        self.sorted, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.hashes = np.zeros((2, first), np.uint64)  # by number
        self.twins: dict[tuple[int, int], int] = {}  # words whose first hash, or its high bits, another word has too

    def place(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word; a place of each word that got a new number, in the order of numbers)."""
        h0, h1 = word_hashes(raw, starts, ends)
        some, group = distinct(h0)
        at = np.searchsorted(self.sorted, h0[some])
        known = np.zeros(len(some), bool)
        inside = at < len(self.sorted)
        known[inside] = self.sorted[at[inside]] == h0[some[inside]]
        of_group = np.empty(len(some), np.int64)
        of_group[known] = self.number[at[known]]
        new = some[~known]
        count = self.hashes.shape[1]
        of_group[~known] = count + np.arange(len(new))
        self.hashes = np.concatenate([self.hashes, np.stack([h0[new], h1[new]])], 1)
        order = np.argsort(h0[new])
        to = at[~known][order]
        self.sorted = np.insert(self.sorted, to, h0[new][order])
        self.number = np.insert(self.number, to, (count + np.arange(len(new)))[order])
        numbers = of_group[group]
        where = new.tolist()
        for i in np.flatnonzero((self.hashes[0][numbers] != h0) | (self.hashes[1][numbers] != h1)).tolist():
            key = (int(h0[i]), int(h1[i]))
            if key not in self.twins:
                self.twins[key] = self.hashes.shape[1]
                self.hashes = np.concatenate([self.hashes, np.array([[h0[i]], [h1[i]]], np.uint64)], 1)
                where.append(i)
            numbers[i] = self.twins[key]
        return numbers, np.array(where, np.int64)

    @property
    def full(self) -> bool:
        return self.hashes.shape[1] >= WORDS_A_BLOCK or self.bytes >= BYTES_A_BLOCK


def _pressed(numbers: np.ndarray) -> bytes:
    """32-bit numbers by planes of their bytes, compressed where that pays."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(planes) if len(numbers) > 32 else b"\0" + planes


def _unpressed(data: bytes) -> np.ndarray:
    planes = zstandard.ZstdDecompressor().decompress(data[1:]) if data[0] else data[1:]
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _split(path: str):
    """A row for each page: (block, page, the documents' ids, their numbers of
    words, the words' numbers, the first number that is new, the new words)."""
    special = special_tokens(path)[0]

    def run(batches):
        block = None
        for part in slices(batches, "text", SLICE):
            block = block or _Block(len(special))
            ids, kind = part.column(0), pa.list_(part.schema.field(0).type)
            raw, offsets = text_bytes(part.column(1))
            low, starts, ends, which = cut_words(raw, offsets, special)
            numbers, first = which.copy(), block.hashes.shape[1]
            plain = np.flatnonzero(which < 0)
            numbers[plain], at = block.place(low, starts[plain], ends[plain])
            at = plain[at]
            lengths = ends[at] - starts[at]
            new = zstandard.ZstdCompressor(level=1).compress(lengths.astype("<u4").tobytes() + _ragged(low, starts[at], lengths)[0].tobytes())
            n_words = np.diff(np.searchsorted(starts, offsets, "left"))
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.name]), pa.array([block.pages], pa.int32()), listed, *(pa.array([x], pa.binary()) for x in (_pressed(n_words), _pressed(numbers))), pa.array([first], pa.int32()), pa.array([len(at)], pa.int32()), pa.array([new], pa.binary())],
                ["block", "page", "doc_ids", "n_words", "numbers", "first_new", "n_new", "new"],
            )
            block.pages += 1
            block.bytes += len(raw)
            if block.full:
                block = None

    return run


def _new_words(batches):
    """(block, number, word) of the words that each page met first."""
    for batch in batches:
        for block, first, n, data in zip(*(c.to_pylist() for c in batch.columns)):
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
            ends = np.cumsum(data[: 4 * n].view("<u4"), dtype=np.int64)
            words = ragged_binary(data[4 * n :], ends)
            for i in range(0, n, 50_000):
                k = min(n, i + 50_000) - i
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.array(np.arange(first + i, first + i + k, dtype=np.int32)), words.slice(i, k)], ["block", "number", "word"])


def _ragged(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs of ``values`` put together, where each ends)."""
    upto = np.cumsum(counts)
    out = np.empty(int(upto[-1]) if len(upto) else 0, values.dtype)
    for a in range(0, len(upto), RUNS_AT_ONCE):
        n = counts[a : a + RUNS_AT_ONCE]
        stop = upto[a : a + RUNS_AT_ONCE]
        low, high = int(stop[0] - n[0]), int(stop[-1])
        out[low:high] = values[np.arange(low, high) + np.repeat(starts[a : a + RUNS_AT_ONCE] - (stop - n), n)]
    return out, upto


def _encode_sorted(path: str):
    """Words that come sorted are encoded once each; their ids go to every block that holds them."""

    def run(batches):
        last, last_ids = None, np.zeros(0, np.uint32)
        held: list[tuple] = []
        n = 0
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            words = coded.dictionary.to_pylist()
            again = bool(words) and words[0] == last  # the last word of the batch before
            ids, counts = encode_words(path, words[1:] if again else words)
            if again:
                ids, counts = np.concatenate([last_ids, ids]), np.concatenate([[len(last_ids)], counts])
            begin = np.cumsum(counts) - counts
            if words:
                last, last_ids = words[-1], ids[begin[-1] :]
            at = coded.indices.to_numpy()
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), counts[at], _ragged(ids, begin[at], counts[at])[0]))
            n += batch.num_rows
            if n >= WORDS_A_PACK:
                yield _packs(held)
                held, n = [], 0
        if n:
            yield _packs(held)

    return run


def _packs(held: list[tuple]) -> pa.RecordBatch:
    """One row for each block: the numbers of its words, ascending, as steps; the counts of their ids; the ids."""
    block, number, counts, ids = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((number, block))
    ids, upto = _ragged(ids, (np.cumsum(counts) - counts)[order], counts[order])
    block, number, counts = block[order], number[order].astype(np.int64), counts[order]
    stops = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)).tolist()
    rows = [(_pressed(np.diff(number[a:b], prepend=0)), _pressed(counts[a:b]), _pressed(ids[upto[a] - counts[a] : upto[b - 1]])) for a, b in zip([0, *stops[:-1]], stops)]
    return pa.RecordBatch.from_arrays([pa.array(block[np.array(stops) - 1]), *(pa.array(x, pa.binary()) for x in zip(*rows))], ["block", "steps", "counts", "ids"])


class _Words:
    """The ids of a block's words by number, from its packs."""

    def __init__(self, special_ids: np.ndarray, packs: pa.Table):
        parts = [(np.arange(len(special_ids)), np.ones(len(special_ids), np.int64), special_ids.astype(np.int64))]
        for steps, counts, ids in zip(*(packs.column(c).to_pylist() for c in ("steps", "counts", "ids"))):
            parts.append((np.cumsum(_unpressed(steps)), _unpressed(counts), _unpressed(ids)))
        number, counts, ids = (np.concatenate(x) for x in zip(*parts))
        self.ids = ids.astype(np.uint32)
        self.count, self.start = np.full(len(number), -1, np.int64), np.zeros(len(number), np.int64)
        self.count[number], self.start[number] = counts, np.cumsum(counts) - counts
        if (self.count < 0).any():
            raise ValueError("a block's word came twice and another is missing")

    def page(self, numbers: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of a page's documents, where each document's end)."""
        ids, upto = _ragged(self.ids, self.start[numbers], self.count[numbers])
        return ids, np.concatenate([[0], upto])[np.cumsum(n_words)]


def _bucketed(pages: DataFrame, buckets: int, path: str) -> tuple[DataFrame, DataFrame]:
    """``pages`` written in buckets by block, so that what is joined to them by
    block comes to them, and the same rows without regard to buckets."""
    spark = pages.sparkSession
    name = f"spark_catalog.default.weft_pages_{uuid.uuid4().hex}"
    pages.write.bucketBy(buckets, "block").option("compression", "uncompressed").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are the scratch folder's
    return table, spark.read.schema(pages.schema).parquet(path)


Page = tuple[pa.Array, np.ndarray, np.ndarray]


def map_encoded(docs: DataFrame, path: str, build: Callable[[Iterator[Page]], Iterator[pa.RecordBatch]], schema: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """``build`` over the pages (id column, ids, ends) of the encoded texts of each block.

    Every row of ``docs`` is in one page; null text counts as empty.  The pages
    are in ``folder``, which may go when the result has been written.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    check_cuts(path)
    kind = texts.schema["doc_id"].dataType.simpleString()
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, 4 * size // BYTES_A_BLOCK))
    pages, rows = _bucketed(texts.transform(arrow_map, _split(path), f"block long, page int, doc_ids array<{kind}>, n_words binary, numbers binary, first_new int, n_new int, new binary"), buckets, folder or scratch(spark, "pages"))
    words = rows.filter("n_new > 0").select("block", "first_new", "n_new", "new").transform(arrow_map, _new_words, "block long, number int, word binary")
    known = words.repartition("word").sortWithinPartitions("word").transform(arrow_map, _encode_sorted(path), "block long, steps binary, counts binary, ids binary")
    special_ids = special_tokens(path)[1]
    to = T.StructType.fromDDL(schema)
    names = to.fieldNames()

    def joined(packs: pa.Table, held: pa.Table) -> pa.Table:
        words = _Words(special_ids, packs)

        def encoded() -> Iterator[Page]:
            for batch in held.sort_by("page").to_batches():
                for i in range(batch.num_rows):
                    n_words, numbers = (_unpressed(batch.column(c)[i].as_py()) for c in (2, 3))
                    yield batch.column(1).slice(i, 1).flatten(), *words.page(numbers, n_words)

        return pa.Table.from_batches(list(build(encoded()))).select(names)

    kept = pages.select("block", "doc_ids", "n_words", "numbers", "page")
    return known.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(joined, to)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a binary column without nulls."""
    return text_bytes(pa.Array.from_buffers(pa.string(), len(column), column.buffers(), offset=column.offset))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers.

    Equal to the library's ``encode(text, add_special_tokens=False).ids`` of
    every row; null text as empty; repeated rows give repeated results.
    """

    def build(pages):
        for ids_col, ids, ends in pages:
            yield pa.RecordBatch.from_arrays([ids_col, pa.array(np.diff(np.concatenate([[0], ends])), pa.int64()), ragged_binary(ids.astype("<u4"), ends)], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_encoded(docs, path, build, f"doc_id {kind}, n_tokens long, ids binary", id_col, text_col)


# -- decoding --------------------------------------------------------------------


@lru_cache(maxsize=2)
def piece_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all pieces, offsets) by id: the id-to-piece relation, of the
    vocabulary's fixed size.  A piece is what the library gives for its id alone."""
    tok = tokenizer(path)
    size = tok.get_vocab_size(with_added_tokens=True)
    pieces = [(tok.id_to_token(i) or "").encode() for i in range(size)]
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])


def joins_with_space(path: str) -> bool:
    """Whether the tokenizer has no decoder of its own, and pieces are put together with spaces."""
    return tokenizer(path).decoder is None


def decode_slice(path: str, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The text of each run of ids, as ``decode(ids, skip_special_tokens=False)`` gives it."""
    if not joins_with_space(path):
        tok, begin = tokenizer(path), np.concatenate([[0], ends[:-1]])
        return [tok.decode(ids[a:b].tolist(), skip_special_tokens=False).encode() for a, b in zip(begin.tolist(), ends.tolist())]
    data, at = _spaced(path)
    text, upto = _ragged(data, at[ids], at[ids + np.int64(1)] - at[ids])
    stop = np.concatenate([[0], upto])[ends]
    return [text[a : max(a, b - 1)].tobytes() for a, b in zip([0, *stop[:-1].tolist()], stop.tolist())]


@lru_cache(maxsize=2)
def _spaced(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The piece table with a space after each piece."""
    data, at = piece_table(path)
    out = np.insert(data, at[1:], 32)
    return out, at + np.arange(len(at))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of the rows of :func:`encode`."""

    def run(batches):
        for part in slices(batches, "ids", SLICE):
            data, at = _binary(part.column(1))
            texts = decode_slice(path, data.view("<u4"), at[1:] // 4)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").transform(arrow_map, run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: the digests
    of its ids and of the text that they decode to.

    Null and empty text have no ids and decode to the empty text; repeated rows
    and ids give repeated results, null ids stay null; an empty table gives an
    empty result; other columns are not read.
    """
    from hashlib import sha256

    def build(pages):
        for ids_col, ids, ends in pages:
            ids = ids.astype("<u4")
            begin = np.concatenate([[0], ends[:-1]])
            view = memoryview(ids.view(np.uint8))
            of_ids = [sha256(view[4 * a : 4 * b]).hexdigest() for a, b in zip(begin.tolist(), ends.tolist())]
            of_text = [sha256(t).hexdigest() for t in decode_slice(path, ids, ends)]
            yield pa.RecordBatch.from_arrays([ids_col, pa.array(ends - begin, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_encoded(docs, path, build, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)
