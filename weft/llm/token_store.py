"""Content-addressed store of token ids.

A document's ids are cut into chunks where a rolling hash of the last WINDOW
ids says so, so equal stretches give equal chunks wherever they stand.  A chunk
is kept once, under the digest of its bytes, in pack files of compressed
frames; a document is a recipe of digests.  Recipe files follow ascending
document ids.  A Merkle root for each file, and one over them all in the
manifest, are checked when the store is read, and so is each chunk's digest.

Files below the store's folder:
  packs/*.pack      frames: zstd of consecutive chunks, ids little-endian, 16 or 32 bits
  index/            Parquet: digest, pack, frame, frame_bytes, at, n_ids
  recipes/*.rec     zstd blocks of (doc_id, n_ids, number of chunks, digests)
  manifest/         Parquet: file, kind, first position, documents, ids, Merkle root
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.bpe import map_encoded, tokenizer
from weft.llm.shared import arrow_map, filesystem, hot_keys, keyed_join, remove, scratch, staged

WINDOW, SHORTEST, MEAN_BITS, LONGEST = 16, 64, 8, 2048
DIGEST = 20
FRAME_BYTES = 1 << 17
#: Digests of chunks that a writing task remembers, and frames that a reading task keeps.
DIGESTS_HELD, FRAMES_HELD = 1 << 19, 96
#: Documents of a recipe block, and chunks that are checked together.
BLOCK_DOCS, CHUNKS_AT_ONCE = 512, 256
NULL_ID = -(1 << 63)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree over digests; an odd one out moves up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return digest(b"root" + level[0])


def _gear(ids: np.ndarray) -> np.ndarray:
    """A 64-bit value for each id, by a mixing rule."""
    z = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(27))


def cut_points(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of all chunks, number of chunks of each document) for consecutive documents.

    A chunk has SHORTEST to LONGEST ids, but for a document's last.  The
    window lies within the document because SHORTEST is over WINDOW.
    """
    rolling, width = _gear(ids), 1
    while width < WINDOW:  # a window of twice the width is two neighbouring ones
        wider = rolling.copy()
        wider[width:] += rolling[:-width] << np.uint64(width)
        rolling, width = wider, 2 * width
    at = np.flatnonzero(rolling >> np.uint64(64 - MEAN_BITS) == 0) + 1
    out: list[int] = []
    counts = np.zeros(len(ends), np.int64)
    lo = np.searchsorted(at, np.concatenate([[0], ends[:-1]]), "right").tolist()
    hi = np.searchsorted(at, ends, "left").tolist()
    at, begin = at.tolist(), 0
    for i, end in enumerate(ends.tolist()):
        had, last = len(out), begin
        for cut in [*at[lo[i] : hi[i]], end]:
            while cut - last > LONGEST:
                last += LONGEST
                out.append(last)
            if cut - last >= SHORTEST:
                last = cut
                out.append(cut)
        if last < end or begin == end:
            out.append(end)
        counts[i], begin = len(out) - had, end
    return np.array(out, np.int64), counts


class _PackWriter:
    """One pack file; its name is this attempt's own, so a retry never mixes with it."""

    def __init__(self, root: str, tag: str):
        self.files, folder = filesystem(root)
        self.files.create_dir(folder, recursive=True)
        self.name = f"{tag}-{uuid.uuid4().hex[:12]}.pack"
        self.path = posixpath.join(folder, self.name)
        self.out = None
        self.size, self.held, self.bytes = 0, [], 0
        self.rows: list[tuple] = []
        self.pending: list[tuple] = []

    def add(self, name: bytes, data: bytes, n_ids: int) -> None:
        self.pending.append((name, self.bytes, n_ids))
        self.held.append(data)
        self.bytes += len(data)
        if self.bytes >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        self.out = self.out or self.files.open_output_stream(self.path)
        frame = zstandard.ZstdCompressor(level=1).compress(b"".join(self.held))
        self.out.write(frame)
        self.rows += [(name, self.name, self.size, len(frame), at, n) for name, at, n in self.pending]
        self.size += len(frame)
        self.held, self.pending, self.bytes = [], [], 0

    def close(self) -> None:
        self.flush()
        if self.out:
            self.out.close()

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


class _PackReader:
    """Chunks by place; the frames read last are kept."""

    def __init__(self, root: str):
        self.files, self.folder = filesystem(root)
        self.open: OrderedDict = OrderedDict()
        self.frames: OrderedDict = OrderedDict()

    def chunk(self, pack: str, frame: int, size: int, at: int, n_bytes: int) -> bytes:
        key = (pack, frame)
        if key not in self.frames:
            if pack not in self.open:
                if len(self.open) >= 16:
                    self.open.popitem(last=False)[1].close()
                self.open[pack] = self.files.open_input_file(posixpath.join(self.folder, pack))
            self.open.move_to_end(pack)
            self.open[pack].seek(frame)
            self.frames[key] = zstandard.ZstdDecompressor().decompress(self.open[pack].read(size))
            if len(self.frames) > FRAMES_HELD:
                self.frames.popitem(last=False)
        self.frames.move_to_end(key)
        return self.frames[key][at : at + n_bytes]


PLACE = "digest binary, pack string, frame long, frame_bytes int, at int, n_ids int"
_PLACE_NAMES = [x.split()[0] for x in PLACE.split(", ")]
_PLACE_TYPES = [pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def _places(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows), _PLACE_TYPES)] if rows else [pa.array([], t) for t in _PLACE_TYPES]


def _chunked(texts: DataFrame, path: str, root: str, width: int, end_id: int) -> DataFrame:
    """Encode, cut and put aside: a row for each document, and one for each
    chunk that its task met first, with the place in the task's own pack."""
    kind = f"<u{width}"
    names = ["doc_id", "total", "recipe", *_PLACE_NAMES]

    def run(pages):
        writer = None
        seen: set[bytes] = set()

        def chunk_rows():
            rows = writer.take()
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *_places(rows)], names)

        for doc_ids, ids, ends in pages:
            writer = writer or _PackWriter(posixpath.join(root, "aside"), str(TaskContext.get().partitionId()))
            ends = ends + np.arange(1, len(ends) + 1)
            all_ids = np.full(ends[-1], end_id, np.uint32)
            keep = np.ones(len(all_ids), bool)
            keep[ends - 1] = False
            all_ids[keep] = ids
            data = memoryview(all_ids.astype(kind).tobytes())
            cuts, counts = cut_points(all_ids, ends)
            digests, last = [], 0
            for cut in cuts.tolist():
                chunk = bytes(data[last * width : cut * width])
                name = digest(chunk)
                digests.append(name)
                if name not in seen:
                    if len(seen) >= DIGESTS_HELD:
                        seen.clear()
                    seen.add(name)
                    writer.add(name, chunk, cut - last)
                last = cut
            upto = np.concatenate([[0], np.cumsum(counts)]).tolist()
            recipes = [b"".join(digests[a:b]) for a, b in zip(upto[:-1], upto[1:])]
            n = len(recipes)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(np.concatenate([[0], ends])), pa.int64()), pa.array(recipes, pa.binary()), *[pa.nulls(n, t) for t in _PLACE_TYPES]], names)
            if writer.rows:
                yield chunk_rows()
        if writer:
            writer.close()
            if writer.rows:
                yield chunk_rows()

    return map_encoded(texts, path, run, f"doc_id long, total long, recipe binary, {PLACE}", folder=posixpath.join(root, "pages"))


def _compact(root: str, width: int):
    """Copy the chunks that were chosen to the store's packs, in the order of their places."""

    def run(batches):
        reader = _PackReader(posixpath.join(root, "aside"))
        writer = None
        for batch in batches:
            writer = writer or _PackWriter(posixpath.join(root, "packs"), str(TaskContext.get().partitionId()))
            for name, pack, frame, size, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                writer.add(name, reader.chunk(pack, frame, size, at, n * width), n)
            if writer.rows:
                yield pa.RecordBatch.from_arrays(_places(writer.take()), _PLACE_NAMES)
        if writer:
            writer.close()
            if writer.rows:
                yield pa.RecordBatch.from_arrays(_places(writer.take()), _PLACE_NAMES)

    return run


_FILE = "file string, kind string, part int, n_docs long, n_ids long, root binary"


def _write_recipes(root: str):
    """A recipe file for each partition of rows sorted by id."""

    def run(batches):
        files, folder = filesystem(posixpath.join(root, "recipes"))
        files.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name, out, leaves, docs, ids, held = f"{part:08d}-{uuid.uuid4().hex[:12]}.rec", None, [], 0, 0, []

        def flush():
            nonlocal held
            block = zstandard.ZstdCompressor(level=1).compress(b"".join(held))
            leaves.append(digest(block))
            out.write(struct.pack("<I", len(block)) + block)
            held = []

        for batch in batches:
            for doc, n, recipe in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or files.open_output_stream(posixpath.join(folder, name))
                held.append(struct.pack("<qqI", NULL_ID if doc is None else doc, n, len(recipe) // DIGEST) + recipe)
                docs, ids = docs + 1, ids + n
                if len(held) >= BLOCK_DOCS:
                    flush()
        if out:
            if held:
                flush()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array(["recipe"]), pa.array([part], pa.int32()), pa.array([docs]), pa.array([ids]), pa.array([merkle_root(leaves)], pa.binary())], [x.split()[0] for x in _FILE.split(", ")])

    return run


def _pack_roots(batches):
    """Merkle root of each pack, from index rows sorted by pack and place."""
    name, leaves, ids = None, [], 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array(["pack"]), pa.array([0], pa.int32()), pa.array([len(leaves)], pa.int64()), pa.array([ids], pa.int64()), pa.array([merkle_root(leaves)], pa.binary())], [x.split()[0] for x in _FILE.split(", ")])

    for batch in batches:
        for d, pack, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(5).to_pylist()):
            if pack != name:
                if name is not None:
                    yield row()
                name, leaves, ids = pack, [], 0
            leaves.append(d)
            ids += n
    if name is not None:
        yield row()


def _index_roots(index: DataFrame) -> DataFrame:
    return index.repartition("pack").sortWithinPartitions("pack", "frame", "at").transform(arrow_map, _pack_roots, _FILE)


def write_store(docs: DataFrame, path: str, root: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` with the tokenizer at ``path`` and write the store below ``root``.

    ``end_id`` closes each document; null text counts as empty.  Documents
    stand in ascending order of their integer id, null first; those that share
    an id stand together in no fixed order.  Other columns are not read.
    """
    width = 2 if tokenizer(path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    made = staged(_chunked(texts, path, root, width, end_id), "chunked")
    remove(spark, posixpath.join(root, "pages"))
    place = [F.col(c) for c in _PLACE_NAMES[1:]]
    chosen = made.filter("digest is not null").groupBy("digest").agg(F.min(F.struct(*place)).alias("p")).select("digest", "p.*")
    index = chosen.repartition("pack").sortWithinPartitions("pack", "frame", "at").transform(arrow_map, _compact(root, width), PLACE)
    index.write.option("compression", "zstd").parquet(posixpath.join(root, "index"))
    remove(spark, posixpath.join(root, "aside"))
    index = spark.read.schema(PLACE).parquet(posixpath.join(root, "index"))
    recipes = made.filter("recipe is not null").select("doc_id", F.col("total").alias("n_ids"), "recipe")
    ordered = recipes.repartitionByRange("doc_id").sortWithinPartitions("doc_id").transform(arrow_map, _write_recipes(root), _FILE)
    _index_roots(index).unionByName(ordered).withColumn("width", F.lit(width)).write.parquet(posixpath.join(root, "manifest"))


def _items(root: str):
    """The recipes of the files named, as (part, row, doc_id, start, n_ids, seq, digest)."""

    def run(batches):
        files, folder = filesystem(posixpath.join(root, "recipes"))
        names = ["part", "row", "doc_id", "start", "n_ids", "seq", "n_chunks", "digest"]
        for batch in batches:
            for name, part, start, want in zip(*(c.to_pylist() for c in batch.columns)):
                leaves, row = [], 0
                with files.open_input_stream(posixpath.join(folder, name)) as stream:
                    while head := stream.read(4):
                        block = stream.read(struct.unpack("<I", head)[0])
                        leaves.append(digest(block))
                        data, at, rows = zstandard.ZstdDecompressor().decompress(block), 0, []
                        while at < len(data):
                            doc, n, k = struct.unpack_from("<qqI", data, at)
                            at += 20
                            rows += [(part, row, None if doc == NULL_ID else doc, start, n, i, k, data[at + i * DIGEST : at + (i + 1) * DIGEST]) for i in range(k)]
                            at, row, start = at + k * DIGEST, row + 1, start + n
                        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                if merkle_root(leaves) != want:
                    raise ValueError(f"recipe file {name} doesn't match its manifest")

    return run


def _assemble(root: str, width: int):
    """Documents from items sorted by (part, row, seq); each chunk is checked against its digest."""

    def run(batches):
        reader = _PackReader(posixpath.join(root, "packs"))
        rows, held, crc, n = [], [], 0, 0
        for batch in batches:
            for part, row, doc, start, n_ids, seq, k, name, pack, frame, size, at, count in zip(*(c.to_pylist() for c in batch.columns)):
                if pack is None:
                    raise ValueError(f"document {doc}: a chunk is not in the store")
                chunk = reader.chunk(pack, frame, size, at, count * width)
                if digest(chunk) != name:
                    raise ValueError(f"a chunk of document {doc} doesn't match its digest")
                if seq == 0:
                    held, crc, n = [], 0, 0
                held.append(chunk)
                n += count
                if seq == k - 1 or len(held) >= CHUNKS_AT_ONCE:
                    crc = zlib.crc32(np.frombuffer(b"".join(held), f"<u{width}").astype("<u4").tobytes(), crc)
                    held = []
                if seq == k - 1:
                    if n != n_ids:
                        raise ValueError(f"document {doc} has {n} ids, not {n_ids}")
                    rows.append((doc, start, n, crc))
            if len(rows) >= 4096:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    return run


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    Packs, recipe files and chunks are checked against their Merkle roots and
    digests; a mismatch raises.  An empty store gives an empty result.
    """
    manifest = spark.read.parquet(posixpath.join(root, "manifest"))
    index = spark.read.schema(PLACE).parquet(posixpath.join(root, "index"))
    # a row for each file: as many as the partitions that wrote them
    files = manifest.filter("kind = 'recipe'").select("file", "part", "n_ids", "root", "width").collect()
    width = files[0].width if files else 2
    packs = manifest.filter("kind = 'pack'").select("file", "root")
    changed = packs.join(_index_roots(index).select("file", F.col("root").alias("now")), "file", "full").filter(~F.col("root").eqNullSafe(F.col("now")))
    if changed.head(1):
        raise ValueError("a pack's index doesn't match its manifest")
    rows, start = [], 0
    for f in sorted(files, key=lambda f: f.part):
        rows.append((f.file, f.part, start, bytearray(f.root)))
        start += f.n_ids
    named = spark.createDataFrame(rows, "file string, part int, start long, root binary").repartition(max(1, len(rows)), "part")
    items = named.transform(arrow_map, _items(root), "part int, row long, doc_id long, start long, n_ids long, seq int, n_chunks int, digest binary")
    items = staged(items, "items")
    common = hot_keys(items.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), ["digest"])
    placed = keyed_join(items, index.withColumnRenamed("n_ids", "count"), ["digest"], common, "left").select("part", "row", "doc_id", "start", "n_ids", "seq", "n_chunks", "digest", "pack", "frame", "frame_bytes", "at", "count")
    return placed.repartition("part", F.floor(F.col("row") / 1024)).sortWithinPartitions("part", "row", "seq").transform(arrow_map, _assemble(root, width), "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, path: str, end_id: int = 1, root: str | None = None) -> DataFrame:
    """Write the store and read it back: doc_id, start, n_tokens, ids_crc32 of each row.

    Null text has the end id alone.  Null ids come first, and rows that share
    an id stand together in no fixed order.  An empty table gives an empty
    result; other columns are not read.
    """
    root = root or scratch(docs.sparkSession, "store")
    write_store(docs, path, root, end_id)
    return read_store(docs.sparkSession, root)
