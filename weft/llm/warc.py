"""WARC archives with an external index merge.

Writing: payloads that are equal share one ``response`` record, the others are
``revisit`` records that refer to it.  Each task writes one archive of
gzip-compressed records and a run: its captures' index entries, locally sorted
by URL key and timestamp.

Merging: the sorted runs are merged k ways by a loser tree.  Sampled splitters
cut the key space, so that many tasks merge disjoint stretches of all runs;
with more runs than the fan-in, groups of runs are merged to longer runs first.
The outcome is a globally ordered capture history: index files in key order.

Reading: records are found through the merged index, parsed from the archives,
and their digests are checked against their payloads.

Files below the archive's folder:
  data/*.warc.gz      records, one gzip member each
  runs/<pass>/*.run   zstd blocks of sorted index entries, found through a footer
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.shared import arrow_map, filesystem, hot_keys, keyed_join, scratch, staged

#: Runs that one task merges, and entries of a block of a run.
FAN_IN, BLOCK_ENTRIES = 64, 512
#: Entries that a merging task is meant to read.
ENTRIES_A_TASK = 1 << 17
#: Captures are dated by this and as many seconds as their id says.
EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)


# -- records ---------------------------------------------------------------------


def url_key(url: str | None) -> str:
    """Sort-friendly key: reversed host labels, then path and query, lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.strip().lower()
    key = ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/").lower()
    return key + ("?" + "&".join(sorted(parts.query.lower().split("&"))) if parts.query else "")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(kind: str, uri: str, date: str, record_id: str, page_id, digest: str, length: int, payload: bytes, refers_to=None) -> bytes:
    """One gzip member with a WARC/1.1 record."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_header(uri)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {json.dumps(page_id)}", f"X-Payload-Length: {length}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {json.dumps(refers_to)}"]
        body = b"HTTP/1.1 200 OK\r\n\r\n"
    else:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def _header(value: str) -> str:
    return re.sub(r"[\r\n]", " ", value)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of one gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


# -- runs and their merge --------------------------------------------------------


class RunWriter:
    """Sorted entries in blocks; the footer has each block's first key and place."""

    def __init__(self, folder: str, tag: str):
        self.files, path = filesystem(folder)
        self.files.create_dir(path, recursive=True)
        self.name = f"{tag}-{uuid.uuid4().hex[:12]}.run"
        self.out = self.files.open_output_stream(posixpath.join(path, self.name))
        self.held: list[tuple] = []
        self.blocks: list[tuple] = []
        self.size = self.count = 0

    def add(self, entry: tuple) -> None:
        self.held.append(entry)
        if len(self.held) >= BLOCK_ENTRIES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            block = zstandard.ZstdCompressor(level=1).compress(json.dumps(self.held, separators=(",", ":")).encode())
            self.blocks.append((self.held[0][:3], self.size, len(block)))
            self.out.write(block)
            self.size += len(block)
            self.count += len(self.held)
            self.held = []

    def close(self) -> None:
        self.flush()
        foot = zstandard.ZstdCompressor(level=1).compress(json.dumps(self.blocks).encode())
        self.out.write(foot + struct.pack("<II", len(foot), 0x52554E31))
        self.out.close()


def read_run(folder: str, name: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """Entries with low <= key < high, block by block."""
    files, path = filesystem(folder)
    with files.open_input_file(posixpath.join(path, name)) as f:
        end = f.size()
        f.seek(end - 8)
        foot, magic = struct.unpack("<II", f.read(8))
        if magic != 0x52554E31:
            raise ValueError(f"{name} is not a run")
        f.seek(end - 8 - foot)
        blocks = json.loads(zstandard.ZstdDecompressor().decompress(f.read(foot)))
        firsts = [tuple(b[0]) for b in blocks]
        at = max(0, bisect.bisect_left(firsts, low) - 1) if low else 0
        for first, place, size in blocks[at:]:
            if high and tuple(first) >= high:
                return
            f.seek(place)
            for entry in json.loads(zstandard.ZstdDecompressor().decompress(f.read(size))):
                key = tuple(entry[:3])
                if low and key < low:
                    continue
                if high and key >= high:
                    return
                yield tuple(entry)


class LoserTree:
    """Merge of k sorted iterators: each inner node keeps the loser of its
    match, so the next smallest entry costs one path of matches."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources = sources
        self.k = max(1, len(sources))
        self.heads = [next(s, None) for s in sources] or [None]
        self.loser = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[:3], a) < (y[:3], b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        left, right = self._build(2 * node), self._build(2 * node + 1)
        first, self.loser[node] = (left, right) if self._less(left, right) else (right, left)
        return first

    def __iter__(self) -> Iterator[tuple]:
        while (entry := self.heads[self.winner]) is not None:
            yield entry
            at = self.winner
            self.heads[at] = next(self.sources[at], None)
            node = (at + self.k) // 2
            while node >= 1 and self.k > 1:
                if self._less(self.loser[node], at):
                    at, self.loser[node] = self.loser[node], at
                node //= 2
            self.winner = at


def _merge_tasks(source: str, target: str):
    """Merge the slices of runs that each row names, to one run a row."""

    def run(batches):
        for batch in batches:
            for part, low, high, names in zip(*(c.to_pylist() for c in batch.columns)):
                low, high = (tuple(json.loads(x)) if x else None for x in (low, high))
                out = RunWriter(target, f"{part:06d}")
                for entry in LoserTree([read_run(source, n, low, high) for n in names]):
                    out.add(entry)
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out.name]), pa.array([out.count], pa.int64())], ["part", "name", "n"])

    return run


_TASK = "part int, low string, high string, names array<string>"


def merge_runs(spark: SparkSession, root: str, runs: list[tuple[str, int]], splitters: list[tuple], fan_in: int = FAN_IN) -> tuple[str, list[str]]:
    """(folder, run files in key order) of the merge of all runs.

    While there are more than ``fan_in`` runs, groups of that many are merged
    to one each, all in parallel; the last pass cuts the keys at ``splitters``.
    """
    folder, names, level = posixpath.join(root, "runs", "0"), [n for n, _ in runs], 0

    def merged(tasks, source, target):
        plan = spark.createDataFrame(tasks, _TASK).repartition(len(tasks), "part")
        return sorted((r.part, r.name) for r in staged(plan.transform(arrow_map, _merge_tasks(source, target), "part int, name string, n long"), "merged").collect())

    while len(names) > fan_in:
        level += 1
        target = posixpath.join(root, "runs", str(level))
        names = [n for _, n in merged([(i // fan_in, None, None, names[i : i + fan_in]) for i in range(0, len(names), fan_in)], folder, target)]
        folder = target
    target = posixpath.join(root, "runs", "merged")
    cuts = [None, *(json.dumps(s) for s in splitters), None]
    return target, [n for _, n in merged([(i, cuts[i], cuts[i + 1], names) for i in range(len(cuts) - 1)], folder, target)] if names else []


# -- writing -----------------------------------------------------------------------


def _signatures(batches):
    for batch in batches:
        html = [b"" if h is None else h for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([hashlib.sha1(h).digest() + hashlib.sha256(h).digest() for h in html], pa.binary()), pa.array([len(h) for h in html], pa.int64())], ["page_id", "url", "content", "length"])


def roles(pages: DataFrame, smallest: int) -> DataFrame:
    """(page_id, url, content, n_rows, refers_to, lead) of the distinct rows.

    Of rows with equal payload of at least ``smallest`` bytes, the one with the
    largest page_id, then url, leads; the others refer to its page.
    """
    signed = staged(pages.transform(arrow_map, _signatures, "page_id long, url string, content binary, length long"), "signed")
    rows = staged(signed.groupBy("content", "page_id", "url").agg(F.count(F.lit(1)).alias("n_rows"), F.first("length").alias("length")), "distinct-pages")
    keep = rows.filter(F.col("length") >= smallest).groupBy("content").agg(F.max(F.struct("page_id", "url")).alias("keep"), F.count(F.lit(1)).alias("n"))
    hot = hot_keys(keep, ["content"])  # such as the empty payload
    lead = F.col("page_id").eqNullSafe(F.col("keep.page_id")) & F.col("url").eqNullSafe(F.col("keep.url"))
    return keyed_join(rows, keep, ["content"], hot, "left").select("page_id", "url", "content", "n_rows", F.col("keep").isNotNull().alias("grouped"), F.col("keep.page_id").alias("refers_to"), (F.col("keep").isNotNull() & lead).alias("lead"))


def _write_archive(root: str):
    """An archive and a sorted run for each task."""

    def run(batches):
        files, folder = filesystem(posixpath.join(root, "data"))
        files.create_dir(folder, recursive=True)
        pid = TaskContext.get().partitionId()
        name, out, place, entries = f"{pid:06d}-{uuid.uuid4().hex[:12]}.warc.gz", None, 0, []
        for batch in batches:
            for page_id, url, html, n_rows, grouped, refers_to, lead in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or files.open_output_stream(posixpath.join(folder, name), compression=None)
                payload = html or b""
                digest = payload_digest(payload)
                date = (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
                for copy in range(n_rows):
                    kind = "revisit" if grouped and not (lead and copy == 0) else "response"
                    data = make_record(kind, url or "", date, str(uuid.uuid4()), page_id, digest, len(payload), payload if kind == "response" else b"", refers_to)
                    out.write(data)
                    entries.append((url_key(url), date, "" if page_id is None else f"{page_id + (1 << 63):020d}", name, place, len(data)))
                    place += len(data)
        if out:
            out.close()
            writer = RunWriter(posixpath.join(root, "runs", "0"), f"{pid:06d}")
            entries.sort(key=lambda e: e[:3])
            for e in entries:
                writer.add(e)
            writer.close()
            step = max(1, len(entries) // 32)
            sample = [json.dumps(e[:3]) for e in entries[step // 2 :: step]]
            yield pa.RecordBatch.from_arrays([pa.array([writer.name]), pa.array([len(entries)], pa.int64()), pa.array([sample], pa.list_(pa.string()))], ["run", "n", "sample"])

    return run


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", smallest: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """Write all rows as WARC records below ``root``, merge their index, and
    return the index files in key order as (part, folder, name).

    Payloads are the UTF-8 bytes of the column, null as empty.  Rows that agree
    in id, URL and payload give as many records, one of which leads.  A null
    URL has the empty key.  Ids are integers.  Other columns are not read.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("html"))
    plan = staged(roles(pages, smallest), "roles")
    content = F.concat(F.unhex(F.sha1("html")), F.unhex(F.sha2("html", 256)))
    known = pages.withColumn("content", content).alias("p").join(
        plan.alias("r"), F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & F.col("p.url").eqNullSafe(F.col("r.url")) & (F.col("p.content") == F.col("r.content"))
    )
    once = known.filter("n_rows = 1").select("p.page_id", "p.url", "p.html", "r.n_rows", "r.grouped", "r.refers_to", "r.lead")
    again = known.filter("n_rows > 1").groupBy("p.content", "p.page_id", "p.url").agg(*(F.first(c).alias(c.split(".")[1]) for c in ("p.html", "r.n_rows", "r.grouped", "r.refers_to", "r.lead"))).select("page_id", "url", "html", "n_rows", "grouped", "refers_to", "lead")
    rows = once.unionByName(again) if plan.filter("n_rows > 1").head(1) else once
    runs = staged(rows.transform(arrow_map, _write_archive(root), "run string, n long, sample array<string>"), "runs").collect()  # a row for each task
    total = sum(r.n for r in runs)
    pool = sorted(tuple(json.loads(x)) for r in runs for x in r["sample"])
    parts = max(1, min(len(pool), -(-total // ENTRIES_A_TASK), 4096) if total > ENTRIES_A_TASK else min(len(pool), 8))
    cuts = sorted({pool[i * len(pool) // parts] for i in range(1, parts)}) if pool else []
    folder, names = merge_runs(spark, root, [(r.run, r.n) for r in sorted(runs, key=lambda r: r.run)], cuts, fan_in)
    return spark.createDataFrame([(i, folder, n) for i, n in enumerate(names)], "part int, folder string, name string")


# -- reading -----------------------------------------------------------------------


#: Bytes of an archive that one task reads.
STRETCH = 64 << 20


def _read_index(batches):
    """(part, row, key, date, archive, stretch, place, length) of the entries of index files."""
    names = ["part", "row", "url_key", "date", "archive", "stretch", "place", "length"]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for part, source, name in zip(*(c.to_pylist() for c in batch.columns)):
            rows = []
            for row, (key, date, _, archive, place, length) in enumerate(read_run(source, name)):
                rows.append((part, row, key, date, archive, place // STRETCH, place, length))
                if len(rows) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _read_records(root: str, with_payload: bool):
    """Captures from entries sorted by archive and place: each archive is read from front to back."""

    def run(batches):
        files, folder = filesystem(posixpath.join(root, "data"))
        now, handle, rows, size = None, None, [], 0
        for batch in batches:
            for part, row, key, date, archive, _, place, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != now:
                    if handle:
                        handle.close()
                    now, handle = archive, files.open_input_file(posixpath.join(folder, archive))
                handle.seek(place)
                headers, payload = parse_record(handle.read(length))
                digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                full = int(headers["x-payload-length"])
                if kind == "response" and (payload_digest(payload) != digest or len(payload) != full):
                    raise ValueError(f"a payload in {archive} doesn't match its digest")
                refers = json.loads(headers["x-refers-to-page"]) if kind == "revisit" else None
                rows.append((part, row, key, date, json.loads(headers["x-page-id"]), full, digest, kind, refers, payload if with_payload else None))
                size += len(payload)
                if len(rows) >= 4096 or with_payload and size > 1 << 22:
                    yield _captures(rows)
                    rows, size = [], 0
        if handle:
            handle.close()
        if rows:
            yield _captures(rows)

    return run


_CAPTURE = "part int, row long, url_key string, date string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_KINDS = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], [x.split()[0] for x in _CAPTURE.split(", ")])


def read_archives(index: DataFrame, root: str, with_payload: bool = False) -> DataFrame:
    """All captures through the merged index; (part, row) is their global order.

    The index is dealt by archive, in stretches, so that archives are read in
    their own order; sort by (part, row) for histories.
    """
    n = max(1, index.count())
    entries = index.repartition(n, "part").transform(arrow_map, _read_index, "part int, row long, url_key string, date string, archive string, stretch long, place long, length long")
    return entries.repartition("archive", "stretch").sortWithinPartitions("archive", "place").transform(arrow_map, _read_records(root, with_payload), _CAPTURE)


def archived(pages: DataFrame, root: str | None = None, smallest: int = 0) -> DataFrame:
    """Write the archives, read them back: a row for each record.

    page_id, payload_bytes, payload_digest, record_type, refers_to.  A null
    payload is empty; rows that are equal in all give as many records, one of
    which may lead; of equal payloads with null ids and others the largest id
    leads.  An empty table gives an empty result; other columns are not read.
    """
    root = root or scratch(pages.sparkSession, "warc")
    index = write_archives(pages, root, smallest=smallest)
    return read_archives(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
