"""Repeated passages by suffix arrays.

A byte goes when some string of ``width`` bytes that covers it also starts
anywhere else.  Each start has an anchor: of all K-byte strings within its
``width`` bytes, the one with the least hash.  Equal strings have equal anchors
at equal places, so starts with different anchors needn't meet.  Consecutive
starts with one anchor are a piece of text; equal pieces are one, with a count;
pieces whose anchor stands nowhere else can't repeat and go no further.

The pieces of an anchor meet in one task, which builds their suffix array in
two stages: suffixes smaller than their successors are sorted directly, all
others are induced by a scan over the buckets of first bytes.  Starts whose
common prefix with a neighbour reaches ``width`` are repeated.

An anchor with many different pieces, as at the edge of a passage that very
many documents share, isn't gathered: its pieces are cut again by longer
anchors, in the end of the full width, where equal starts are just counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.shared import arrow_map, binary_bytes, clear_scratch, fits_broadcast, hot_keys, keyed_join, remove, slices, staged, staged_so_far

#: Bytes of a string that counts as repeated.
WIDTH = 200
#: Lengths of anchors as shares of the width, from one round of cutting to the next.
ANCHORS = (0.16, 0.56, 0.84, 1.0)
#: Different pieces of one anchor that a task sorts, and bytes of pieces that it sorts at once.
PIECES_AN_ANCHOR, SORT_BYTES = 512, 1 << 20
#: Bytes of text that are cut at once; a longer text is cut in segments of that many starts.
CUT_BYTES, SEGMENT = 1 << 20, 4 << 20
#: An anchor is hot from so many texts on, and a list of so many hot anchors is broadcast, if it has few bytes too.
HOT_ANCHOR, BROADCAST_ROWS = 256, 250_000
_PLACE_BITS = np.uint64(24)
_MIX = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


# -- cutting -------------------------------------------------------------------


def anchored(raw: np.ndarray, offsets: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, first start, last start) of the pieces of all texts.

    Hashes of K bytes are put together from those of half as many, and so are
    the minima over the ``width - k + 1`` places within a start's bytes; of
    equal minima the first counts.
    """
    n = len(raw)
    hashed, have = _MIX[raw], 1
    whole = [(hashed, 1)]  # by powers of two
    with np.errstate(over="ignore"):
        while have * 2 <= k:
            wider = hashed * np.uint64(pow(0x9E3779B97F4A7C15, have, 1 << 64))
            wider[:-have] += hashed[have:]
            hashed, have = wider, 2 * have
            whole.append((hashed, have))
        rest = k - have
        for part, size in reversed(whole[:-1]):
            if rest >= size:
                wider = hashed * np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64))
                wider[:-have] += part[have:]
                hashed, have, rest = wider, have + size, rest - size
        hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashed ^= hashed >> np.uint64(32)
    least = (hashed >> _PLACE_BITS << _PLACE_BITS) | np.arange(n, dtype=np.uint64)
    places, reach = width - k + 1, 1
    while reach < places:
        step = min(reach, places - reach)
        least[:-step] = np.minimum(least[:-step], least[step:])
        reach += step
    ends = np.repeat(offsets[1:], np.diff(offsets))
    start = np.flatnonzero(np.arange(n) + width <= ends)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none
    at = (least[start] & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.concatenate([first[1:] - 1, [len(start) - 1]])
    return hashed[at[first]].view(np.int64), start[first], start[last]


def _pieces(raw: np.ndarray, offsets: np.ndarray, width: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, first start in it, number of starts, anchor, digest) of all pieces."""
    if len(offsets) == 2 and len(raw) > SEGMENT + width:
        parts = [_pieces(raw[a : a + SEGMENT + width - 1], np.array([0, min(SEGMENT + width - 1, len(raw) - a)]), width, k) for a in range(0, len(raw) - width + 1, SEGMENT)]
        for i, p in enumerate(parts):
            p[1][:] += i * SEGMENT
        return tuple(np.concatenate(c) for c in zip(*parts))
    anchor, first, last = anchored(raw, offsets, width, k)
    view = memoryview(raw.tobytes())
    made = b"".join(hashlib.blake2b(view[a : b + width], digest_size=8).digest() for a, b in zip(first.tolist(), last.tolist()))
    text = np.searchsorted(offsets, first, "right") - 1
    return text, first - offsets[text], last - first + 1, anchor, np.frombuffer(made, np.int64)


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges ``low..high``."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > high[:-1] + 1])
    at = np.flatnonzero(new)
    return low[at], high[np.concatenate([at[1:] - 1, [len(low) - 1]])]


_CUT = "row long, place long, anchor long, digest long, n long, n_bytes long, sha binary, known array<int>"
_CUT_NAMES = [c.split()[0] for c in _CUT.split(", ")] + ["doc_id"]


def _cut(width: int, k: int):
    """Rows of (row, copies, doc_id, text) to a row for each text and one for each different piece in it.

    ``place`` holds a piece's first start and, in its low 16 bits, the number
    of its starts.  Further copies of a piece in its own text are repeated for
    sure: their starts stand with the text's row in ``known``.
    """

    def run(batches):
        for part in slices(batches, "text", CUT_BYTES):
            raw, offsets = binary_bytes(part.column(3))
            rows, copies, ids = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2)
            view, bounds = memoryview(raw), offsets.tolist()
            sha = [hashlib.sha256(view[a:b]).digest() for a, b in zip(bounds[:-1], bounds[1:])]
            text, start, starts, anchor, digest = _pieces(raw, offsets, width, k)
            order = np.lexsort((digest, text))  # stable: equal pieces stay in the order of their starts
            text, start, starts, anchor, digest = (c[order] for c in (text, start, starts, anchor, digest))
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (digest[1:] != digest[:-1]) | (anchor[1:] != anchor[:-1])
            first, again = np.flatnonzero(new), np.flatnonzero(~new)
            times = np.diff(np.concatenate([first, [len(text)]]))
            known: list = [None] * len(sha)
            owners = text[again]
            for t in np.unique(owners).tolist():
                mine = again[np.searchsorted(owners, t) : np.searchsorted(owners, t, "right")]
                known[t] = np.stack(merged(start[mine], start[mine] + starts[mine] - 1), 1).ravel().tolist()
            n, m, no = len(sha), len(first), pa.nulls
            none = no(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows), none, none, none, pa.array(copies), pa.array(np.diff(offsets)), pa.array(sha, pa.binary()), pa.array(known, pa.list_(pa.int32())), ids], _CUT_NAMES)
            owners = text[first]
            yield pa.RecordBatch.from_arrays([pa.array(rows[owners]), pa.array((start[first] << 16) | starts[first]), pa.array(anchor[first]), pa.array(digest[first]), pa.array(times * copies[owners]), no(m, pa.int64()), no(m, pa.binary()), no(m, pa.list_(pa.int32())), no(m, ids.type)], _CUT_NAMES)

    return run


def _cut_texts(texts: DataFrame, width: int, level: int) -> DataFrame:
    """``texts`` (row, copies, doc_id, text) cut by the anchors of a round."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    return staged(texts.transform(arrow_map, _cut(width, max(1, round(width * ANCHORS[level]))), f"{_CUT}, doc_id {kind}"), "cut")


# -- suffix arrays -------------------------------------------------------------


def _eights(symbols: np.ndarray) -> np.ndarray:
    """The eight symbols from each place on as one number that sorts as they do."""
    out = symbols.astype(np.uint64)
    for step in (1, 2, 4):
        wider = out << np.uint64(8 * step)
        wider[:-step] |= out[step:]
        out = wider
    return out


def _sorted_directly(at: np.ndarray, eights: np.ndarray, width: int) -> np.ndarray:
    """Suffixes in order of their first ``width`` symbols, eight more in each round for those still tied."""
    order = np.argsort(eights[at], kind="stable")
    at = at[order]
    key = eights[at]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    for depth in range(8, width, 8):
        alone = new & np.concatenate([new[1:], [True]])
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        group = np.cumsum(new[tied])
        key = eights[np.minimum(at[tied] + depth, len(eights) - 1)]
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(group[order], kind="stable")]
        at[tied] = at[tied][order]
        key = key[order]
        new[tied[1:]] |= key[1:] != key[:-1]
    return at


def suffix_order(symbols: np.ndarray, wanted: np.ndarray, width: int, eights: np.ndarray | None = None) -> np.ndarray:
    """The ``wanted`` places (a mask) in the order of the suffixes there, to a depth of ``width``.

    ``symbols`` are bytes over 0, with a 0 behind each text.  A suffix that is
    smaller than its successor is sorted directly; so is the end of a text.
    All others stand, within the bucket of their first symbol, in the order in
    which a scan from the least suffix on meets their successors, before the
    bucket's own sorted ones.  Of the places that aren't wanted, only those
    take part through which wanted ones are induced.
    """
    eights = _eights(symbols) if eights is None else eights
    n = len(symbols)
    differs = np.concatenate([np.flatnonzero(symbols[1:] != symbols[:-1]), [n - 1]])
    turn = differs[np.searchsorted(differs, np.arange(n))]  # where the run of equal symbols ends
    rises = symbols[np.minimum(turn + 1, n - 1)] > symbols[turn]
    direct = rises | (symbols == 0)
    # what a wanted place is induced through: all up to the next one that is sorted directly
    stops = np.flatnonzero(direct)
    where = np.flatnonzero(wanted)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, where, 1)
    np.add.at(mark, stops[np.minimum(np.searchsorted(stops, where), len(stops) - 1)] + 1, -1)
    needed = np.cumsum(mark[:-1]) > 0
    induced = needed & ~direct
    sorted_ = _sorted_directly(np.flatnonzero(needed & direct), eights, width)
    begin = np.searchsorted(symbols[sorted_], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waves = [wave]
        while len(wave):  # runs of one symbol: each induces the one before it
            before = wave[wave > 0] - 1
            wave = before[induced[before] & (symbols[before] == c)]
            waves.append(wave)
        bucket = np.concatenate([*waves, sorted_[begin[c] : begin[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before]]
        first = symbols[before]
        before, first = before[first > c], first[first > c]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        for d in np.unique(first).tolist():
            waiting[d].append(before[np.searchsorted(first, d) : np.searchsorted(first, d, "right")])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(order: np.ndarray, eights: np.ndarray, width: int) -> np.ndarray:
    """How many symbols each suffix shares with the next one, up to ``width``."""
    lcp = np.zeros(max(0, len(order) - 1), np.int64)
    left = np.arange(len(lcp))
    for depth in range(0, width, 8):
        x = eights[np.minimum(order[left] + depth, len(eights) - 1)] ^ eights[np.minimum(order[left + 1] + depth, len(eights) - 1)]
        high = np.zeros(len(x), np.int64)  # equal symbols at the front of the eight
        for i in range(1, 9):
            high += (x >> np.uint64(8 * (8 - i))) == 0
        lcp[left] = depth + high
        left = left[high == 8]
        if not len(left):
            break
    return np.minimum(lcp, width)


def repeated_starts(pieces: list[bytes], counts: list[int], width: int) -> list[np.ndarray]:
    """For each piece, which of its starts are repeated, as [low, high, low, high ...]."""
    sizes = np.array([len(p) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    # no UTF-8 text has a byte over 0xF4, so one more than a byte still is one
    symbols = np.zeros(begin[-1] + width + 8, np.uint8)
    for p, a in zip(pieces, begin.tolist()):
        symbols[a : a + len(p)] = np.frombuffer(p, np.uint8) + np.uint8(1)
    wanted = np.zeros(len(symbols), bool)
    for a, n in zip(begin.tolist(), (sizes - width + 1).tolist()):
        wanted[a : a + n] = True
    eights = _eights(symbols)
    order = suffix_order(symbols, wanted, width, eights)
    same = np.flatnonzero(common_prefixes(order, eights, width) >= width)
    found = np.zeros(len(symbols), bool)
    found[order[same]] = found[order[same + 1]] = True
    out = []
    for a, n, times in zip(begin.tolist(), (sizes - width + 1).tolist(), counts):
        if times > 1:
            out.append(np.array([0, n - 1]))
            continue
        edge = np.diff(np.concatenate([[0], found[a : a + n].astype(np.int8), [0]]))
        out.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], 1).ravel())
    return out


_FOUND = "anchor long, digest long, spans array<int>"


def _sort_groups(width: int):
    """Repeated starts of pieces that come sorted by anchor and digest."""

    def run(batches):
        held: dict[tuple[int, int], tuple[bytes, int]] = {}
        size, last = 0, None

        def found():
            spans = repeated_starts([p for p, _ in held.values()], [n for _, n in held.values()], width)
            some = [(k, s) for k, s in zip(held, spans) if len(s)]
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in some], pa.int64()), pa.array([k[1] for k, _ in some], pa.int64()), pa.array([s.tolist() for _, s in some], pa.list_(pa.int32()))], ["anchor", "digest", "spans"])

        for batch in batches:
            for anchor, digest, n, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor != last and size >= SORT_BYTES:
                    yield found()
                    held.clear()
                    size = 0
                last = anchor
                if (anchor, digest) not in held:
                    held[(anchor, digest)] = (piece, n)
                    size += len(piece)
        if held:
            yield found()

    return run


# -- the operator --------------------------------------------------------------


def _given_out(width: int):
    """The wanted pieces of texts, as (anchor, digest, n, piece); a text once a task."""

    def run(batches):
        seen: set[bytes] = set()
        for part in slices(batches, "text"):
            out: list[tuple] = []
            for key, wanted, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                if key in seen:
                    continue
                seen.add(key)
                view = memoryview(text.as_buffer())
                for w in wanted:
                    start, starts = w["place"] >> 16, w["place"] & 0xFFFF
                    out.append((w["anchor"], w["digest"], w["n"], bytes(view[start : start + starts + width - 1])))
                if len(out) >= 8192:
                    yield _given(out)
                    out = []
            yield _given(out)

    return run


def _given(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["anchor", "digest", "n", "piece"])


def _repeats(cut: DataFrame, fetch: Callable[[DataFrame], DataFrame], width: int, level: int) -> DataFrame:
    """(row, spans): the repeated starts of texts that are cut already.

    ``fetch`` gives (key, wanted, text) for a table of (row, wanted).
    """
    since = staged_so_far(cut.sparkSession)
    pieces = cut.filter("anchor is not null").select("row", "place", "anchor", "digest", "n")
    common = staged(pieces.groupBy("anchor").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_rows")).filter("total > 1"), "anchors")
    met = staged(keyed_join(pieces, common.select("anchor"), ["anchor"], hot_keys(common, ["anchor"], "n_rows", HOT_ANCHOR)), "met-pieces")
    # first() of both comes from one row
    different = met.groupBy("anchor", "digest").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_rows"), F.first("row").alias("row"), F.first("place").alias("place"))
    different = staged(different, "different")
    large = different.groupBy("anchor").agg(F.count(F.lit(1)).alias("pieces")).filter(F.col("pieces") > PIECES_AN_ANCHOR)
    large = staged(large if level < len(ANCHORS) - 1 else large.limit(0), "large-anchors")
    wanted = different.select("row", F.struct("place", "anchor", "digest", "n").alias("w")).groupBy("row").agg(F.collect_list("w").alias("wanted"))
    given = fetch(wanted).transform(arrow_map, _given_out(width), "anchor long, digest long, n long, piece binary")
    if not large.head(1):
        found = _sorted_pieces(given, width)
    else:
        given = staged(given, "given")
        listed = F.broadcast(large) if fits_broadcast(large, BROADCAST_ROWS) else large
        found = _sorted_pieces(given.join(listed, "anchor", "left_anti"), width)
        again = keyed_join(given, large.select("anchor"), ["anchor"], hot_keys(large, ["anchor"], "pieces")).dropDuplicates(["anchor", "digest"])
        again = staged(again.select(F.monotonically_increasing_id().alias("row"), "anchor", "digest", "n", "piece"), "again")
        finer = _cut_texts(again.select("row", F.col("n").alias("copies"), F.lit(None).cast("long").alias("doc_id"), F.col("piece").alias("text")), width, level + 1)

        def pieces_again(wanted: DataFrame) -> DataFrame:
            return again.join(wanted, "row").select(F.col("row").cast("string").cast("binary").alias("key"), "wanted", F.col("piece").alias("text"))

        spans = _repeats(finer, pieces_again, width, level + 1)
        found = found.unionByName(again.select("row", "anchor", "digest").join(spans, "row").select("anchor", "digest", "spans"))
    found = staged(found, "found")
    starts = keyed_join(met, found, ["anchor", "digest"], hot_keys(different, ["anchor", "digest"], "n_rows"))
    starts = starts.select("row", F.transform("spans", lambda s: (s + F.shiftright("place", 16)).cast("int")).alias("spans"))
    known = cut.filter("known is not null").select("row", F.col("known").alias("spans"))
    out = staged(starts.unionByName(known).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    clear_scratch(cut.sparkSession, since, [out])
    return out


def _sorted_pieces(given: DataFrame, width: int) -> DataFrame:
    return given.repartition("anchor").sortWithinPartitions("anchor", "digest").transform(arrow_map, _sort_groups(width), _FOUND)


def _kept(width: int):
    """(sha, n_removed, n_spans, kept_sha256) of texts with their repeated starts; a text once a task."""

    def run(batches):
        seen: set[bytes] = set()
        for part in slices(batches, "text"):
            rows = []
            for key, spans, text in zip(part.column(0).to_pylist(), part.column(1), part.column(2)):
                if key in seen:
                    continue
                seen.add(key)
                view = memoryview(text.as_buffer())
                pairs = spans.values.to_numpy().astype(np.int64).reshape(-1, 2)
                low, high = merged(pairs[:, 0], pairs[:, 1] + width - 1)
                left = hashlib.sha256()
                at = 0
                for a, b in zip(low.tolist(), high.tolist()):
                    left.update(view[at:a])
                    at = b + 1
                left.update(view[at:])
                rows.append((key, int((high - low + 1).sum()), len(low), left.hexdigest()))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["sha", "n_removed", "n_spans", "kept_sha256"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null as empty; matches never cross documents.  Each
    byte goes that is covered by a string of ``width`` bytes which also starts
    anywhere else, in the same text or another, overlaps included; strings are
    judged on the input.  ``n_spans`` counts the maximal runs that go.  Texts
    shorter than ``width`` stay as they are; of repeated rows each counts, so
    long ones go wholly.  Rows keep their ids, null or shared.  An empty table
    gives an empty result; other columns are not read.  ``docs`` is read again
    for the pieces and the results, so it should be stored.
    """
    spark = docs.sparkSession
    since = staged_so_far(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    cut = _cut_texts(texts.select(F.monotonically_increasing_id().alias("row"), F.lit(1).cast("long").alias("copies"), "doc_id", "text"), width, 0)
    rows = staged(cut.filter("sha is not null").select("row", "doc_id", "n_bytes", "sha"), "rows")
    by_sha = staged(rows.filter(F.col("n_bytes") >= width).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row")), "texts")
    hot = hot_keys(by_sha, ["sha"])
    text = texts.select(F.unhex(F.sha2("text", 256)).alias("sha"), "text")

    def with_text(wanted: DataFrame) -> DataFrame:
        """(sha, wanted, text) for a table of (sha, wanted) with a row a text."""
        return keyed_join(text, wanted, ["sha"], hot).select("sha", "wanted", "text")

    def fetch(wanted: DataFrame) -> DataFrame:
        return with_text(wanted.join(rows.select("row", "sha"), "row").groupBy("sha").agg(F.flatten(F.collect_list("wanted")).alias("wanted")))

    spans = _repeats(cut, fetch, width, 0)
    remove(spark, cut.staged_at)
    single = by_sha.filter("n = 1").join(spans, "row").select("sha", F.col("spans").alias("wanted"))
    judged = with_text(single).transform(arrow_map, _kept(width), "sha binary, n_removed long, n_spans long, kept_sha256 string")
    info = staged(by_sha.select("sha", "n").join(judged, "sha", "left"), "judged")
    clear_scratch(spark, since, [rows, info])
    nothing = hashlib.sha256(b"").hexdigest()
    copied, own = F.col("n") > 1, F.lower(F.hex("sha"))
    removed = F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    runs = F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long")
    kept = F.when(copied, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", own))
    long_texts = keyed_join(rows.filter(F.col("n_bytes") >= width), info, ["sha"], hot).select("doc_id", "n_bytes", removed.alias("n_removed"), runs.alias("n_spans"), kept.alias("kept_sha256"))
    zero = F.lit(0).cast("long")
    short = rows.filter(F.col("n_bytes") < width).select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), own.alias("kept_sha256"))
    return long_texts.unionByName(short)
