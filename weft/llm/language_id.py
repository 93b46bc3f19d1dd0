"""Language identification by cross-parsing entropy.

For each language, the suffix automaton of a sample of its labelled text gives
the longest match at any place of a new text.  Parsing the text greedily into
such matches, the language that needs fewest phrases, normalised by its
logarithmic cost, is the prediction: a phrase found in n characters of sample
costs about ``log2(n)`` bits.

The transitions of all automata share one array of displaced rows, as large as
there are transitions whatever the alphabet, so all texts of an Arrow batch are
parsed in step with array operations.  Long texts are parsed whole, in pieces
that are put right where a phrase spans two of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.shared import arrow_map, slices

#: The fit reads at most so many documents a language, and keeps so many characters of them.
SAMPLE_DOCUMENTS = 400
SAMPLE_CHARS = 30_000
#: A label set beyond this is an error, not a cut.
MAX_LANGUAGES = 256
#: Characters that are parsed in one piece.
BLOCK = 2048
#: How often all pieces are parsed again at once before what is left is put right from the front.
GUESSES = 2
#: Bytes of text that are parsed at once.
SLICE = 2 << 20
UNKNOWN = "und"


def suffix_automaton(text: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """(transitions, suffix links) of the automaton of all substrings of ``text``."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                split = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = split
                    p = link[p]
                link[q] = link[new] = split
        last = new
    return moves, link


@dataclass(frozen=True)
class Sample:
    """What is learned: languages, their sample texts, and all characters of these."""

    languages: tuple[str, ...]
    texts: tuple[str, ...]
    symbols: str


def displaced(moves: list[dict[int, int]], base: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, number of each state): the move of state s by c, if any, is in cell ``s + c``.

    A cell holds its state's number in the upper half and the next state's in
    the lower.  Numbers start at ``base + 1`` and differ, so a cell of another
    state is told by the upper half.  States with several moves are interleaved
    in order of size; those with one fill the gaps.  A state with none gets 0.
    """
    width = max((max(out) for out in moves if out), default=0)
    at = np.zeros(len(moves), np.int64)
    taken, d = bytearray(width + 1), 0
    for state in sorted((s for s, out in enumerate(moves) if len(out) > 1), key=lambda s: -len(moves[s])):
        d += 1
        taken.extend(bytes(max(0, d + 2 * width + 1 - len(taken))))
        while any(taken[d + c] for c in moves[state]):
            d += 1
            if len(taken) <= d + width:
                taken.extend(bytes(width + 1))
        for c in moves[state]:
            taken[d + c] = 1
        at[state] = d
    ones: dict[int, list[int]] = {}
    for state, out in enumerate(moves):
        if len(out) == 1:
            ones.setdefault(next(iter(out)), []).append(state)
    size = len(taken) + width + sum(map(len, ones.values())) + 1
    free, unused = np.ones(size, bool), np.ones(size, bool)
    free[: len(taken)] = np.frombuffer(bytes(taken), np.uint8) == 0
    unused[at] = False  # and 0
    for c, states in ones.items():
        while len(found := np.flatnonzero(free[c:] & unused[: len(unused) - c])) < len(states):
            free, unused = (np.concatenate([x, np.ones(len(states) + width, bool)]) for x in (free, unused))
        at[states] = found[: len(states)]
        unused[at[states]], free[at[states] + c] = False, False
    number = np.where(at > 0, at + base, 0)
    cells = np.zeros(int(at.max(initial=0)) + width + 1, np.int64)
    for state, out in enumerate(moves):
        for c, to in out.items():
            cells[at[state] + c] = number[state] << 32 | number[to]
    return cells, number


@lru_cache(maxsize=2)
def _tables(sample: Sample):
    """(cells of all automata, state after a first character by language and symbol, cost of a phrase, symbol of each code point).

    The last state has no moves: the one after a character that matches nothing.
    """
    code = {ord(c): i + 1 for i, c in enumerate(sample.symbols)}  # 0: in no sample
    known = np.zeros(0x110000, np.int32)
    known[list(code)] = list(code.values())
    parts, firsts, base = [], [], 0
    for text in sample.texts:
        moves, _ = suffix_automaton([code[ord(c)] for c in text])
        cells, number = displaced(moves, base)
        first = np.zeros(len(code) + 1, np.int64)
        for c, to in moves[0].items():
            first[c] = number[to] or -1
        parts.append(cells)
        firsts.append(first)
        base += len(cells)
    dead = base + 1
    cells = np.concatenate([*parts, np.zeros(len(code) + 2, np.int64)])
    owner, to = cells >> 32, cells & 0xFFFFFFFF
    cells[(owner > 0) & (to == 0)] |= dead  # the last state of an automaton
    first = np.array(firsts, np.int64)
    first[first <= 0] = dead
    cost = np.log2([max(2, len(t)) for t in sample.texts])
    return cells, first, cost, known


def phrases(sample: Sample, texts: list[str]) -> np.ndarray:
    """Phrases that each language (column) needs for each text (row), whole.

    Long texts are parsed in pieces, all of them in step.  A piece is first
    parsed as if a phrase began with it, and then again from the state in which
    the piece before it really ended, up to where both parses agree.
    """
    cells, first_state, _, known = _tables(sample)
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = known[joined]
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    pieces = -(-lengths // BLOCK)
    doc = np.repeat(np.arange(len(texts)), pieces)
    number = np.arange(len(doc)) - (np.cumsum(pieces) - pieces)[doc]  # of the piece in its text
    size = np.minimum(BLOCK, lengths[doc] - number * BLOCK)
    begin = starts[doc] + number * BLOCK
    out = np.zeros((len(texts), len(first_state)), np.int64)
    if not len(doc):
        return out
    dead = len(cells) - len(sample.symbols) - 1

    def moved(lang, now, c):
        """(states after the characters, whether a phrase began with them)."""
        move = cells.take(now + c)
        broken = move >> 32 != now  # no match goes on: a phrase ends, and the next begins with this character
        return np.where(broken, first_state[lang, c], move & 0xFFFFFFFF), broken

    order = np.argsort(-size, kind="stable")  # so that the pieces still open come first
    lang = np.arange(len(first_state))[:, None]
    state = np.full((len(first_state), len(doc)), dead, np.int64)
    count = np.zeros(state.shape, np.int32)
    for step in range(int(size.max())):
        n = int(np.searchsorted(-size[order], -step, "left"))  # pieces longer than step
        state[:, :n], broken = moved(lang, state[:, :n], symbol[begin[order[:n]] + step])
        count[:, :n] += broken
    back = np.argsort(order)
    state, count = state[:, back], count[:, back]
    entry = np.full(state.shape, dead, np.int64)  # the state that a piece was parsed from

    def parsed_again(k: np.ndarray, p: np.ndarray, now: np.ndarray) -> None:
        """Parse pieces from other states, in step with their last parse, up to where both agree."""
        was, entry[k, p] = entry[k, p], now
        open_ = np.ones(len(k), bool)
        for step in range(BLOCK):
            here = np.flatnonzero(open_)
            if not len(here):
                break
            c = symbol[begin[p[here]] + step]
            was[here], old = moved(k[here], was[here], c)
            now[here], new = moved(k[here], now[here], c)
            count[k[here], p[here]] += new.astype(np.int32) - old
            ended = size[p[here]] == step + 1
            last = here[ended]
            state[k[last], p[last]] = now[last]
            open_[here] = ~ended & (was[here] != now[here])

    for _ in range(GUESSES):  # in prose nearly all parses agree soon
        k, p = np.nonzero((number[1:] > 0) & (entry[:, 1:] != state[:, :-1]))
        if not len(k):
            break
        parsed_again(k, p + 1, state[k, p])
    _walked(number, symbol, begin, size, entry, state, count, parsed_again)
    for k in range(len(first_state)):
        out[:, k] = np.bincount(doc, count[k], len(texts))
    return out


def _walked(number: np.ndarray, symbol: np.ndarray, begin: np.ndarray, size: np.ndarray, entry: np.ndarray, state: np.ndarray, count: np.ndarray, parsed_again) -> None:
    """Put right what is left after the guesses, text by text from the front.

    In texts that repeat themselves parses may never agree, but pieces with the
    same characters, parsed from the same state, end alike: each such parse is
    done once, so the work grows with the text however long it goes on.
    """
    known: dict[tuple, tuple[int, int]] = {}
    content: dict[bytes, int] = {}
    ids: dict[int, int] = {}
    k, p = np.nonzero((number[1:] > 0) & (entry[:, 1:] != state[:, :-1]))
    ends = np.append(np.flatnonzero(number == 0)[1:], len(number))  # of each text's pieces
    walks = {(lang, int(ends[np.searchsorted(ends, piece + 1, "right")])): None for lang, piece in zip(k.tolist(), p.tolist())}
    for lang, piece in zip(k.tolist()[::-1], p.tolist()[::-1]):
        walks[(lang, int(ends[np.searchsorted(ends, piece + 1, "right")]))] = piece + 1
    while walks:
        waiting: dict[tuple, tuple[int, int]] = {}
        for (lang, end), piece in list(walks.items()):
            while piece < end:
                now = int(state[lang, piece - 1])
                if entry[lang, piece] != now:
                    if piece not in ids:
                        ids[piece] = content.setdefault(symbol[begin[piece] : begin[piece] + size[piece]].tobytes(), len(content))
                    key = (lang, ids[piece], now)
                    if key not in known:
                        waiting.setdefault(key, (piece, now))
                        break
                    entry[lang, piece] = now
                    state[lang, piece], count[lang, piece] = known[key]
                piece += 1
            if piece < end:
                walks[(lang, end)] = piece
            else:
                del walks[(lang, end)]
        if waiting:
            langs = np.array([key[0] for key in waiting])
            pieces, now = (np.array(x) for x in zip(*waiting.values()))
            parsed_again(langs, pieces, now.copy())
            for key, piece in zip(waiting, pieces.tolist()):
                known[key] = (int(state[key[0], piece]), int(count[key[0], piece]))


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", order_col: str = "doc_id", sample_documents: int = SAMPLE_DOCUMENTS, sample_chars: int = SAMPLE_CHARS) -> Sample:
    """Learn from a bounded, hash-drawn sample of the rows that have a label and text.

    Documents are drawn by hash of their id and text; each gives at most
    ``4 * sample_chars / sample_documents`` characters of the sample, from a
    place anywhere in it that a hash of its id and text draws.
    """
    each = max(1, 4 * sample_chars // sample_documents)
    text = F.col(text_col).cast("string")
    place = F.pmod(F.xxhash64(F.lit("place"), F.col(order_col), text), F.greatest(F.lit(1), F.length(text) - each + 1)).cast("int") + 1
    known = labelled.filter(F.col(lang_col).isNotNull() & (F.length(text) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit("language"), F.col(order_col), text).alias("draw"), F.substring(text, place, F.lit(each)).alias("piece"))
    # of one language, the smallest draws: found by threshold from its count, so that no task orders a language
    totals = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not totals:
        return Sample((), (), "")
    share = F.create_map(*[x for lang, n in totals.items() for x in (F.lit(lang), F.lit(min(1.0, 2.0 * sample_documents / n)))])
    drawn = known.filter((F.shiftrightunsigned("draw", 11) / float(1 << 53)) < share[F.col("lang")]).collect()
    texts = {}
    for lang in sorted(totals):
        rows = sorted((r.draw, r.piece) for r in drawn if r.lang == lang)[:sample_documents]
        texts[lang] = "\n".join(r[1] for r in rows)[:sample_chars]
    texts = {k: v for k, v in texts.items() if v}
    symbols = "".join(sorted(set().union(*texts.values())))
    return Sample(tuple(texts), tuple(texts.values()), symbols)


def judged(sample: Sample, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, bits a character) of each text; see ``predict``."""
    lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    texts = pc.fill_null(column, "").to_pylist()
    if not sample.languages or not texts:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    cost = phrases(sample, texts) * _tables(sample)[2]
    best = cost.argmin(1)
    low = cost[np.arange(len(texts)), best]
    rest = cost.copy()
    rest[np.arange(len(texts)), best] = np.inf
    second = rest.min(1)
    score = np.where(lettered & (second > 0), 1 - low / np.maximum(second, 1e-9), 0.0) if cost.shape[1] > 1 else lettered.astype(float)
    rate = low / np.maximum(1, [len(t) for t in texts])
    pred = [sample.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())]
    return pred, np.clip(score, 0, 1), np.where(lettered, rate, 0.0)


def predict(docs: DataFrame, sample: Sample, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_a_char) of each row.

    ``und`` with score 0 where the text is null or empty, has no letter, or
    nothing was learned; of equal costs the language first by name wins.
    ``score`` is how much cheaper the best language is than the next, 0 to 1.
    Other columns are not read; repeated rows give repeated results.
    """

    def run(batches):
        for part in slices(batches, "text", SLICE):
            pred, score, rate = judged(sample, part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(rate)], ["doc_id", "lang_pred", "score", "bits_a_char"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(arrow_map, run, f"doc_id {kind}, lang_pred string, score double, bits_a_char double")


def with_known_language(docs: DataFrame, sample: Sample, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that have no letter, all columns kept.

    Every whole text is parsed, and the label column holds the prediction of
    ``predict``, whatever label the row came with.  Where nothing was learned,
    rows with a letter stay and their label is ``und``.
    """

    def run(batches):
        for part in slices(batches, text_col, SLICE):
            part = part.filter(pc.fill_null(pc.match_substring_regex(part.column(part.schema.get_field_index(text_col)), r"\p{L}"), False))
            if not part.num_rows:
                continue
            pred, _, _ = judged(sample, part.column(part.schema.get_field_index(text_col)))
            at = part.schema.get_field_index(lang_col)
            yield part.set_column(at, part.schema.field(at), pa.array(pred, part.schema.field(at).type))

    return docs.transform(arrow_map, run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """The third of the documents that is never learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for all of ``docs``, learned from
    the labelled documents that are not held out."""
    sample = fit(docs.filter(~held_out()))
    return predict(docs, sample).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_a_char")
