"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier
tags; a shunting-yard parser evaluates licence expressions with and/or/with.

Phrases are matched on words (runs of digits, a-z after lower-casing A-Z, and
anything beyond ASCII), so punctuation and line breaks between words don't
matter.  Expressions are read from the line of their tag as written.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.shared import arrow_map, lowered, mapped, slices, text_bytes

#: Phrase of words to label; these are the base labels of a scan.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the mit license": "mit",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "mozilla public license v 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0 universal": "cc0",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
TAG_LINE = re.compile(r"(?i)spdx[-\s]license[-\s]identifier\s*:\s*([^\r\n]*)")
#: Licence families that ask for no more than notice; by the start of their identifier.
PERMISSIVE = ("mit", "apache-", "bsd-", "isc", "cc0-", "cc-by-1", "cc-by-2", "cc-by-3", "cc-by-4", "unlicense", "zlib", "bsl-1", "0bsd")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: licence expression to postfix, ``with`` binding closest,
    then ``and``, then ``or``.  ValueError where it isn't well formed."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # what must come next
    at = 0
    for m in _TOKEN.finditer(expression):
        if expression[at : m.start()].strip():
            break  # a comment's end or other text follows
        at, token = m.end(), m.group().lower()
        if token in _RANK:
            if operand:
                raise ValueError(f"operator without operand: {token}")
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        elif token == "(":
            if not operand:
                raise ValueError("parenthesis after an operand")
            held.append(token)
        elif token == ")":
            if operand:
                raise ValueError("empty parentheses or trailing operator")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError("unbalanced parenthesis")
            held.pop()
        else:
            if not operand:
                break  # prose after the expression
            out.append(token)
            operand = False
    if operand or "(" in held:
        raise ValueError("incomplete expression")
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """(identifiers, whether it can be met with permissive licences only)."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in _RANK:
            (right, r), (left, l) = stack.pop(), stack.pop()
            if token == "with":
                if len(left) != 1 or len(right) != 1:
                    raise ValueError("with stands between a licence and an exception")
                stack.append(({f"{next(iter(left))} with {next(iter(right))}"}, l))
            else:
                stack.append((left | right, l and r if token == "and" else l or r))
        else:
            stack.append(({token}, token.startswith(PERMISSIVE)))
    return stack.pop()


def scan_expressions(text: str) -> tuple[set[str], int, int, bool | None]:
    """(identifiers, valid expressions, invalid ones, all of them permissive)."""
    labels: set[str] = set()
    good = bad = 0
    permissive = None
    for m in TAG_LINE.finditer(text):
        try:
            found, ok = evaluate(to_postfix(m.group(1)))
        except ValueError:
            bad += 1
            continue
        good += 1
        labels |= found
        permissive = ok if permissive is None else permissive and ok
    return labels, good, bad, permissive


@lru_cache(maxsize=4)
def _automaton(base: tuple, notices: tuple):
    import ahocorasick

    found: dict[str, tuple] = {}
    for phrase, label in [*notices, *base]:
        found[f" {phrase} "] = (label, (phrase, label) in base)
    found[f" {TAG} "] = (None, False)
    auto = ahocorasick.Automaton()
    for phrase, value in found.items():
        auto.add_word(phrase, (len(phrase), *value))
    auto.make_automaton()
    return auto


_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_IS_WORD = _WORD.tobytes()


def normalised(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words each followed by one space, offsets of the texts in that, number of words)."""
    raw = lowered(raw)
    word = mapped(raw, _IS_WORD).view(bool)
    before = np.zeros(len(raw), bool)
    before[1:] = word[:-1]
    starts = offsets[:-1][offsets[:-1] < len(raw)]
    before[starts] = False
    keep = np.concatenate([[0], np.cumsum(word | before)])
    begun = np.concatenate([[0], np.cumsum(word & ~before)])
    return np.where(word, raw, np.uint8(32))[word | before], keep[offsets], np.diff(begun[offsets])


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_expressions long, n_invalid long, permissive boolean"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Mapping[str, str] = BASE_PHRASES, notices: Mapping[str, str] = NOTICE_PHRASES) -> DataFrame:
    """One row per document with its places, labels and licence expressions.

    ``n_base`` counts the places of base phrases, overlapping ones too;
    ``first_word`` and ``last_word`` are null without any.  ``labels`` holds
    the base labels, those of notice phrases and the identifiers of well-formed
    expressions; it is empty without any.  ``permissive`` is null without an
    expression.  ``score`` is ``1 - 2**-places``.  Null text counts as empty;
    other columns are not read; repeated rows give repeated results.
    """
    base_items, notice_items = tuple(base.items()), tuple(notices.items())

    def run(batches):
        auto = _automaton(base_items, notice_items)
        for part in slices(batches, "text"):
            raw, offsets = text_bytes(part.column(1))
            words, at, n_words = normalised(raw, offsets)
            rows = []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                places, all_labels, base_labels, tags, evidence = [], set(), set(), False, 0
                line = " " + words[a:b].tobytes().decode("utf-8", "replace") + " "
                spaces = None  # where words end, once a place asks for it
                for end, (size, label, is_base) in auto.iter(line):
                    if label is None:
                        tags = True
                        continue
                    evidence += 1
                    all_labels.add(label)
                    if is_base:
                        base_labels.add(label)
                        if spaces is None:
                            spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
                        places.append(int(np.searchsorted(spaces, end - size + 1)))
                good = bad = 0
                permissive = None
                if tags:
                    found, good, bad, permissive = scan_expressions(raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                    all_labels |= found
                rows.append((len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(all_labels)), 1 - 0.5 ** min(evidence + good, 1000), good, bad, permissive))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), *columns], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(arrow_map, run, f"doc_id {kind}, {SCHEMA}")
