"""Licence statements in texts: notice phrases, identifier tags and the expressions behind the tags.

A batch's texts are lowered (A-Z) and reduced to words with one space between them, on the byte buffer as a whole. An
Aho-Corasick automaton finds all notice phrases and identifier tags of a text in one pass over its words. Behind a tag
the text itself is read: a shunting-yard parser takes the longest prefix that is a whole expression of licence ids with
``and``, ``or``, ``with`` and parentheses, and the expression is evaluated on the way: ``with`` loosens a licence by an
exception, ``and`` asks for all obligations, ``or`` leaves the choice of the lightest.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import fresh, in_tasks, text_or_empty

# --- Fixed values -----------------------------------------------------------------

# phrases whose places are counted
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# notice phrases that only add labels
NOTICE_PHRASES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "apache license version 2 0": "apache-2.0",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "boost software license": "bsl",
    "isc license": "isc",
    "zlib license": "zlib",
    "artistic license": "artistic",
    "bsd license": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the software is provided as is without warranty of any kind express or implied": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
}
# words of tags behind which an expression stands; a weak tag counts only before a known licence id
TAGS = {"spdx license identifier": "strong", "license expression": "weak", "license": "weak", "licence": "weak"}

# beginnings of licence ids, with their label and how much they restrict: 1 permissive, 2 weak or 3 strong copyleft,
# 4 copyleft over networks or restricted use; the longest beginning counts
LICENSES = {
    "0bsd": ("bsd", 1),
    "afl": ("afl", 1),
    "agpl": ("agpl", 4),
    "apache": ("apache", 1),
    "artistic": ("artistic", 2),
    "bsd": ("bsd", 1),
    "bsl": ("bsl", 1),
    "cc0": ("cc0", 1),
    "cc-by": ("cc-by", 1),
    "cc-by-sa": ("cc-by-sa", 3),
    "cc-by-nd": ("cc-by-nd", 4),
    "cc-by-nc": ("cc-by-nc", 4),
    "cc-by-nc-sa": ("cc-by-nc-sa", 4),
    "cc-by-nc-nd": ("cc-by-nc-nd", 4),
    "cddl": ("cddl", 2),
    "epl": ("epl", 2),
    "eupl": ("eupl", 3),
    "gfdl": ("gfdl", 3),
    "gpl": ("gpl", 3),
    "isc": ("isc", 1),
    "lgpl": ("lgpl", 2),
    "mit": ("mit", 1),
    "mpl": ("mpl", 2),
    "ofl": ("ofl", 1),
    "osl": ("osl", 4),
    "postgresql": ("postgresql", 1),
    "psf": ("psf", 1),
    "python": ("psf", 1),
    "unlicense": ("unlicense", 1),
    "wtfpl": ("wtfpl", 1),
    "zlib": ("zlib", 1),
}

UNKNOWN_RESTRICTION = 4
STRICTEST = 4
BYTES_AT_ONCE = 1 << 21  # of texts, unless a single one is longer
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


# --- Expressions ------------------------------------------------------------------


@dataclass(frozen=True)
class Terms:
    """What an expression says: all labels, the labels left when choices are taken, how much that restricts."""

    labels: frozenset[str]
    chosen: frozenset[str]
    restriction: int


LONGEST_BEGINNING = max(map(len, LICENSES))


def terms_of(identifier: str) -> Terms:
    """A single licence id, by its longest known beginning before a hyphen, a digit, a sign or the end."""
    return _terms_of(identifier[: LONGEST_BEGINNING + 1])


@lru_cache(maxsize=4096)
def _terms_of(name: str) -> Terms:
    for end in range(min(len(name), LONGEST_BEGINNING), 1, -1):
        known = LICENSES.get(name[:end])
        if known and not name[end : end + 1].isalpha():
            label = frozenset([known[0]])
            return Terms(label, label, known[1])
    return Terms(frozenset(), frozenset(), UNKNOWN_RESTRICTION)


def applied(operator: str, left: Terms, right: Terms) -> Terms:
    """``with`` takes one step of restriction off, ``and`` keeps the stricter, ``or`` takes the lighter side."""
    if operator == "with":
        return Terms(left.labels, left.chosen, max(left.restriction - 1, 1))
    labels = left.labels | right.labels
    if operator == "and":
        return Terms(labels, left.chosen | right.chosen, max(left.restriction, right.restriction))
    lighter = min(left, right, key=lambda t: t.restriction)
    return Terms(labels, lighter.chosen, lighter.restriction)


class ShuntingYard:
    """Operators wait on a stack until one that binds no closer, a closing parenthesis or the end releases them."""

    def __init__(self):
        self.operands: list[Terms] = []
        self.operators: list[str] = []

    def release(self, least: int) -> None:
        while self.operators and self.operators[-1] != "(" and PRECEDENCE[self.operators[-1]] >= least:
            right, left = self.operands.pop(), self.operands.pop()
            self.operands.append(applied(self.operators.pop(), left, right))

    def take(self, token: str) -> None:
        if token == "(":
            self.operators.append(token)
        elif token == ")":
            self.release(1)
            self.operators.pop()
        elif token in PRECEDENCE:
            self.release(PRECEDENCE[token])
            self.operators.append(token)
        else:
            self.operands.append(terms_of(token))

    def result(self) -> Terms:
        self.release(1)
        return self.operands[-1]


TOKEN = re.compile(r"[ \t]*(?:([()])|([a-z0-9][a-z0-9.+-]*))")


def read_expression(text: str, known_only: bool = False) -> tuple[list[str], int]:
    """Tokens of the longest prefix of ``text`` that is a whole expression, and where it ends.

    The text is in lower case. A sign outside the grammar ends the prefix, and so does an id after an id, the full
    stop of a sentence and, with ``known_only``, an id without a label. ``with`` stands between a licence id and the
    name of an exception. No tokens when no prefix is whole.
    """
    tokens: list[str] = []
    at, whole, end, depth, wants_id = 0, 0, 0, 0, True
    while match := TOKEN.match(text, at):
        token = match.group(1) or match.group(2).rstrip(".")
        exception = tokens[-1:] == ["with"]
        if token == "(":
            fits = wants_id and not exception
            depth += 1
        elif token == ")":
            fits = not wants_id and depth > 0
            depth -= 1
        elif token in PRECEDENCE:
            after_id = tokens[-1:] != [")"] and tokens[-2:-1] != ["with"]
            fits = not wants_id and (token != "with" or after_id)
            wants_id = True
        else:
            named = exception or not known_only or bool(terms_of(token).labels)
            fits = wants_id and named and token.replace("-", " ") not in TAGS
            wants_id = False
        if not fits:
            break
        tokens.append(token)
        at = match.start(match.lastindex) + len(token)
        if not wants_id and not depth:
            whole, end = len(tokens), at
        if at < match.end():
            break
    return tokens[:whole], end


@dataclass(frozen=True)
class Expression:
    text: str
    terms: Terms


def evaluate(tokens: list[str]) -> Expression:
    """A whole expression, as ``read_expression`` gives it."""
    yard = ShuntingYard()
    for token in tokens:
        yard.take(token)
    return Expression(" ".join(tokens).replace("( ", "(").replace(" )", ")"), yard.result())


def parse(text: str) -> Expression | None:
    """The expression that ``text`` is as a whole, else none."""
    lowered = text.lower().strip()
    tokens, end = read_expression(lowered)
    return evaluate(tokens) if tokens and end == len(lowered) else None


# --- Texts ------------------------------------------------------------------------

WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[ord("0") : ord("9") + 1] = True
WORD_BYTE[ord("a") : ord("z") + 1] = True
WORD_BYTE[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
EXPRESSION_BYTE = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789.+-() \t"))
# between a tag and its expression: quotes, one sign that names a value, spaces
TAG_END = re.compile(rb"""["']?[ \t]{0,8}[:=>][ \t]{0,8}["']?""")
TAG_END_BYTES = 20


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All phrases and tags, each with a space before and behind: they only match whole words."""
    kinds: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICE_PHRASES), ("tag", TAGS)):
        for phrase, value in phrases.items():
            kinds.setdefault(phrase, []).append((kind, value))
    found = ahocorasick.Automaton()
    for phrase, uses in kinds.items():
        found.add_word(f" {phrase} ", (len(phrase), uses))
    found.make_automaton()
    return found


@dataclass
class Words:
    """Texts as lowered bytes and as words between single spaces, with the way back.

    In ``raw`` every row stands between two line breaks of its own, which are spaces in ``text``, so nothing spans
    rows. ``source[k]`` is the place in ``raw`` of byte k of ``text``.
    """

    raw: np.ndarray
    text: bytes
    source: np.ndarray
    word_starts: np.ndarray  # places in text where words begin
    row_starts: np.ndarray  # places in text where rows begin, and the end
    stops: np.ndarray  # places in raw that no expression can hold


def words_of(texts: pa.Array) -> Words:
    encoded = texts.cast(pa.large_binary())
    offsets = np.frombuffer(encoded.buffers()[1], dtype=np.int64)[encoded.offset : encoded.offset + len(encoded) + 1]
    data = np.frombuffer(encoded.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    rows = offsets - offsets[0] + 2 * np.arange(len(offsets))  # the line break before each row, and the end
    raw = np.full(rows[-1], ord("\n"), dtype=np.uint8)
    inside = np.ones(len(raw), dtype=bool)
    inside[rows[:-1]] = inside[rows[1:] - 1] = False
    raw[inside] = LOWER[data]
    word = WORD_BYTE[raw]
    before = np.append(False, word[:-1])
    kept = np.flatnonzero(word | before | ~inside)
    chars = np.where(word[kept], raw[kept], np.uint8(ord(" ")))
    word_starts = np.flatnonzero((word & ~before)[kept])
    return Words(
        raw, chars.tobytes(), kept, word_starts, np.searchsorted(kept, rows), np.flatnonzero(~EXPRESSION_BYTE[raw])
    )


@dataclass
class Statement:
    """What a text says about licences."""

    base: list[tuple[int, str]] = field(default_factory=list)  # first byte in the words' text, label
    notices: set[str] = field(default_factory=set)
    expressions: set[Expression] = field(default_factory=set)

    def spoken(self) -> set[str]:
        return {label for e in self.expressions for label in e.terms.labels}


def tagged(words: Words, end: int, strength: str) -> Expression | None:
    """The expression behind a tag whose last byte in the words' text is ``end - 1``.

    What is read ends at the first sign that no expression holds. Every tag is followed by such a sign, so tags never
    read beyond each other.
    """
    at = int(words.source[end - 1]) + 1
    gap = TAG_END.match(words.raw[at : at + TAG_END_BYTES].tobytes())
    if not gap:
        return None
    at += gap.end()
    stop = words.stops[np.searchsorted(words.stops, at)]  # the last row ends in a line break
    tokens, _ = read_expression(words.raw[at:stop].tobytes().decode("ascii"), known_only=strength == "weak")
    return evaluate(tokens) if tokens else None


def statements(words: Words) -> dict[int, Statement]:
    """Row number to what its text says; rows without any statement are left out."""
    found: dict[int, Statement] = {}
    starts = words.row_starts.tolist()
    # one character a byte, so places agree
    for last, (length, uses) in automaton().iter(words.text.decode("latin-1")):
        first = last - length  # the phrase's first character; one space stands behind its last
        row = bisect_right(starts, first) - 1
        said = found.setdefault(row, Statement())
        for kind, value in uses:
            if kind == "base":
                said.base.append((first, value))
            elif kind == "notice":
                said.notices.add(value)
            elif expression := tagged(words, last, value):
                said.expressions.add(expression)
    return found


def score_of(said: Statement, labels: set[str]) -> float:
    """The strictest statement's restriction as a share of the strictest possible; 0 without a statement.

    An expression counts with the choice it leaves; a phrase counts with its label's restriction, unless an expression
    of the text speaks about that label already.
    """
    levels = [e.terms.restriction for e in said.expressions]
    levels += [terms_of(label).restriction for label in labels - said.spoken()]
    return max(levels, default=0) / STRICTEST


RESULT = [
    ("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"),
    ("labels", "string"), ("score", "double"), ("expressions", "array<string>"), ("chosen", "string"),
]


def scan(batches: Iterator[pa.RecordBatch], bytes_at_once: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Task: the text is the last column; what it says takes its place."""
    for whole in batches:
        ends = np.cumsum(pc.binary_length(whole.column(whole.num_columns - 1)).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(whole):
            done = ends[at - 1] if at else 0
            last = max(int(np.searchsorted(ends, done + bytes_at_once)), at + 1)
            yield described_batch(whole.slice(at, last - at))
            at = last


def described_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = words_of(batch.column(batch.num_columns - 1))
    before = np.searchsorted(words.word_starts, words.row_starts)  # words before each row
    said = statements(words)
    out: list[list] = [[] for _ in RESULT]
    for row in range(len(batch)):
        values = [int(before[row + 1] - before[row]), 0, None, None, "", "", 0.0, [], ""]
        if row in said:
            values[1:] = described(said[row], words, int(before[row]))
        for column, value in zip(out, values, strict=True):
            column.append(value)
    columns = [pa.array(c, type=TYPES[t]) for c, (_, t) in zip(out, RESULT, strict=True)]
    names = [*batch.schema.names[:-1], *(n for n, _ in RESULT)]
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names)


TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}


def described(said: Statement, words: Words, words_before: int) -> list:
    places = np.searchsorted(words.word_starts, [first for first, _ in said.base]) - words_before
    base = {label for _, label in said.base}
    phrases, spoken = base | said.notices, said.spoken()
    chosen = (phrases - spoken) | {label for e in said.expressions for label in e.terms.chosen}
    return [
        len(places),
        int(places.min()) if len(places) else None,
        int(places.max()) if len(places) else None,
        ",".join(sorted(base)),
        ",".join(sorted(phrases | spoken)),
        score_of(said, phrases),
        sorted(e.text for e in said.expressions),
        ",".join(sorted(chosen)),
    ]


def license_statements(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, chosen) for every row.

    ``n_words`` counts the words of the whole text; ``n_base`` the places of base phrases, ``first_word`` and
    ``last_word`` are the smallest and largest word, from 0, at which one begins (null without any). ``labels`` adds
    those of notice phrases and expressions to ``base_labels``; both are distinct, sorted and joined by commas.
    ``expressions`` are the distinct expressions behind tags in plain form, ``chosen`` the labels left after the
    lightest side of every ``or`` has been taken. ``score`` is the restriction of the strictest statement from 0
    (none) to 1. A null text is an empty one; repeated rows keep their count; further columns are ignored; a null id
    stays null. An empty table gives no rows. A text is held whole, with some twenty bytes for each byte of it.
    """
    name = fresh([n for n, _ in RESULT], id_column)
    source = docs.select(F.col(f"`{id_column}`").alias(name), text_or_empty(f"`{text_column}`").alias("text"))
    kind = source.schema[name].dataType.simpleString()
    schema = ", ".join(f"`{n}` {t}" for n, t in [(name, kind), *RESULT])
    return in_tasks(source, scan, schema)
