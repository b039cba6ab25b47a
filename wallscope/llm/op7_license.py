"""License scan: phrases and identifier tags by Aho-Corasick, expressions by shunting-yard.

Words are runs of digits, ASCII letters (lower-cased) and all characters beyond ASCII. A
document's words are joined by single spaces, and one automaton pass finds every place of
every phrase. A second automaton finds identifier tags in the text as it is written; what
follows a tag up to the end of its line is parsed with the precedence WITH > AND > OR and
evaluated against the permitted licences. ``score`` is the share of the document's words that
belong to a phrase found, or 1 if an expression was. One narrow stage, no shuffle; memory is
bounded by a slice of text, time by its length.

Defined cases: a null or empty text has no words, no labels and score 0; a tag inside a
longer word is none; an expression that does not parse gives no labels; repeated rows and
null keys are scanned like others; an empty table gives no rows; other columns are left out.
A very long text is taken on its own, in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from wallscope.llm.arrow import binary, bound_batches, slices

# Base phrases with their labels, then further notices.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd-3-clause",
    "licensed under the apache license version 2 0": "apache-2.0",
    "boost software license": "bsl-1.0",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "under the terms of the gnu general public license": "gpl",
    "artistic license": "artistic",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "do what the fuck you want to public license": "wtfpl",
    "python software foundation license": "psf",
    "sil open font license": "ofl",
    "open data commons": "odc",
    "creative commons": "cc",
    "cc0 1 0 universal": "cc0",
    "cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "attribution noncommercial": "cc-by-nc",
    "attribution sharealike": "cc-by-sa",
    "attribution noderivatives": "cc-by-nd",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
PERMITTED = frozenset({
    "0bsd", "apache-2.0", "artistic-2.0", "blueoak-1.0.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc-by-3.0",
    "cc-by-4.0", "cc0-1.0", "isc", "mit", "mit-0", "ncsa", "postgresql", "psf-2.0", "python-2.0", "unlicense",
    "upl-1.0", "wtfpl", "x11", "zlib",
})

WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
LEVEL = {"or": 1, "and": 2, "with": 3}
SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double, expressions array<string>, permitted boolean"
)


def postfix(expression: str) -> list[str]:
    """Identifiers and operators in postfix order; reading stops at what can't continue the expression."""
    out: list[str] = []
    stack: list[str] = []
    operand, at, text = True, 0, expression.strip()
    complete = 0
    while (found := TOKEN.match(text, at)) is not None:
        token = found[0]
        low = token.lower()
        if operand == (low in LEVEL or low == ")"):
            break
        if low == "(":
            stack.append(low)
        elif low == ")":
            if "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif low in LEVEL:
            while stack and stack[-1] != "(" and LEVEL[stack[-1]] >= LEVEL[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            out.append(low)
            operand = False
        at = found.end()
        while at < len(text) and text[at] in " \t":
            at += 1
        complete += 1
    if operand or "(" in stack:
        return []
    return out + stack[::-1]


def evaluate(items: list[str], permitted: frozenset[str] = PERMITTED) -> tuple[set[str], bool]:
    """Labels of a postfix expression, and whether its terms can be met with permitted licences only.

    An exception (WITH) adds permissions, so it never forbids what the licence allows.
    """
    labels: set[str] = set()
    stack: list[tuple[str, bool]] = []
    for item in items:
        if item not in LEVEL:
            stack.append((item, item in permitted))
            continue
        right, left = stack.pop(), stack.pop()
        if item == "with":
            labels |= {left[0]} - {""}
            stack.append(("", left[1]))
        else:
            labels |= {left[0], right[0]} - {""}
            stack.append(("", left[1] or right[1] if item == "or" else left[1] and right[1]))
    return labels | {s[0] for s in stack if s[0]}, bool(stack and stack[0][1])


@lru_cache(maxsize=1)
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """One for phrases in words joined by spaces, one for tags in lower-cased text."""
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, listed in (("base", BASE), ("more", NOTICES)):
        for phrase, label in listed.items():
            phrases.add_word(f" {phrase} ", (kind, label, len(phrase.split())))
    for tag in TAGS:
        tags.add_word(tag, len(tag))
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def expressions(raw: bytes) -> list[str]:
    """What stands behind each identifier tag, up to the end of its line."""
    out = []
    for end, length in automata()[1].iter(raw.translate(LOWER).decode("latin-1")):
        start = end - length + 1
        if start and WORDS[raw[start - 1]] != 32:
            continue
        stops = [at for at in (raw.find(b"\n", end), raw.find(b"\r", end)) if at >= 0]
        out.append(raw[end + 1 : min(stops, default=len(raw))].decode("utf-8", "replace").strip())
    return out


def scan_text(raw: bytes, permitted: frozenset[str]) -> tuple:
    words = raw.translate(WORDS).split()
    text = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places, base, labels = [], set(), set()
    spans, passed, at = [], 0, 0
    # Ends come in ascending order, so words are counted once.
    for end, (kind, label, size) in automata()[0].iter(text):
        passed += text.count(" ", at, end + 1)
        at = end + 1
        stop = passed - 1
        if kind == "base":
            places.append(stop - size)
            base.add(label)
        labels.add(label)
        spans.append((stop - size, stop))
    covered = reached = 0
    for start, stop in sorted(spans):
        covered += max(0, stop - max(start, reached))
        reached = max(reached, stop)
    found, allowed = [], None
    for written in expressions(raw):
        if items := postfix(written):
            more, fits = evaluate(items, permitted)
            labels |= more
            found.append(written)
            allowed = fits if allowed is None else allowed and fits
    score = 1.0 if found else covered / max(len(words), 1)
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), score, found, allowed,
    )


def scan(docs: DataFrame, permitted: frozenset[str] = PERMITTED, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per document: words, places of base phrases, labels, expressions, verdict and evidence score.

    ``permitted`` (column): whether every expression of the document can be met with permitted licences; null without one.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.bool_()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            for part in slices(batch, "text"):
                found = zip(*(scan_text(raw, permitted) for raw in binary(part.column("text")).to_pylist()))
                arrays = [pa.array(values, kind) for values, kind in zip(found, types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], [key, *names])

    source = docs.select(docs[key].alias(key), docs[column].alias("text"))
    return source.mapInArrow(run, f"`{key}` {dict(source.dtypes)[key]}, {SCHEMA}")
