"""Licence tags and notices in texts, and what licence expressions come to.

A text's words are its runs of letters, digits and characters beyond ASCII, with A-Z
in lower case. One Aho-Corasick automaton holds all notice phrases and the name of
the identifier tag, each as words between single blanks; it runs over the text's
words joined in the same way, so a hit is a place where the words stand in a row,
whatever stands between them. Where the tag's name is hit, what follows its last word and
a colon, if there is one, up to the line's end is an expression: a shunting-yard
parser brings it into postfix order and evaluates it to the identifiers named and to
whether it leaves a permissive choice (OR needs one side, AND both; WITH binds an
exception to its identifier, tightest). Hits come in the order of their ends, so that
words, and places in the text, are counted on from one hit to the next.

The score is the noisy-or of the evidence: 0.95 for a well-formed expression, 0.5 for
a broken or missing one, 0.8 for each notice phrase found, counted once each.

Defined results: a null text counts as empty and has no words; texts of any length
are scanned whole, in time that grows with their length; each row is scanned by itself; a table without rows gives none;
other columns are never read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import by_size

#: The base phrases with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases of other licences.
MORE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
TAG_VALUE = re.compile(rb"[ \t]*:?([^\r\n]*)")
WORD = re.compile(rb"[^ ]+")
TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9.+:-]+)")
FAMILIES = (
    ("mit", "mit"), ("apache", "apache"), ("agpl", "gpl"), ("lgpl", "gpl"), ("gpl", "gpl"), ("bsd", "bsd"), ("mpl", "mpl"), ("epl", "epl"),
    ("bsl", "bsl"), ("isc", "isc"), ("cc-by", "cc-by"),
)
PERMISSIVE = {"mit", "apache", "bsd", "bsl", "isc", "cc-by"}
BINDING = {"or": 1, "and": 2, "with": 3}

_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@dataclass
class Evaluated:
    labels: frozenset[str]
    permissive: bool


def family(identifier: str) -> str:
    """The label of an identifier: its family's, else itself in lower case."""
    name = identifier.lower()
    return next((label for start, label in FAMILIES if name == start or name.startswith((start + "-", start + "v", start + "+"))), name)


def postfix(text: str) -> list[str] | None:
    """A licence expression's tokens in postfix order, by the shunting-yard algorithm; null if it isn't well formed.

    What follows the expression on its line, such as a comment's end, is left out.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_due = True
    at = 0
    while (m := TOKEN.match(text, at)) is not None:
        token, low = m[1], m[1].lower()
        if low in BINDING:
            if operand_due:
                return None
            while stack and stack[-1] in BINDING and BINDING[stack[-1]] >= BINDING[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_due = True
        elif token == "(":
            if not operand_due:
                break
            stack.append(token)
        elif token == ")":
            if operand_due:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif operand_due:
            out.append(token)
            operand_due = False
        else:
            break
        at = m.end()
    if operand_due or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(text: str) -> Evaluated | None:
    """What an expression comes to; null if it isn't well formed."""
    order = postfix(text)
    if order is None:
        return None
    values: list[Evaluated] = []
    for token in order:
        if token not in BINDING:
            label = family(token)
            values.append(Evaluated(frozenset([label]), label in PERMISSIVE))
            continue
        right, left = values.pop(), values.pop()
        if token == "with":
            values.append(left)
        else:
            both = (left.permissive, right.permissive)
            values.append(Evaluated(left.labels | right.labels, any(both) if token == "or" else all(both)))
    return values[0]


def automaton(phrases: Sequence[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase in phrases:
        made.add_word(f" {phrase} ", phrase)
    made.make_automaton()
    return made


def notices(docs: DataFrame, base: dict[str, str] | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """One row for each document, with its places, labels, expressions and score.

    Phrases are words in lower case between single blanks. Texts stay where they were
    read: nothing is shuffled.
    """
    base, more = base or BASE_PHRASES, MORE_PHRASES if more is None else more
    schema = (
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "expressions array<string>, permissive boolean"
    )

    words_of = {p: p.count(" ") + 1 for p in [*base, *more, TAG]}

    def scan(machine: ahocorasick.Automaton, text: str | None) -> tuple:
        data = (text or "").encode("utf-8", "replace")
        spaced = data.translate(_WORD_BYTES)
        words = spaced.split()
        plain = " " + b" ".join(words).decode("latin-1") + " "
        places, found, tags = [], set(), []
        at, counted = 0, 0
        for end, phrase in machine.iter(plain):
            counted += plain.count(" ", at, end)
            at = end
            found.add(phrase)
            if phrase in base:
                places.append(counted - words_of[phrase])
            if phrase == TAG:
                tags.append(counted - 1)
        if not found:
            return len(words), 0, None, None, "", "", 0.0, [], None
        base_labels = {base[p] for p in found if p in base}
        labels = base_labels | {more[p] for p in found if p in more}
        doubt = 0.2 ** len(found - {TAG})
        expressions, permissive = [], None
        ends = itertools.islice((m.end() for m in WORD.finditer(spaced)), tags[-1] + 1) if tags else ()
        wanted = set(tags)
        for end in (e for i, e in enumerate(ends) if i in wanted):
            expression = TAG_VALUE.match(data, end)[1].decode("utf-8", "replace").strip()
            value = evaluate(expression)
            expressions.append(expression)
            doubt *= 0.5 if value is None else 0.05
            if value is not None:
                labels |= value.labels
                permissive = value.permissive if permissive is None else permissive and value.permissive
        bounds = (min(places), max(places)) if places else (None, None)
        return len(words), len(places), *bounds, ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1.0 - doubt, expressions, permissive

    types = pa.schema([
        *((c, pa.int64()) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()),
        ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton([*base, *more, TAG])
        for batch in batches:
            for part in by_size(batch, "text"):
                rows = [scan(machine, t.as_py()) for t in part.column("text")]
                columns = [part.column("doc_id"), *(pa.array([r[i] for r in rows], types.field(i + 1).type) for i in range(len(types) - 1))]
                yield pa.RecordBatch.from_arrays(columns, schema=types)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
