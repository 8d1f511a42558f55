"""License scans: Aho-Corasick over words, and a shunting-yard parser for licence expressions.

One automaton holds the base phrases, further notice phrases and the words of identifier tags. It runs over a text's
words in lower case, with one space around each. Behind a tag the parser evaluates the expression (AND, OR, WITH,
parentheses) to the labels that it can leave in force and to how freely they let the text be used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

#: Fixed phrases of the contract and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases that the method adds.
NOTICES = {
    "all rights reserved": "all-rights-reserved",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by sa": "cc-by-sa",
    "cc0 1 0 universal": "cc0",
    "creative commons attribution": "cc-by",
    "gnu affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2 0": "mpl-2",
    "permission is hereby granted free of charge to any person": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
}
#: Words of identifier tags.
TAGS = ("spdx license identifier", "license identifier")
#: How freely a licence lets a text be used, 1 for wholly; any other licence has UNKNOWN.
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9,
    "mpl-2": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl-2": 0.4, "gpl-3": 0.4, "agpl": 0.3, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "all-rights-reserved": 0.0,
}
UNKNOWN = 0.5

_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_TAG = re.compile(r"(?i:(?:SPDX[-_ ]?)?License[-_ ]Identifier)\s*:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def label(name: str) -> str:
    """The label of an identifier such as Apache-2.0 or GPL-3.0-or-later."""
    name = re.sub(r"(-only|-or-later|\+)$", "", name.lower())
    name = re.sub(r"(?<=[a-z])-(\d+)(\.\d+)*$", r"-\1", name)
    return {"cc0-1": "cc0", "lgpl-2": "lgpl", "lgpl-3": "lgpl", "agpl-3": "agpl"}.get(re.sub(r"^(cc-by[a-z-]*?)-\d$", r"\1", name), re.sub(r"^(cc-by[a-z-]*?)-\d$", r"\1", name))


def postfix(tokens: list[str]) -> list[str] | None:
    """The longest run of tokens, from the first, that is an expression, in postfix order (shunting-yard); None if there is none.

    An expression is complete after an operand or ")" with no "(" open; what the stack holds then ends its postfix order.
    """
    out, stack, operand, depth = [], [], True, 0
    size, rest = 0, []
    for t in tokens:
        low = t.lower()
        if t == "(":
            if not operand:
                break
            stack.append(t)
            depth += 1
        elif t == ")":
            if operand or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif low in _RANK:
            if operand:
                break
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            if not operand:
                break
            out.append(t)
            operand = False
        if not operand and not depth:
            # without "(" the stack holds operators of rising rank: three at most
            size, rest = len(out), stack[::-1]
    return out[:size] + rest if size else None


def parsed(expression: str) -> tuple[frozenset[str], float] | None:
    """Labels and freedom of the longest run of tokens, from the first, that is an expression.

    AND keeps both sides and the lesser freedom; OR leaves a choice: all labels, the greater freedom; WITH grants an
    exception to its left side, whose labels stay.
    """
    order = postfix(_TOKEN.findall(expression))
    return _evaluated(order) if order else None


def _evaluated(order: list[str]) -> tuple[frozenset[str], float]:
    stack: list[tuple[set[str], float]] = []
    for t in order:
        if t in _RANK:
            b, a = stack.pop(), stack.pop()
            if t != "with":
                small, large = sorted((a[0], b[0]), key=len)
                large |= small
                a = large, min(a[1], b[1]) if t == "and" else max(a[1], b[1])
            stack.append(a)
        else:
            name = label(t)
            stack.append(({name}, FREEDOM.get(name, UNKNOWN)))
    return frozenset(stack[0][0]), stack[0][1]


@dataclass
class Scan:
    """What a text holds: its words, base places, and labels."""

    n_words: int = 0
    n_base: int = 0
    first: int | None = None
    last: int | None = None
    base: set = field(default_factory=set)
    all: set = field(default_factory=set)
    score: float = 1.0


def automaton() -> ahocorasick.Automaton:
    """Finds phrases between spaces; a value is (kind, label, phrase length)."""
    a = ahocorasick.Automaton()
    for kind, phrases in (("tag", dict.fromkeys(TAGS, "")), ("notice", NOTICES), ("base", BASE)):
        for phrase, name in phrases.items():
            a.add_word(f" {phrase} ", (kind, name, len(phrase)))
    a.make_automaton()
    return a


def scan(text: str | None, a: ahocorasick.Automaton) -> Scan:
    """Scans one whole text; null counts as empty."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split(b" ")
    words = [w for w in words if w]
    out = Scan(len(words))
    if not words:
        return out
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    at = place = 0
    tagged = False
    for end, (kind, name, size) in sorted(a.iter(line), key=lambda x: x[0] - x[1][2]):
        start = end - size - 1
        if kind == "tag":
            tagged = True
            continue
        out.all.add(name)
        out.score = min(out.score, FREEDOM.get(name, UNKNOWN))
        if kind == "base":
            place += line.count(" ", at, start)
            at = start
            out.n_base += 1
            out.first = place if out.first is None else out.first
            out.last = place
            out.base.add(name)
    if tagged:
        for m in _TAG.finditer(text):
            if found := parsed(m[1]):
                out.all |= found[0]
                out.score = min(out.score, found[1])
    return out


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are numbered from 0; first_word and last_word are null without a base place. Labels are distinct, sorted,
    comma-joined. score is the freedom of the strictest licence found, 1 without any.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in batches:
            found = [scan(t.as_py(), a) for t in b.column("text")]
            cols = [
                b.column("doc_id"),
                *(pa.array([getattr(x, c) for x in found], pa.int64()) for c in ("n_words", "n_base", "first", "last")),
                *(pa.array([",".join(sorted(getattr(x, c))) for x in found], pa.string()) for c in ("base", "all")),
                pa.array([x.score for x in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return in_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, schema)
