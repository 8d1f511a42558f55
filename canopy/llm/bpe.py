"""Byte-level BPE encoding and decoding.

Documents are gathered, where they lie, into chunks of bounded bytes. Ranked merges are folded over the bytes of each
distinct word of a chunk, and the words' ids are laid side by side for its documents; decoding concatenates the ids'
binary pieces. Nothing is shuffled. The README has the figures of the form with Spark's higher-order functions, which
does the same and is beyond the limits of processor time and memory.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

#: White space as the tokenizer's own regular expressions have it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: UTF-8 bytes of text in a chunk, unless one document has more.
CHUNK = 8 << 20
#: Ids that are laid out at once.
SLICE = 1 << 20
#: Longer words than this go through a heap instead of a list.
LONG = 256
#: The rank of two pieces that don't make a token.
NO_RANK = 1 << 40


def word_pattern(pattern: str) -> regex.Pattern:
    """The words' expression with white space spelt out."""
    return regex.compile(pattern.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]"))


def ascii_pattern(pattern: str) -> re.Pattern:
    """The words' expression for texts in ASCII alone, where it finds the same words sooner."""
    for a, b in (("[^\\s\\p{L}\\p{N}]", "[^\\t-\\r A-Za-z0-9]"), ("\\p{L}", "[A-Za-z]"), ("\\p{N}", "[0-9]"), ("\\s", "[\\t-\\r ]"), ("\\S", "[^\\t-\\r ]")):
        pattern = pattern.replace(a, b)
    return re.compile(pattern)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ids from a file of ranks; read on the driver alone."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}


def merged(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The ids of one word: each step joins the leftmost pair of least rank. begins: where pieces begin, and the end;
    pairs: the rank of each piece with its right neighbour."""
    get = table.get
    begins = list(range(len(word) + 1))
    pairs = [get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pairs:
        least = min(pairs)
        if least == NO_RANK:
            break
        i = pairs.index(least)
        del begins[i + 1], pairs[i]
        if i:
            pairs[i - 1] = get(word[begins[i - 1] : begins[i + 1]], NO_RANK)
        if i < len(pairs):
            pairs[i] = get(word[begins[i] : begins[i + 2]], NO_RANK)
    return [table[word[a:b]] for a, b in zip(begins, begins[1:], strict=False)]


def merged_long(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The ids of one word by the same merges, through a heap: for words too long for a fold."""
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := table.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n:
                to = after[after[a]]
                if (r := table.get(word[a:to])) is not None:
                    heappush(heap, (r, a, to))
    return [table[word[i : after[i]]] for i in range(n) if alive[i]]


def encoded(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", chunk: int = CHUNK, back: bool = False) -> DataFrame:
    """The columns of ``keep`` and ``tokens``: the ids of every whole text, as packed little-endian 32-bit numbers.

    With ``back`` also ``decoded``: the bytes that the ids stand for, decoded where they were made. A null or empty text
    has no tokens. Rows stay as they are, repeated or not.
    """
    find, find_ascii, table = word_pattern(pattern).findall, ascii_pattern(pattern).findall, ranks(path)
    pieces = Pieces(table) if back else None
    frame = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    schema = frame.drop("__text").withColumns({"tokens": F.lit(b""), "decoded": F.lit(b"")} if back else {"tokens": F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _chunks(batches, chunk):
            number: defaultdict[str, int] = defaultdict()
            number.default_factory = number.__len__
            codes = []
            for t in texts:
                found = find_ascii(t) if t.isascii() else find(t)
                codes.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
            ids, ends = array("I"), array("q", [0])
            for word in number:
                raw = word.encode("utf-8", "surrogatepass")
                one = table.get(raw)
                ids.extend((one,) if one is not None else merged(raw, table) if len(raw) <= LONG else merged_long(raw, table))
                ends.append(len(ids))
            flat, at = np.frombuffer(ids, "<u4") if ids else np.zeros(0, "<u4"), np.frombuffer(ends, np.int64)
            for lo, hi in _spans([4 * len(c) for c in codes]):
                tokens = [spread(flat, at, c) for c in codes[lo:hi]]
                cols = [pa.array([t.tobytes() for t in tokens], pa.binary())]
                if back:
                    cols.append(pa.array([pieces.of(t) for t in tokens], pa.binary()))
                some = rows.slice(lo, hi - lo).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), *cols], names=schema.names)

    def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, list[str]]]:
        own, texts, size = [], [], 0
        for b in batches:
            lo = 0
            for i, t in enumerate(b.column("__text")):
                t = t.as_py() or ""
                if texts and size + len(t) > most:
                    own.append(b.slice(lo, i - lo).select(list(keep)))
                    yield pa.Table.from_batches(own), texts
                    own, texts, size, lo = [], [], 0, i
                texts.append(t)
                size += len(t)
            own.append(b.slice(lo).select(list(keep)))
        if texts:
            yield pa.Table.from_batches(own), texts

    return in_batches(frame).mapInArrow(run, schema)


def _spans(sizes: list[int], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose sizes together stay below most, or of one larger one."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at = i
            total = 0
        total += n
    yield at, len(sizes)


class Pieces:
    """The binary pieces of ids, one behind the other."""

    def __init__(self, table: dict[bytes, int]):
        pieces = [b""] * (max(table.values()) + 1)
        for raw, i in table.items():
            pieces[i] = raw
        self.flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    def of(self, ids: np.ndarray) -> bytes:
        """The concatenated pieces of ids."""
        return spread(self.flat, self.at, ids).tobytes()


def spread(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces flat[at[k]:at[k + 1]] for each k of which, side by side."""
    out = []
    for lo in range(0, len(which), SLICE):
        k = which[lo : lo + SLICE]
        lengths = at[k + 1] - at[k]
        ends = np.cumsum(lengths)
        total = int(ends[-1])
        out.append(flat[np.repeat(at[k] - (ends - lengths), lengths) + np.arange(total)])
    return np.concatenate(out) if out else flat[:0]


def decoded(frame: DataFrame, path: str, keep: tuple[str, ...], tokens: str = "tokens") -> DataFrame:
    """The columns of ``keep`` and ``decoded``: the bytes that the packed ids of ``tokens`` stand for."""
    pieces = Pieces(ranks(path))
    schema = frame.select(*keep, F.lit(b"").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if x is None else pieces.of(np.frombuffer(x, dtype="<u4")) for x in b.column(tokens).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "decoded"])

    return in_batches(frame.select(*dict.fromkeys([*keep, tokens]))).mapInArrow(run, schema)
