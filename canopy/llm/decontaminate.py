"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are split by their number of distinct shingles into size classes, each twice as large as the one before. An
item's sketch is its ``depth`` smallest shingle hashes (its bottom-k MinHash), where depth is one more than the
shingles that the largest item of its class may lack. Of the sketch of an item that is contained at the threshold, at
least one hash therefore stands in the document however long that is: the search loses nothing. Documents are scanned
once for all sketches of a block of items; what meets a sketch is verified by its shingles, word for word.

Documents never move. Items go to the tasks in blocks of bounded bytes, one scan for each block.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import in_batches, stored

#: Shingle width and least containment.
WIDTH, LEAST = 5, 0.8
#: Bytes and number of items that one scan takes along.
BLOCK_BYTES, BLOCK_ITEMS = 16 << 20, 20_000


@dataclass
class Item:
    ids: list
    width: int
    shingles: dict  # text to hash
    sketch: np.ndarray = field(default=None)


def split_words(text: bytes) -> list[bytes]:
    data = np.frombuffer(text, dtype=np.uint8)
    return [text[a:b] for a, b in zip(*W.bounds(data), strict=True)]


def shingles_of(text: str | None, width: int = WIDTH) -> tuple[int, dict[bytes, int]]:
    """The width used (all words, where there are fewer) and the distinct shingles with their hashes."""
    raw = W.folded(text)
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, ends = W.bounds(data)
    if not len(starts):
        return 0, {}
    width = min(width, len(starts))
    hashes = W.shingle_hashes(W.word_hashes(data, starts, ends), width)
    words = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
    return width, {b" ".join(words[i : i + width]): int(h) for i, h in enumerate(hashes)}


def sketched(rows: list[tuple[int | None, str | None]], width: int = WIDTH, least: float = LEAST) -> list[Item]:
    """Items with sketches; those with equal shingles are one item with several ids."""
    by_content: dict = {}
    for item_id, text in rows:
        used, shingles = shingles_of(text, width)
        if shingles:
            by_content.setdefault((used, frozenset(shingles)), Item([], used, shingles)).ids.append(item_id)
    classes = defaultdict(list)
    for item in by_content.values():
        item.ids = sorted({i for i in item.ids if i is not None})
        classes[len(item.shingles).bit_length()].append(item)
    for items in classes.values():
        depth = lacking(max(len(i.shingles) for i in items), least) + 1
        for item in items:
            item.sketch = np.sort(np.array(list(item.shingles.values()), dtype=np.uint64))[:depth]
    return list(by_content.values())


def lacking(n: int, least: float) -> int:
    """How many of n shingles may be missing."""
    return n - math.ceil(least * n - 1e-9)


class Searcher:
    """All sketches of a block of items, for one shingle width."""

    def __init__(self, items: list[Item], least: float):
        self.items, self.least, self.width = items, least, items[0].width
        at = np.repeat(np.arange(len(items)), [len(i.sketch) for i in items])
        values = np.concatenate([i.sketch for i in items])
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], at[order]
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.values >> np.uint64(44)).astype(np.int64)] = True
        self.hashes = [np.sort(np.array(list(i.shingles.values()), dtype=np.uint64)) for i in items]

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Places whose shingle stands in a sketch."""
        maybe = np.flatnonzero(self.bits[(shingles >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.values, shingles[maybe])
        at[at == len(self.values)] = 0
        return maybe[self.values[at] == shingles[maybe]]

    def owners_of(self, values: np.ndarray) -> np.ndarray:
        values = np.unique(values)
        lo, hi = np.searchsorted(self.values, values, "left"), np.searchsorted(self.values, values, "right")
        return np.unique(np.concatenate([self.owners[a:b] for a, b in zip(lo, hi, strict=True)]))

    def verified(self, k: int, shingles: np.ndarray, text, starts: np.ndarray, ends: np.ndarray) -> int:
        """How many of an item's shingles the document holds, word for word; 0 if too few."""
        own = self.hashes[k]
        at = np.searchsorted(own, shingles)
        at[at == len(own)] = 0
        places = np.flatnonzero(own[at] == shingles)
        found = set()
        for p in places.tolist():
            found.add(b" ".join(text[a:b] for a, b in zip(starts[p : p + self.width], ends[p : p + self.width], strict=True)))
        n = len(found & self.items[k].shingles.keys())
        return n if n >= len(own) - lacking(len(own), self.least) else 0


def matches(texts: list[str | None], searchers: list[Searcher]) -> Iterator[tuple[int, Item, int]]:
    """(place of the text, item, shingles found) for all contained items."""
    raw = [W.folded(t) for t in texts]
    for lo, hi in W.chunks(raw):
        data, begin = W.joined(raw[lo:hi])
        starts, ends = W.bounds(data)
        if not len(starts):
            continue
        words = W.word_hashes(data, starts, ends)
        first = np.searchsorted(starts, begin)
        for s in searchers:
            shingles = W.shingle_hashes(words, s.width)
            hits = s.hits(shingles)
            doc = np.searchsorted(first, hits, side="right") - 1
            inside = hits + s.width <= first[doc + 1]
            hits, doc = hits[inside], doc[inside]
            for d in np.unique(doc).tolist():
                a, b = first[d], first[d + 1]
                own = shingles[a : b - s.width + 1]
                buffer = data.data
                for k in s.owners_of(shingles[hits[doc == d]]).tolist():
                    n = s.verified(k, own, _Slices(buffer), starts[a:b], ends[a:b])
                    if n:
                        yield lo + d, s.items[k], n


class _Slices:
    """Slices of a buffer as bytes."""

    def __init__(self, buffer):
        self.buffer = buffer

    def __getitem__(self, at):
        return bytes(self.buffer[at])


def contained(docs: DataFrame, items: DataFrame, width: int = WIDTH, least: float = LEAST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, item_ids, n_shingles, n_found and containment of every item that a document contains.

    Words are runs of letters and digits in lower case. An item of fewer words than width is one shingle; one without
    words is never contained. Items with equal shingles are one, under their smallest id, with all ids in item_ids.
    Null texts hold nothing; null and repeated doc_ids stay, one row for each row of docs.
    """
    schema = "doc_id long, item_id long, item_ids array<long>, n_shingles long, n_found long, containment double"
    frame = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    parts = [in_batches(frame).mapInArrow(_scan(found, least), schema) for found in blocks_of(rows, width, least)]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def blocks_of(rows: DataFrame, width: int, least: float) -> Iterator[list[Item]]:
    """Sketched items of rows (item_id, text), in blocks of bounded size; items of equal shingles share a block.

    Blocks are dealt by a hash of the shingles themselves, so what is one item doesn't depend on how many blocks there
    are. Each block is a scan of its own; the driver holds their items.
    """
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, math.ceil(size["n"] / BLOCK_ITEMS), math.ceil((size["b"] or 0) / BLOCK_BYTES))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [content_key(t.as_py(), width) % blocks for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=["item_id", "text", "block"])

    if blocks > 1:
        rows = stored(in_batches(rows).mapInArrow(dealt, "item_id long, text string, block int"))
    for k in range(blocks):
        found = sketched([(r["item_id"], r["text"]) for r in (rows.filter(F.col("block") == k) if blocks > 1 else rows).collect()], width, least)
        if found:
            yield found


def content_key(text: str | None, width: int) -> int:
    """The same number for texts of equal shingles."""
    used, shingles = shingles_of(text, width)
    return used ^ reduce(lambda a, b: a ^ b, shingles.values(), 0)


def without(docs: DataFrame, items: DataFrame, width: int = WIDTH, least: float = LEAST, text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    rows = items.select(F.lit(None).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    for found in blocks_of(rows, width, least):
        docs = in_batches(docs).mapInArrow(_drop(found, least, text), docs.schema)
    return docs


def _drop(items: list[Item], least: float, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = _searchers(items, least)
        for b in batches:
            held = {d for d, _, _ in matches(b.column(b.schema.get_field_index(text)).to_pylist(), searchers)}
            yield b.filter(pa.array([i not in held for i in range(b.num_rows)], pa.bool_()))

    return run


def _searchers(items: list[Item], least: float) -> list[Searcher]:
    by_width = defaultdict(list)
    for item in items:
        by_width[item.width].append(item)
    return [Searcher(x, least) for x in by_width.values()]


def _scan(items: list[Item], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = _searchers(items, least)
        for b in batches:
            ids, out = b.column("doc_id").to_pylist(), []
            for d, item, n in matches(b.column("text").to_pylist(), searchers):
                total = len(item.shingles)
                out.append((ids[d], item.ids[0] if item.ids else None, item.ids, total, n, n / total))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "item_ids", "n_shingles", "n_found", "containment"])

    return run
