"""Minimax sharding of documents by bytes, with DataFrame functions only.

Groups of equal texts are atomic and ordered by the 64-bit hash of their text. The driver searches the smallest shard
capacity for which a greedy left-to-right cut needs no more shards than asked for. It works on byte sums of dyadic
hash ranges: at first ``2 ** TOP_BITS`` of them, then finer ones for the ranges in which a cut can fall, until a bound
from below (ranges divisible at will) meets one from above (ranges atomic). It never sees more than that, whatever the
input. Rows carry ids, sizes and hashes, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Leading hash bits of the first ranges, and further bits at each refinement.
TOP_BITS, STEP_BITS = 14, 6


class Ranges:
    """Ordered hash ranges: first hash, bytes, and whether one group is all that a range holds."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.rows = sorted(rows)  # (first hash, last hash, bytes, bits)
        self.sums = [0, *accumulate(r[2] for r in self.rows)]
        self.total = self.sums[-1]

    def atomic(self, k: int) -> bool:
        return self.rows[k][0] == self.rows[k][1]

    def ends(self, capacity: int, shards: int, divisible: bool) -> list[int] | None:
        """Where greedy shards of this capacity end, in bytes from the start; None if they are too few."""
        at, out = 0, []
        while at < self.total:
            if len(out) == shards:
                return None
            k = bisect_right(self.sums, at + capacity) - 1
            if k < len(self.rows) and divisible and not self.atomic(k):
                to = at + capacity
            else:
                to = self.sums[k]
            if to <= at:
                return None
            at = min(to, self.total)
            out.append(at)
        return out

    def smallest(self, shards: int, divisible: bool) -> int:
        """The smallest feasible capacity, by binary search."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            if self.ends(mid, shards, divisible) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def doubtful(self, low: int, high: int, shards: int) -> list[int]:
        """Divisible ranges that hold a cut for some capacity from low to high."""
        a, b = self.ends(low, shards, True) or [], self.ends(high, shards, False) or []
        out = {k for k, r in enumerate(self.rows) if r[2] > low and not self.atomic(k)}
        for n, x in enumerate(a):
            y = b[n] if n < len(b) else x
            first, last = bisect_right(self.sums, min(x, y)) - 1, bisect_left(self.sums, max(x, y))
            out.update(k for k in range(max(first, 0), min(last + 1, len(self.rows))) if not self.atomic(k))
        return sorted(out)

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """First hashes of shards 1, 2, ...: of all cuts within capacity, those nearest to equal sizes."""
        back = [len(self.rows)]
        for _ in range(shards - 1):
            back.append(bisect_left(self.sums, self.sums[back[-1]] - capacity))
        out, at = [], 0
        for left in range(shards - 1, 0, -1):
            aim = self.sums[at] + (self.total - self.sums[at]) / (left + 1)
            k = bisect_left(self.sums, aim)
            if k > at and aim - self.sums[k - 1] < self.sums[k] - aim:
                k -= 1
            k = min(max(k, back[left], at + 1), bisect_right(self.sums, self.sums[at] + capacity) - 1)
            out.append(k)
            at = k
        return [self.rows[k][0] for k in out if k < len(self.rows)]


def _measured(rows: DataFrame, bits: int, within: list[tuple[int, int, int, int]] | None) -> list[tuple[int, int, int, int]]:
    if within is not None:
        shift = 64 - within[0][3]
        rows = rows.filter(F.shiftright("h", shift).isin([r[0] >> shift for r in within]))
    got = rows.groupBy(F.shiftright("h", 64 - bits).alias("p")).agg(F.min("h").alias("a"), F.max("h").alias("b"), F.sum("size").alias("n")).collect()
    return [(r["a"], r["b"], int(r["n"]), bits) for r in got]


def plan(rows: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity for rows (h, size), and the first hashes of all shards but the first."""
    known = Ranges(_measured(rows, TOP_BITS, None))
    while known.total:
        low, high = known.smallest(shards, True), known.smallest(shards, False)
        doubtful = known.doubtful(low, high, shards) if low < high else []
        if not doubtful:
            return high, known.cuts(high, shards)
        bits = min(known.rows[k][3] for k in doubtful)
        now = [known.rows[k] for k in doubtful if known.rows[k][3] == bits]
        kept = set(range(len(known.rows))) - {k for k in doubtful if known.rows[k][3] == bits}
        known = Ranges([known.rows[k] for k in kept] + _measured(rows, min(64, bits + STEP_BITS), now))
    return 0, []


def shard_of(h: Column, cuts: list[int]) -> Column:
    """The shard of a hash: how many shards begin at or below it."""
    out = F.lit(0)
    for c in cuts:
        out = out + (h >= F.lit(c)).cast("int")
    return out


def sharded(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    size is the text's UTF-8 bytes (null: none) plus one. Equal texts, null counting as empty, share a shard; shards
    are contiguous in hash order with the smallest possible largest size, which a single large group can set. slot
    numbers a shard's rows from 0 without gaps. Repeated rows and null ids get slots of their own.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("h"),
        )
    )
    _, cuts = plan(slim, shards)
    placed = slim.withColumn("shard", shard_of(F.col("h"), cuts))
    order = ["h", "doc_id", "size", "text_crc32"]
    # the id holds the partition above bit 33 and the row's place in it below; stored, so that both stay
    numbered = stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33).alias("part")
    runs = numbered.groupBy(part, "shard").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # as many rows as there are partitions and cuts
    runs = runs.select("part", "shard", "first", before.alias("before"))
    slots = numbered.withColumn("part", part).join(F.broadcast(runs), ["part", "shard"])
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("id") - F.col("first") + F.col("before")).alias("slot"))
