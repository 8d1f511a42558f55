"""SimHash near-duplicates through a Gray-order hierarchical index.

Two fingerprints within ``distance`` bits agree in all but ``distance // parts`` bits in at least one of the
``parts`` equal parts of the 64 bits. For each part the fingerprint is rotated so that this part leads, and the
index is searched with two budgets: ``distance // parts`` for the leading part, ``distance`` for all bits.

The upper levels of the index are blocks: dyadic intervals of the Gray order, split until each holds at most about
one part in ``BLOCKS`` of the distinct fingerprints (a histogram of leading bits, bounded whatever the input). A
fingerprint visits the blocks that its leading bits reach within the budget; each pair of blocks meets in one place.
The lower levels are built in the task of a block: fingerprints sorted by Gray rank, runs of ``FANOUT`` nodes below
one parent whose mask holds the bits that they all share; a node keeps only shared bits that its parent lacks, so
differences add up on the way down and a whole run goes as soon as they pass a budget.

A task returns a spanning forest of the links it found, never all pairs; the forests are contracted to components,
first by tasks and then, where there are several, by stars.

Where a Jaccard similarity is asked for, the index gives the first pairs, but fingerprints can't tell them all: at 0.8
two of them differ in about 10 bits. Documents with equal sets of shingles are one node, MinHash bands add buckets, and
every pair that is near by fingerprint or bucket is verified before anything is contracted: by a sketch that never
loses a true pair, and then by whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, hot_keys, in_batches, spread_join, stored, swept

SEED = 42
FANOUT = 8
#: Blocks aimed at; a block holds at least MIN_BLOCK fingerprints where that leaves fewer blocks, and at most MAX_BLOCK where that asks for more.
BLOCKS, MIN_BLOCK, MAX_BLOCK = 192, 64, 200_000
#: Pairs of query and node that a task holds at once.
FRONTIER = 2_000_000
#: Shingles of one document that are hashed at once.
SLICE = 1 << 16

#: MinHash bands and minima in each: a pair at 0.8 shares no band once in 17,000 times.
BANDS, BAND = 32, 6
#: Edges of a file, about.
FILE_EDGES = 100_000
#: Growth of places apart from round to round.
STRIDE = 32
#: Members of a bucket in one task; bytes of sketches that are compared at once; bytes of a sketch at most.
BUCKET, SKETCHES, MOST_PARTS = 2048, 32 << 20, 1 << 16

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_FLIP, _MIX = (np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND), np.uint64) | np.array([[0], [1]], np.uint64))


def simhash(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint of a text, as an unsigned number; zero where it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    n, counts, digest = len(starts), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, SLICE):
        cut = zip(starts[at : at + SLICE].tolist(), ends[at : at + SLICE].tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in cut], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and ``fp`` (the fingerprint as a signed long) of every row.

    Null and blank texts have fingerprint zero; a text of fewer words than ``width`` is one shingle.
    """
    frame = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    schema = frame.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t.as_py(), width) for t in b.column("__text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fps, pa.int64())], names=[*keep, "fp"])

    return in_batches(frame).mapInArrow(run, schema)


def rotated(fp: np.ndarray, by: int) -> np.ndarray:
    return fp if by % 64 == 0 else (fp << np.uint64(by)) | (fp >> np.uint64(64 - by))


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of a code in Gray order."""
    rank = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Distinct codes in Gray order below nodes that hold the bits their codes share."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes))]
        low, high = self.codes, self.codes
        levels = [(self.codes, np.full(len(self.codes), _ALL))]
        while len(low) > FANOUT:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            mask = ~(low ^ high)
            levels.append((low & mask, mask))
        self.levels = []
        for k in reversed(range(len(levels))):
            pattern, mask = levels[k]
            if k + 1 < len(levels):
                mask = mask & ~np.repeat(levels[k + 1][1], FANOUT)[: len(mask)]
            self.levels.append((pattern, mask))

    def search(self, queries: np.ndarray, distance: int, lead: np.uint64, lead_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places, in ``queries`` and in ``codes``, within both budgets; each pair once."""
        top = len(self.levels[0][0])
        step = max(1, FRONTIER // (top * FANOUT))
        for at in range(0, len(queries), step):
            q = np.repeat(np.arange(at, min(at + step, len(queries))), top)
            node = np.tile(np.arange(top), len(q) // top)
            yield from self._descend(queries, q, node, np.zeros(len(q), np.uint8), np.zeros(len(q), np.uint8), 0, distance, lead, lead_distance)

    def _descend(self, queries, q, node, total, ahead, level, distance, lead, lead_distance):
        pattern, mask = self.levels[level]
        unlike = (queries[q] ^ pattern[node]) & mask[node]
        total = total + np.bitwise_count(unlike)
        ahead = ahead + np.bitwise_count(unlike & lead)
        near = np.flatnonzero((total <= distance) & (ahead <= lead_distance))
        if level + 1 == len(self.levels):
            yield q[near], node[near]
            return
        size = len(self.levels[level + 1][0])
        step = max(1, FRONTIER // FANOUT)
        for at in range(0, len(near), step):
            some = near[at : at + step]
            child = (node[some][:, None] * FANOUT + np.arange(FANOUT)).ravel()
            there = np.flatnonzero(child < size)
            up = some[there // FANOUT]
            yield from self._descend(queries, q[up], child[there], total[up], ahead[up], level + 1, distance, lead, lead_distance)


def hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """labels (each place's smallest known companion, fully followed) after joining places a and b, and the pairs that did it."""
    by_a, by_b = [], []
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels, np.concatenate([*by_a, a[:0]]), np.concatenate([*by_b, b[:0]])
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        upper, one = np.unique(np.maximum(x, y), return_index=True)
        labels[upper] = np.minimum(x, y)[one]
        by_a.append(a[one])
        by_b.append(b[one])
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further


def block_forest(home: np.ndarray, visitors: np.ndarray, distance: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, each of two codes within distance, that join all codes of a block, and its visitors as far as codes of the block join them.

    Nearer codes link first, so that a link is doubtful only where no nearer ones lead round it.
    """
    index = GrayIndex(home)
    codes = np.concatenate([index.codes, visitors])
    labels = np.arange(len(codes))
    lead = ~(_ALL >> np.uint64(64 // parts))
    out: list = [(labels[:0], labels[:0])]
    for reach in sorted({min(3, distance), distance}):
        for a, b in index.search(codes, reach, lead, distance // parts):
            some = b > a
            some |= a >= len(home)
            if some.any():
                labels, *pair = hook(labels, a[some], b[some])
                out.append(pair)
    return tuple(codes[np.concatenate([o[i] for o in out])] for i in (0, 1))


class Blocks:
    """The upper index: starts, in numeric order of rotated codes, of dyadic blocks of at most ``depth`` leading bits."""

    def __init__(self, starts: np.ndarray, depth: int):
        self.starts, self.depth = starts, depth

    def of(self, code: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, code, side="right") - 1


def _rotation(by: int):
    fp = F.col("fp")
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def plan_blocks(nodes: DataFrame, total: int, by: int, parts: int) -> Blocks:
    """Splits leading bits, eight at a time, until no block holds more than its share or only one part's bits are left.

    The driver gets counts of leading bits of blocks that are too full: at most 256 for each, and of those there
    can't be more than ``total`` over the share.
    """
    share = min(MAX_BLOCK, max(MIN_BLOCK, total // BLOCKS))
    most = 64 // parts
    code, done, full, depth = _rotation(by), [], {0}, 0
    while full:
        step = min(8, most - depth)
        prefix = F.shiftrightunsigned(code, 64 - depth - step).alias("prefix")
        frame = nodes.select(prefix)
        if depth:
            frame = frame.filter(F.shiftrightunsigned("prefix", step).isin([int(x) for x in sorted(full)]))
        counts = {r["prefix"]: r["n"] for r in frame.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).collect()}
        now = set()
        for parent in full:
            now |= _split(parent, depth, step, counts, share, done)
        depth += step
        if depth >= most:
            done += [(p, depth) for p in now]
            now = set()
        full = now
    starts = np.array(sorted(p << (64 - d) for p, d in done), dtype=np.uint64)
    return Blocks(starts, max(d for _, d in done))


def _split(parent: int, depth: int, step: int, counts: dict[int, int], share: int, done: list[tuple[int, int]]) -> set[int]:
    """Adds to done the blocks below parent that are small enough; returns the rest, step bits deeper."""
    size = np.zeros(1 << step, np.int64)
    for k in range(1 << step):
        size[k] = counts.get((parent << step) | k, 0)
    sums, over = np.concatenate([[0], np.cumsum(size)]), set()

    def go(at: int, bits: int) -> None:
        width = 1 << (step - bits)
        if sums[(at + 1) * width] - sums[at * width] <= share:
            done.append(((parent << bits) | at, depth + bits))
        elif bits == step:
            over.add((parent << step) | at)
        else:
            go(2 * at, bits + 1)
            go(2 * at + 1, bits + 1)

    go(0, 0)
    return over


def links(nodes: DataFrame, distance: int = 3, parts: int = 2) -> DataFrame:
    """(u, v): links that join exactly the distinct ``fp`` that a chain of distances of at most ``distance`` joins."""
    total = nodes.count()
    if total == 0:
        return nodes.sparkSession.createDataFrame([], "u long, v long")
    turns = [64 // parts * k for k in range(parts)]
    plans = [plan_blocks(nodes, total, by, parts) for by in turns]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for turn, (by, plan) in enumerate(zip(turns, plans, strict=True)):
                code = rotated(fp, by)
                own = plan.of(code)
                yield _rows(turn, own, fp, True)
                bits = [np.uint64(1 << (63 - j)) for j in range(min(plan.depth, 64 // parts))]
                for n in range(1, distance // parts + 1):
                    for some in combinations(bits, n):
                        there = plan.of(code ^ np.bitwise_or.reduce(np.array(some, np.uint64)))
                        new = there > own
                        if new.any():
                            yield _rows(turn, there[new], fp[new], False)

    def meet(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        by = turns[table.column("turn")[0].as_py()]
        out: tuple = ((), ())
        if home.any():
            code = rotated(fp, by)
            out = block_forest(np.unique(code[home]), np.unique(code[~home]), distance, parts)
        u, v = (rotated(np.asarray(x, np.uint64), (64 - by) % 64).view(np.int64) for x in out)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    routed = nodes.select("fp").mapInArrow(route, "turn int, block int, fp long, home boolean")
    return routed.groupBy("turn", "block").applyInArrow(meet, "u long, v long")


def _rows(turn: int, block: np.ndarray, fp: np.ndarray, home: bool) -> pa.RecordBatch:
    n = len(fp)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, turn, np.int32)), pa.array(block.astype(np.int32)), pa.array(fp.view(np.int64)), pa.array(np.full(n, home))],
        names=["turn", "block", "fp", "home"],
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (u, v): root is the smallest node reachable.

    Each round first contracts what one task holds, about FILE_EDGES edges: that settles few edges at once. Large and
    small stars follow until every edge leads to a root; each round is written to the shared folder and cuts the
    lineage. The edges of a node that very many have are dealt to several tasks.
    """
    edges = stored(_ordered(edges))
    total = edges.count()
    while total:
        parts = -(-total // FILE_EDGES)
        last, edges = edges, stored(_contracted(edges, parts))
        dropped(last)
        total = edges.count()
        if parts == 1 or not total or _settled(edges):
            break
        large = _star(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * total, large=True)
        large = stored(large) if total > FILE_EDGES else large
        # few edges are written in few files, whatever the number of shuffle partitions
        last, edges = edges, stored(_star(large, 2 * total, large=False).distinct().coalesce(-(-total // FILE_EDGES)))
        dropped(last, large)
        total = edges.count()
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Edges that join what edges join, at most one from a node in each of ``parts`` tasks: to the smallest node that the task's edges lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = v = np.zeros(0, np.int64)
        for b in batches:
            more = (b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v"))
            u, v = (np.concatenate(x) for x in zip((u, v), more, strict=True))
            names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            labels, _, _ = hook(np.arange(len(names)), at[: len(u)], at[len(u) :])
            u, v = names, names[labels]
            u, v = u[u != v], v[u != v]
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return edges.coalesce(parts).mapInArrow(run, "u long, v long")


def _settled(edges: DataFrame) -> bool:
    """Whether every node that isn't a root has one edge, to a root."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root"))))
    both = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.root").alias("root"))
    return not both.filter("up > 1 or (up = 1 and root = 1)").limit(1).count()


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """Joins each node's larger (or else its smaller) neighbours to the smallest node of its neighbourhood; total bounds the edges."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    if total <= 2 * FILE_EDGES:
        # no more nodes than edges: a table of bounded size goes to all of them
        linked = edges.join(F.broadcast(least.select("u", "m")), "u")
    else:
        linked = spread_join(edges, least.select("u", "m"), "u", hot_keys(least, "u", total), F.col("v")).select("u", "v", "m")
    if large:
        return linked.filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
    return linked.select(ends.alias("e")).select("e.u", "e.v").filter("u <> v")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingles(text: str | None, width: int) -> set[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def jaccard(a: str | None, b: str | None, width: int) -> float:
    x, y = shingles(a, width), shingles(b, width)
    return len(x & y) / len(x | y)


def signature(hashes: np.ndarray) -> list[int]:
    """One key for each band: a hash of its minima over all shingle hashes, signed."""
    least = np.full(BANDS * BAND, _ALL)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[None, at : at + 2048] ^ _FLIP[:, None]) * _MIX[:, None]).min(axis=1))
    keys = [xxhash.xxh64_intdigest(m.tobytes(), k) for k, m in enumerate(least.reshape(BANDS, BAND))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: the bits that more than half of them set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        counts += np.unpackbits(hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def set_hashes(text: str | None, width: int) -> np.ndarray:
    """The hashes of a text's set of shingles, sorted."""
    return np.unique(np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles(text, width)], "<u8"))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, node (a hash of the set of shingles), n (its size), fp (its fingerprint) and bands of every row of docs."""
    frame = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    schema = frame.drop("text").withColumns({**{c: F.lit(0).cast("long") for c in ("node", "n", "fp")}, "bands": F.array(F.lit(0).cast("long"))}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, fps, bands = [], [], [], []
            for t in b.column("text"):
                h = set_hashes(t.as_py(), width)
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                sizes.append(len(h))
                fps.append(majority(h))
                bands.append(signature(h))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            cols = [b.column("doc_id"), b.column("text_key"), signed(nodes), pa.array(sizes, pa.int64()), signed(fps), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_key", "node", "n", "fp", "bands"])

    return in_batches(frame).mapInArrow(run, schema)


def sketch(hashes: np.ndarray) -> bytes:
    """One byte for each part of the shingle space, the exclusive or of what falls there; about as many parts as shingles, a power of two.

    Sets that differ in k shingles differ in at most k parts, so sketches that differ in more parts than the shingles
    that two sets may lack are of sets that are too unlike: nothing is lost by passing them over.
    """
    parts = min(MOST_PARTS, max(64, 1 << int(len(hashes) - 1).bit_length()))
    out = np.zeros(parts, np.uint8)
    np.bitwise_xor.at(out, (hashes >> np.uint64(8)).astype(np.int64) & (parts - 1), hashes.astype(np.uint8))
    return out.tobytes()


def folded_sketch(x: np.ndarray, parts: int) -> np.ndarray:
    """A sketch as it would be with fewer parts."""
    return np.bitwise_xor.reduce(x.reshape(-1, parts), axis=0)


def lacked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """In how many shingles sets of these sizes may differ."""
    return a + b - 2 * np.ceil(least / (1 + least) * (a + b) - 1e-9).astype(np.int64)


def unlike(sketches: list[np.ndarray], n: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of places x and y can't have a similarity of least."""
    parts = np.array([len(s) for s in sketches])
    common, out = np.minimum(parts[x], parts[y]), np.zeros(len(x), bool)
    for p in np.unique(common).tolist():
        own = np.flatnonzero(common == p)
        used, at = np.unique(np.concatenate([x[own], y[own]]), return_inverse=True)
        table = np.stack([folded_sketch(sketches[i], p) for i in used])
        left, right = at[: len(own)], at[len(own) :]
        step = max(1, SKETCHES // p)
        for k in range(0, len(own), step):
            some = own[k : k + step]
            out[some] = (table[left[k : k + step]] != table[right[k : k + step]]).sum(axis=1) > lacked(n[x[some]], n[y[some]], least)
    return out


def bucket_pairs(buckets: DataFrame, low: int, high: int, least: float) -> DataFrame:
    """(u, v): nodes of one bucket (key, node, n, root, sketch), low to high - 1 places apart in it, whose roots differ and whose sizes and sketches allow a similarity of least.

    A bucket is cut to blocks of BUCKET places; a task has two blocks at most.
    """
    order = Window.partitionBy("key").orderBy("node")
    placed = buckets.withColumn("place", F.row_number().over(order) - 1).withColumn("block", F.floor(F.col("place") / BUCKET).cast("int"))
    most = placed.groupBy("key").agg(F.max("block").alias("last"))
    nearest_, furthest = max(0, -(-(low - BUCKET + 1) // BUCKET)), (high - 1 + BUCKET - 1) // BUCKET
    here = F.col("block")
    ahead = F.sequence(F.lit(nearest_), F.least(F.lit(furthest), F.col("last") - here)) if nearest_ == 0 else F.when(F.col("last") - here >= nearest_, F.sequence(F.lit(nearest_), F.least(F.lit(furthest), F.col("last") - here)))
    back = F.when(here >= max(1, nearest_), F.sequence(F.lit(max(1, nearest_)), F.least(F.lit(furthest), here)))
    # what meets the block k ahead goes with its own number, what meets the block k behind with that one's
    meets = F.concat(*[F.coalesce(F.transform(x, f), F.array().cast("array<struct<block:int,ahead:int>>")) for x, f in (
        (ahead, lambda k: F.struct(here.alias("block"), k.cast("int").alias("ahead"))), (back, lambda k: F.struct((here - k).cast("int").alias("block"), k.cast("int").alias("ahead")))
    )])
    dealt = placed.join(most, "key").select("key", F.explode(meets).alias("meet"), "place", "node", "n", "root", "sketch").select("key", "meet.block", "meet.ahead", "place", "node", "n", "root", "sketch")

    def meet(table: pa.Table) -> pa.Table:
        place, node, n, root = (table.column(c).to_numpy() for c in ("place", "node", "n", "root"))
        order_ = np.argsort(place)
        place, node, n, root = place[order_], node[order_], n[order_], root[order_]
        raw = table.column("sketch").to_pylist()
        sketches = [np.frombuffer(raw[i], np.uint8) for i in order_]
        first = int(table.column("block")[0].as_py())
        left = int(np.searchsorted(place, (first + 1) * BUCKET))
        skip = left if int(table.column("ahead")[0].as_py()) else 0
        us, vs = [node[:0]], [node[:0]]
        for i in range(left):
            lo, hi = max(skip, int(np.searchsorted(place, place[i] + low))), int(np.searchsorted(place, place[i] + high))
            y = np.arange(lo, hi)
            y = y[(root[y] != root[i]) & (np.minimum(n[y], n[i]) >= least * np.maximum(n[y], n[i]) - 1e-9)]
            if len(y):
                us.append(np.full(len(y), i))
                vs.append(y)
        x, y = np.concatenate(us).astype(np.int64), np.concatenate(vs).astype(np.int64)
        keep = ~unlike(sketches, n, x, y, least)
        return pa.table({"u": node[x[keep]], "v": node[y[keep]]})

    return dealt.groupBy("key", "block", "ahead").applyInArrow(meet, "u long, v long")


def alike(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (u, v) of nodes whose texts' shingle sets have a Jaccard similarity of at least least."""
    both = pairs.join(texts.toDF("u", "a"), "u").join(texts.toDF("v", "b"), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [jaccard(x.as_py(), y.as_py(), width) >= least for x, y in zip(b.column("a"), b.column("b"), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(same, pa.bool_()))

    return in_batches(both).mapInArrow(run, "u long, v long")


def sketched(texts: DataFrame, width: int) -> DataFrame:
    """node, text and sketch of texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sketch(set_hashes(t.as_py(), width)) for t in b.column("text")], pa.binary())], names=["node", "text", "sketch"])

    return in_batches(texts.select("node", "text")).mapInArrow(run, "node long, text string, sketch binary")


def fingerprint_pairs(sets: DataFrame, distance: int = 3, parts: int = 2) -> DataFrame:
    """(u, v): sets of one fingerprint in a chain, and a set of each fingerprint for each link of the Gray index."""
    chain = sets.select("node", F.lag("node").over(Window.partitionBy("fp").orderBy("node")).alias("v")).filter("v is not null").select(F.col("node").alias("u"), "v")
    heads = sets.groupBy("fp").agg(F.min("node").alias("node"))
    found = links(stored(heads.select("fp")), distance, parts)
    named = found.join(heads.toDF("u", "a"), "u").join(heads.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return _ordered(chain.unionByName(named))


def similar_sets(sets: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame | None:
    """(node, root) of all nodes that links of a similarity of at least least join to others; None if there are none.

    sets has node, n, fp, bands and r, the (none, doc_id, text_key) of a row with that set. The pairs that the Gray index
    finds come first. Then every pair of a bucket is verified unless verified links join it already; nearer places in a
    bucket come first, so that one large group of copies needs as many pairs as it has members.
    """
    close = stored(fingerprint_pairs(sets.select("node", "fp")))
    members = sets.select("node", "n", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("key")
    members = stored(members.join(shared, "key", "left_semi"))
    ends = close.select(F.col("u").alias("node")).unionByName(close.select(F.col("v").alias("node"))).unionByName(members.select("node")).distinct()
    used = ends.join(sets, "node").select("node", F.col("r.doc_id").alias("d"), F.col("r.text_key").alias("k"))
    own = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    texts = stored(sketched(own.join(used, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))).dropDuplicates(["node"]), width))
    words, marks = texts.select("node", "text"), texts.select("node", "sketch")
    found = None
    tried, pairs, low, high = close, close, 0, 1
    while True:
        swept(docs.sparkSession)
        passed = stored(alike(pairs, words, width, least))
        if n := passed.count():
            # what is joined already goes in as a star
            stars = passed.unionByName(found.select(F.col("node").alias("u"), F.col("root").alias("v"))) if found else passed
            n += found.count() if found else 0
            found, last = stored(components(stars).coalesce(-(-n // FILE_EDGES))), found
            dropped(last)
            swept(docs.sparkSession)
        # the index is done; now the buckets, further and further apart
        low, high = high, 2 if low == 0 else high * STRIDE
        now = members.select("key", "node", "n")
        now = now.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")) if found else now.withColumn("root", F.col("node"))
        split = now.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("m")).filter((F.col("a") < F.col("b")) & (F.col("m") > low))
        if not split.limit(1).count():
            dropped(members, texts)
            return found
        marked = now.join(split.select("key"), "key", "left_semi").join(marks, "node")
        pairs = stored(_ordered(bucket_pairs(marked, low, high, least)).join(tried, ["u", "v"], "left_anti"))
        tried = tried.unionByName(pairs)


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, parts: int = 2) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp, root (a fingerprint that names the component) and component_id (the
    smallest doc_id reachable over links) of every row of docs (doc_id, text, and others).

    Rows with a null doc_id are linked like others; where a component has no other rows its id is null. Repeated rows
    stay repeated. An empty table gives an empty result.
    """
    own = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    rows = stored(fingerprints(own, width, keep=("doc_id", "text_key")))
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    edges = links(nodes.select("fp"), distance, parts)
    found = components(edges)
    linked = nodes.join(found, nodes.fp == found.node, "left")
    of_fp = linked.select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    least_id = of_fp.filter(F.col("root") != F.col("fp")).groupBy("root").agg(F.min("first_id").alias("rest_id"))
    heads = of_fp.filter("fp = root").select("root", "first_id").join(least_id, "root", "left").select("root", F.least("first_id", "rest_id").alias("component_id"))
    named = of_fp.select("fp", "root").join(heads, "root")
    hot = hot_keys(nodes, "fp", nodes.agg(F.sum("n")).first()[0] or 0)
    return spread_join(rows, named, "fp", hot, F.xxhash64("doc_id", "text_key")).select("doc_id", "text_key", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each component of links of Jaccard similarity least: that of smallest doc_id (null ids last), then of smallest text hash."""
    rows = stored(shingle_sets(docs, width))
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    sets = stored(rows.groupBy("node").agg(F.min(one).alias("r"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    found = similar_sets(sets, docs, width, least)
    rooted = sets.select("node", "r").join(found, "node", "left").select(F.coalesce("root", "node").alias("root"), "r") if found else sets.select(F.col("node").alias("root"), "r")
    kept = stored(rooted.groupBy("root").agg(F.min("r").alias("r")).select("r.doc_id", "r.text_key"))
    out = docs.join(kept.toDF("__id", "__key"), F.col("doc_id").eqNullSafe(F.col("__id")) & (text_key(F.col("text")) == F.col("__key")), "left_semi")
    repeated = docs.select("doc_id", text_key(F.col("text")).alias("k")).groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out
