"""Approximate maximum inner product search with score-aware (anisotropic) quantisation.

A bounded sample gives cells (k-means) and, for residuals in subspaces of two components, codebooks of sixteen centres.
Their loss weighs the part of the error along a vector more than the part across it, since that is what changes large
inner products. Every row is indexed: its cell and its four-bit codes. A query visits the cells with the largest
products with their centres; there a table of its products with all centres, two codes to a byte, scores all rows, and
the best go to an exact comparison of original vectors, with all that the error met there leaves possible. How many cells
a query visits is measured on the sample, by rows that ask.

Neighbouring cells make blocks of bounded size, larger than the depth of the exact comparison; a cell that is larger is
dealt to several. Rows and queries meet in tasks for one block and a bounded number of its queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bounds of the sample that fits the index, and of its rows that measure recall.
SAMPLE, TRIALS = 16_384, 256
#: Cells at most; rows of a block and queries of a task, about.
MOST_CELLS, BLOCK_ROWS, BLOCK_QUERIES = 2048, 8192, 512
#: Recall that the visits should reach on the sample; vectors of a block compared exactly for each one wanted, at most and at least.
RECALL, RERANK, LEAST = 0.97, 8, 3
#: Products above this share of the vectors' norms are those whose error counts (the threshold of the weight).
THRESHOLD = 0.2


@dataclass
class Index:
    cells: np.ndarray  # (cells, d)
    books: np.ndarray  # (m, 16, w)
    eta: float
    visits: int

    @property
    def d(self) -> int:
        return self.cells.shape[1]


def padded(x: np.ndarray) -> np.ndarray:
    """x with an even number of components."""
    return x if x.shape[1] % 2 == 0 else np.hstack([x, np.zeros((len(x), 1), x.dtype)])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(x[a : a + 4096] @ centres.T - half).argmax(axis=1) for a in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means; centres that lose all rows stay where they are."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def coded(r: np.ndarray, u: np.ndarray, books: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes of residuals r of vectors with directions u, by coordinate descent on the anisotropic loss."""
    m, _, w = books.shape
    r3, u3 = r.reshape(len(r), m, w), u.reshape(len(r), m, w)
    codes = np.empty((len(r), m), np.uint8)
    along = np.zeros(len(r))
    for k in range(rounds + 1):
        for j in range(m):
            gap = r3[:, j, None, :] - books[j][None]
            square, part = (gap * gap).sum(axis=2), (gap * u3[:, j, None, :]).sum(axis=2)
            if k:
                along -= np.take_along_axis(part, codes[:, j, None].astype(np.int64), axis=1)[:, 0]
                best = (square + (eta - 1) * (along[:, None] + part) ** 2).argmin(axis=1)
            else:
                best = (square + (eta - 1) * part**2).argmin(axis=1)
            codes[:, j] = best
            along += np.take_along_axis(part, best[:, None], axis=1)[:, 0]
    return codes


def codebooks(r: np.ndarray, u: np.ndarray, eta: float, rng: np.random.Generator, rounds: int = 4) -> np.ndarray:
    """Codebooks that lower the anisotropic loss, alternating codes and weighted centres."""
    w = 2
    m = r.shape[1] // w
    books = np.zeros((m, 16, w))
    for j in range(m):
        found = means(r[:, j * w : (j + 1) * w], 16, rng, 6)
        books[j, : len(found)] = found
    r3, u3 = r.reshape(len(r), m, w), u.reshape(len(r), m, w)
    for _ in range(rounds):
        codes = coded(r, u, books, eta, 1)
        gap = r3 - books[np.arange(m)[None, :], codes]
        along = (gap * u3).sum(axis=(1, 2))
        for j in range(m):
            own = (gap[:, j] * u3[:, j]).sum(axis=1)
            rest = along - own
            weight = np.eye(w)[None] + (eta - 1) * u3[:, j, :, None] * u3[:, j, None, :]
            aim = r3[:, j] + (eta - 1) * u3[:, j] * ((u3[:, j] * r3[:, j]).sum(axis=1) + rest)[:, None]
            left, right = np.zeros((16, w, w)), np.zeros((16, w))
            np.add.at(left, codes[:, j], weight)
            np.add.at(right, codes[:, j], aim)
            used = np.bincount(codes[:, j], minlength=16) > 0
            books[j, used] = np.linalg.solve(left[used] + 1e-9 * np.eye(w), right[used][:, :, None])[:, :, 0]
            gap[:, j] = r3[:, j] - books[j][codes[:, j]]
            along = rest + (gap[:, j] * u3[:, j]).sum(axis=1)
    return books


def fit(x: np.ndarray, total: int, k: int, recall: float = RECALL, seed: int = 11, asked: np.ndarray | None = None) -> Index:
    """An index for total rows from a sample of them; how much to visit is measured by asked vectors, else by some of the sample."""
    rng = np.random.default_rng(seed)
    x = padded(np.unique(x, axis=0).astype(np.float64))
    cells = means(x, int(np.clip(round(total**0.5), 1, min(MOST_CELLS, max(1, len(x) // 8)))), rng)
    at = nearest(x, cells)
    d = x.shape[1]
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    books = codebooks(x - cells[at], directions(x), eta, rng)
    # visits: until the cells of the sample's true neighbours are among the best ones; a vector is no neighbour of its own
    trial = x[rng.choice(len(x), min(TRIALS, len(x)), replace=False)] if asked is None or not len(asked) else padded(asked.astype(np.float64))
    order = np.argsort(-(trial @ cells.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(cells))[None, :], axis=1)
    product, own = trial @ x.T, {v.tobytes(): i for i, v in enumerate(x)}
    for i, v in enumerate(trial):
        if len(x) > 1 and v.tobytes() in own:
            product[i, own[v.tobytes()]] = -np.inf
    top = np.argsort(-product, axis=1, kind="stable")[:, : max(1, min(k, len(x) - 1))]
    need = np.sort(np.take_along_axis(place, at[top], axis=1).ravel())
    visits = int(need[min(len(need) - 1, int(recall * len(need)))]) + 1
    return Index(cells, books, eta, visits)


def pairs_of(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    if codes.shape[1] % 2:
        codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
    return codes[:, ::2] | (codes[:, 1::2] << 4)


def scan_tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """A query's products with all centres, for each byte of two codes."""
    m, _, w = books.shape
    one = (books * q.reshape(m, 1, w)).sum(axis=2)
    if m % 2:
        one = np.vstack([one, np.zeros((1, 16))])
    return (one[::2, None, :] + one[1::2, :, None]).reshape(-1, 256).astype(np.float32)


class Block:
    """The rows of a block: distinct vectors with their codes, in order of cells, and the ids that have each vector."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, packed: np.ndarray, cell: np.ndarray):
        order = np.lexsort((ids, cell))
        ids, x, packed, cell = ids[order], x[order], packed[order], cell[order]
        _, first, of = np.unique(x, axis=0, return_index=True, return_inverse=True)
        # distinct vectors keep the order of cells: equal vectors share a cell
        by = np.argsort(first, kind="stable")
        place = np.empty_like(by)
        place[by] = np.arange(len(by))
        of, first = place[of.ravel()], first[by]
        rows = np.argsort(of, kind="stable")
        self.ids, self.begin = ids[rows], np.searchsorted(of[rows], np.arange(len(first) + 1))
        self.kinds, self.codes, self.cells = x[first], np.ascontiguousarray(packed[first].T), cell[first]

    def places(self, cells: np.ndarray) -> np.ndarray:
        """Places of the distinct vectors in these cells."""
        lo, hi = np.searchsorted(self.cells, cells, "left"), np.searchsorted(self.cells, cells, "right")
        return np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)] or [np.zeros(0, np.int64)])

    def best(self, query: int, q: np.ndarray, cells: np.ndarray, index: Index, k: int, sure: bool = False) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(ids, products, vectors scanned, vectors compared): the k best rows in these cells but for the query's own.

        All of their vectors are scored by the four-bit tables; the best quarter is compared exactly, but at least
        LEAST and at most RERANK vectors for each one wanted. If that is to be sure, so are all others that could be
        among the best by the largest error of the tables met so far, however many they are.
        """
        seen = self.places(cells)
        if not len(seen):
            return np.zeros(0, np.int64), np.zeros(0), 0, 0
        table = scan_tables(padded(q[None])[0], index.books)
        rough = (index.cells @ padded(q[None])[0])[self.cells[seen]].astype(np.float32)
        for j in range(len(self.codes)):
            rough += table[j][self.codes[j][seen]]
        most = min(RERANK * (k + 1), max(LEAST * (k + 1), len(seen) // 4))
        some = seen[np.argpartition(-rough, most)[:most]] if len(seen) > most else seen
        exact = (self.kinds[some] * q).sum(axis=1)
        while sure and len(some) < len(seen):
            # distinct vectors have an id each at least, one of which may be the query's own
            least = np.partition(exact, -(k + 1))[-(k + 1)] if len(some) > k else -np.inf
            at = np.searchsorted(seen, some)
            more = rough >= least - np.abs(exact - rough[at]).max()
            more[at] = False
            if not more.any():
                break
            some = np.concatenate([some, seen[more]])
            exact = np.concatenate([exact, (self.kinds[seen[more]] * q).sum(axis=1)])
        found, last = {}, np.inf
        for t in np.lexsort((self.ids[self.begin[some]], -exact)):
            # until there are enough, ties of the last one included
            if len(found) >= k and exact[t] < last:
                break
            last = exact[t]
            # of equal vectors no more than can be wanted, with a place for the query's own id
            for i in np.unique(self.ids[self.begin[some[t]] : self.begin[some[t] + 1]])[: k + 1].tolist():
                if i != query:
                    found.setdefault(i, exact[t])
        ids, scores = np.array(list(found), np.int64), np.array(list(found.values()), np.float64)
        top = np.lexsort((ids, -scores))[:k]
        return ids[top], scores[top], len(seen), len(some)


def plan_blocks(index: Index, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block of each cell, and how many blocks its rows are dealt to.

    Cells go to blocks in the order of a walk from each to the nearest one left, so that a query's cells are in few blocks.
    """
    left = np.flatnonzero(sizes > 0)
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    block, held, at = 0, 0, None
    while len(left):
        near = 0 if at is None else int(((index.cells[left] - index.cells[at]) ** 2).sum(axis=1).argmin())
        at, left = left[near], np.delete(left, near)
        if held and held + sizes[at] > BLOCK_ROWS:
            block, held = block + 1, 0
        first[at], parts[at] = block, max(1, -(-int(sizes[at]) // BLOCK_ROWS))
        if parts[at] > 1:
            block, held = block + int(parts[at]), 0
        else:
            held += sizes[at]
    return first, parts


def usable(vector: Column, size: int | None = None) -> Column:
    """Not null, not zero, and of finite components."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(vector, lambda v: v != 0)
    return vector.isNotNull() & fine & (F.size(vector) == size if size else F.size(vector) > 0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def searched(vectors: DataFrame, wanted: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows found for each row that ``wanted`` picks, never the row itself.

    Rows whose vector is null, zero, not finite or not of the commonest length, or whose id is null, take no part. Ties
    go to the smaller vec_id. Where there are fewer than k others, all are returned. An id that several rows have is one
    row of the result, with the largest product of its vectors; as a query it asks with the smallest of its vectors.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.filter(F.col(vec_id).isNotNull() & usable(F.col(vector)))
    lengths = rows.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    d, total = lengths[0]["d"], lengths[0]["n"]
    own = rows.filter(F.size(vector) == d).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(wanted, F.lit(False)).alias("asks"))
    grain = 1 << 20
    some = own.filter(F.pmod(F.xxhash64(F.lit("ann"), "vec_id", "v"), F.lit(grain)) < min(grain, -(-SAMPLE * grain // total))).select("vec_id", "v").distinct().collect()
    some.sort(key=lambda r: (r["vec_id"], r["v"]))
    # rows that ask may lie elsewhere than the rest: they say how much to visit
    trial = own.filter("asks").select("vec_id", "v").distinct().orderBy(F.xxhash64(F.lit("trial"), "vec_id", "v"), "vec_id", "v").limit(TRIALS).collect()
    index = fit(np.array([r["v"] for r in some] or [[0.0] * d]), total, k, recall, asked=np.array([r["v"] for r in trial]))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                x = padded(_matrix(part.column("v"), d))
                cell = nearest(x, index.cells)
                codes = pairs_of(coded(x - index.cells[cell], directions(x), index.books, index.eta))
                cols = [part.column("vec_id"), part.column("v"), part.column("asks"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "asks", "cell", "codes"])

    placed = stored(own.mapInArrow(indexed, "vec_id long, v array<double>, asks boolean, cell int, codes binary"))
    sizes = np.zeros(len(index.cells), np.int64)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["cell"]] = r["n"]
    first, parts = plan_blocks(index, sizes)

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block that a query visits, with its cells there."""
        for b in batches:
            q = padded(_matrix(b.column("v"), d))
            order = np.argsort(-(q @ index.cells.T), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            # enough cells for k rows whatever the visits
            n = np.maximum(index.visits, (held < min(4 * (k + 1), total)).sum(axis=1) + 1)
            at, blocks, cells = [], [], []
            for i in range(len(q)):
                mine = order[i, : n[i]]
                mine = np.sort(mine[sizes[mine] > 0])
                spread = np.repeat(first[mine], parts[mine]) + np.concatenate([np.arange(p) for p in parts[mine]] or [np.zeros(0, np.int64)])
                each = np.repeat(mine, parts[mine])
                for x in np.unique(spread):
                    at.append(i)
                    blocks.append(x)
                    cells.append(each[spread == x].astype("<i4").tobytes())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("v").take(at), pa.array(blocks, pa.int32()), pa.array(cells, pa.binary())], names=["query_id", "q", "block", "cells"])

    queries = placed.filter("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    visits = stored(queries.mapInArrow(visiting, "query_id long, q array<double>, block int, cells binary"))
    asked = {r["block"]: r["n"] for r in visits.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    # as many rows as there are blocks or cells
    loads = F.broadcast(spark.createDataFrame([(int(c), int(-(-n // BLOCK_QUERIES))) for c, n in asked.items()], "block int, query_parts int"))
    homes = F.broadcast(spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in range(len(sizes))], "cell int, first int, parts int"))
    home = (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).cast("int")
    left = placed.join(homes, "cell").select(home.alias("block"), "vec_id", "v", "codes", "cell").join(loads, "block")
    left = left.select("block", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("part"), "vec_id", "v", "codes", "cell")
    right = visits.join(loads, "block").select("block", F.pmod(F.xxhash64("query_id"), F.col("query_parts")).cast("int").alias("part"), "query_id", "q", "cells")

    def meet(rows_: pa.Table, queries_: pa.Table) -> pa.Table:
        out: list = []
        if len(rows_) and len(queries_):
            ids = rows_.column("vec_id").to_numpy()
            packed = np.frombuffer(b"".join(rows_.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            block = Block(ids, _matrix(rows_.column("v").combine_chunks(), d), packed, rows_.column("cell").to_numpy())
            q = _matrix(queries_.column("q").combine_chunks(), d)
            for i, (query, cells) in enumerate(zip(queries_.column("query_id").to_pylist(), queries_.column("cells").to_pylist(), strict=True)):
                found, scores, _, _ = block.best(query, q[i], np.frombuffer(cells, "<i4"), index, k, sure=True)
                out.append((np.full(len(found), query), found, scores))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    keys = ("block", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    # an id with several vectors may come from several blocks
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
