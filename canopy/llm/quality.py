"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled documents give a linear model over byte and word statistics of whole texts. It
minimises the non-negative unbiased risk: positives count with the class prior, unlabelled ones as negatives less the
positives among them, and that part is kept from going below zero. The prior is estimated from the data: the least
ratio, over score thresholds, of unlabelled to held-back positive documents above the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import in_batches

#: Bounds of the samples of trusted positives and of unlabelled documents.
MOST_POSITIVE, MOST_UNLABELLED = 4000, 8000
#: From this score a document is good.
ACCEPT = 0.7

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Byte statistics are for each ASCII byte, and one for all others.
N_BYTES, N_OTHER = 129, 16
N_FEATURES = N_BYTES + N_OTHER


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(text: str | None) -> np.ndarray:
    """Statistics of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES)
    if not raw:
        return out
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256).astype(float)
    n = len(data)
    out[:128] = np.sqrt(counts[:128] / n)
    out[128] = np.sqrt(counts[128:].sum() / n)
    starts, ends = W.bounds(data)
    lengths = ends - starts
    blocks = raw.split()
    lines = raw.split(b"\n")
    letters = counts[_UPPER].sum() + counts[_LOWER].sum() + counts[128:].sum() + 1e-9
    m, b = max(1, len(lengths)), max(1, len(blocks))
    same_mark = (data[1:] == data[:-1]) & _MARK[data[1:]]
    out[N_BYTES:] = (
        np.log1p(n),
        np.log1p(len(lengths)),
        lengths.sum() / m / 10,
        (lengths > 15).sum() / m,
        (lengths == 1).sum() / m,
        len(set(blocks)) / b,
        len(set(lines)) / len(lines),
        n / len(lines) / 1000,
        counts[_UPPER].sum() / letters,
        counts[_DIGIT].sum() / n,
        counts[_MARK].sum() / n,
        same_mark.sum() / n * 10,
        sum(not (_LOWER[w[-1]] or _UPPER[w[-1]] or w[-1] > 127) for w in blocks) / b,
        sum(bool(_MARK[w[0]]) for w in blocks) / b,
        sum(v == w for v, w in zip(blocks, blocks[1:], strict=False)) / b,
        sum(len(w) == 1 and bool(_MARK[w[0]]) for w in blocks) / b,
    )
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 2e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk of the logistic loss, by Adam over all rows."""
    w = np.zeros(p.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    p1, u1 = np.hstack([p, np.ones((len(p), 1))]), np.hstack([u, np.ones((len(u), 1))])
    for t in range(1, rounds + 1):
        zp, zu = p1 @ w, u1 @ w
        # the losses' means: log(1 + exp(-z)) on positives, log(1 + exp(z)) for taking a row as negative
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        good = -p1.T @ sigmoid(-zp) / len(p) * prior
        bad = u1.T @ sigmoid(zu) / len(u) - prior * (p1.T @ sigmoid(zp)) / len(p)
        g = good + bad if negative >= 0 else -bad
        g[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among unlabelled scores: least ratio of shares above a threshold, with a margin for chance."""
    p, u = np.sort(p), np.sort(u)
    at = np.unique(np.quantile(p, np.linspace(0.0, 0.95, 96)))
    above_p = 1 - np.searchsorted(p, at, "left") / len(p)
    above_u = 1 - np.searchsorted(u, at, "left") / len(u)
    margin = np.sqrt(np.log(40) / (2 * len(u))) + np.sqrt(np.log(40) / (2 * len(p)))
    keep = above_p > 0.05
    best = int(np.argmin((above_u[keep] + margin) / above_p[keep]))
    return float(np.clip(above_u[keep][best] / above_p[keep][best], 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model | None:
    """A model from features; None without rows of either kind."""
    if not len(positive) or not len(unlabelled):
        return None
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    # a first model sees one half of either sample; the prior comes from the other halves
    half, rest = max(1, len(p) // 2), max(1, len(u) // 2)
    w, b = descend(p[:half], u[:rest], 0.5, 200)
    prior = estimated_prior((p[half:] if len(p) > 1 else p) @ w + b, (u[rest:] if len(u) > 1 else u) @ w + b)
    w, b = descend(p, u, prior)
    return Model(mean, scale, w, b, prior)


def quarter(doc_id: Column) -> Column:
    """crc32 of a doc_id's text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _place(name: str) -> Column:
    """A row's place in the sample's order: a hash of its doc_id."""
    return F.xxhash64(F.lit(name), "doc_id")


def _sample(docs: DataFrame, name: str, n: int, most: int) -> DataFrame:
    """doc_id and place of about ``most`` of n rows (half as many again, for chance): those of the lowest hashes."""
    grain = 1 << 20
    return docs.select("doc_id", _place(name).alias("place")).filter(F.pmod(F.xxhash64(F.lit(name), F.lit("share"), "doc_id"), F.lit(grain)) < min(grain, -(-3 * most * grain // (2 * max(1, n)))))


def fitted(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model | None:
    """A model from the documents of the training quarters.

    Positives are documents all of whose labels are 1; unlabelled ones have no label. Both are samples by a hash of
    doc_id, of the given sizes at most, cut in the order of a hash as well, so that no range of ids is preferred. Rows
    with a null doc_id are never learned from; ids may be of any type that both tables share.
    """
    train = F.col("doc_id").isNotNull() & (quarter(F.col("doc_id")) != 2)
    quality = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(train & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("least"))
    good = quality.filter("least = 1").select("doc_id")
    free = docs.select("doc_id").filter(train).distinct().join(quality, "doc_id", "left_anti")
    n_good, n_free = good.count(), free.count()
    chosen = _sample(good, "quality-p", n_good, most_positive).withColumn("p", F.lit(True)).unionByName(_sample(free, "quality-u", n_free, most_unlabelled).withColumn("p", F.lit(False)))
    # about one and a half times the samples' sizes, whatever the input
    wanted = {r["doc_id"]: (r["p"], r["place"]) for r in chosen.collect()}
    if not wanted:
        return None
    kind = docs.select("doc_id").schema.add("p", "boolean").add("place", "long")
    listed = docs.sparkSession.createDataFrame([(i, *how) for i, how in wanted.items()], kind)
    del wanted
    found = featured(docs.select("doc_id", "text").filter(train).join(F.broadcast(listed), "doc_id"), ("doc_id", "p", "place"))
    # one row for each id, however often it occurs; as Arrow batches, which the driver holds once and not as objects
    rows = found.groupBy("doc_id", "p", "place").agg(F.min("features").alias("features")).select("p", "place", "features").toArrow()
    rows = rows.take(pc.sort_indices(rows.column("place")))
    chosen = [rows.filter(kind).slice(0, most).column("features") for kind, most in ((rows.column("p"), most_positive), (pc.invert(rows.column("p")), most_unlabelled))]
    del rows
    return fit(*[np.concatenate([np.zeros(0), *(np.frombuffer(x.as_py(), "<f8") for x in c)]).reshape(-1, N_FEATURES) for c in chosen])


def featured(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns of ``keep`` and ``features``, packed."""
    frame = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    schema = frame.drop("__text").withColumn("features", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [features(t.as_py()).astype("<f8").tobytes() for t in b.column("__text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "features"])

    return in_batches(frame).mapInArrow(run, schema)


def scored(docs: DataFrame, model: Model | None, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for every row; 0.5 for all without a model. A null text counts as empty.

    A column of docs that has the score's name gives way to it.
    """
    own = docs.drop(score)
    names = own.columns
    schema = own.withColumn(score, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(names.index(text))]).reshape(-1, N_FEATURES)
            s = model.scores(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*names, score])

    return in_batches(own).mapInArrow(run, schema)
