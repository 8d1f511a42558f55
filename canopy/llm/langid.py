"""Language identification with a byte-level convolutional network, trained and applied in numpy.

A window of WINDOW bytes goes through byte embeddings, filters of several widths, a maximum over positions for each
filter, and a softmax over languages. A text's windows cover it whole, overlapping by the widest filter; their
probabilities are averaged, weighted by bytes. For prediction the embeddings are multiplied into the filters, so that
a filter's answer is a sum of table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches

#: Bytes in a window; widths of filters; filters of each width; embedding size.
WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 16, 8
#: Bounds of the training sample: texts of one language, texts in all (but no fewer than LEAST_TEXTS of a language, however many languages), and windows of one text.
MOST_TEXTS, MOST_SAMPLE, LEAST_TEXTS, MOST_WINDOWS = 400, 50_000, 20, 3
#: Windows that are scored at once.
BATCH = 64
STEP = WINDOW - max(WIDTHS) + 1


@dataclass
class Model:
    langs: list[str]
    embedding: np.ndarray  # (257, EMBEDDING); row 256 pads
    filters: dict[int, np.ndarray]  # width: (width, EMBEDDING, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width and place in a filter, what each byte adds to it."""
        return {w: [np.ascontiguousarray(self.embedding @ f[j]) for j in range(w)] for w, f in self.filters.items()}


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's windows as numbers of bytes (256 pads) and how many bytes each has."""
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // STEP))
    raw = np.frombuffer(data, np.uint8)
    padded = np.full(STEP * (n - 1) + WINDOW, 256, np.int16)
    padded[: len(raw)] = raw
    sizes = np.clip(len(raw) - STEP * np.arange(n), 1, WINDOW)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP], sizes


def pooled(x: np.ndarray, tables: dict[int, list[np.ndarray]], bias: np.ndarray) -> np.ndarray:
    """The maximum of each filter over positions, and no less than zero."""
    out = []
    for w, table in tables.items():
        n = x.shape[1] - w + 1
        sums = table[0][x[:, :n]]
        for j in range(1, w):
            sums += table[j][x[:, j : n + j]]
        out.append(sums.max(axis=1))
    return np.maximum(np.concatenate(out, axis=1) + bias, 0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, bytes]], seed: int = 7, rounds: int = 6, rate: float = 0.01) -> Model | None:
    """Fits a model to (language, window) samples by Adam; None without samples."""
    langs = sorted({s[0] for s in samples})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    d, k = EMBEDDING, FILTERS
    par = {"e": rng.normal(0, 0.5, (257, d)), "b": np.zeros(k * len(WIDTHS)), "o": rng.normal(0, 0.2, (k * len(WIDTHS), len(langs))), "ob": np.zeros(len(langs))}
    par |= {f"f{w}": rng.normal(0, (w * d) ** -0.5, (w, d, k)) for w in WIDTHS}
    par = {n: v.astype(np.float32) for n, v in par.items()}
    first, second = ({n: np.zeros_like(v) for n, v in par.items()} for _ in range(2))
    x = np.full((len(samples), WINDOW), 256, np.int16)
    for i, (_, t) in enumerate(samples):
        x[i, : min(len(t), WINDOW)] = np.frombuffer(t[:WINDOW], np.uint8)
    y = np.array([langs.index(s[0]) for s in samples])
    weight = (len(y) / np.maximum(np.bincount(y, minlength=len(langs)), 1) / len(langs)).astype(np.float32)
    t = 0
    for r in range(rounds):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            some = order[at : at + BATCH]
            grad = _gradient(par, x[some], y[some], weight)
            t += 1
            now = rate * (0.5 if r >= rounds // 2 else 1)
            for n, g in grad.items():
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.99 * second[n] + 0.01 * g * g
                par[n] -= now * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.99**t)) + 1e-7)
    return Model(langs, par["e"], {w: par[f"f{w}"] for w in WIDTHS}, par["b"], par["o"], par["ob"])


def _gradient(par: dict, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    n, k = len(y), FILTERS
    tops, places = [], {}
    for w in WIDTHS:
        f, m = par[f"f{w}"], WINDOW - w + 1
        sums = (par["e"] @ f[0])[x[:, :m]]
        for j in range(1, w):
            sums += (par["e"] @ f[j])[x[:, j : m + j]]
        places[w] = sums.argmax(axis=1)
        tops.append(np.take_along_axis(sums, places[w][:, None, :], axis=1)[:, 0])
    raw = np.concatenate(tops, axis=1) + par["b"]
    h = np.maximum(raw, 0)
    p = softmax(h @ par["o"] + par["ob"])
    dz = p
    dz[np.arange(n), y] -= 1
    dz *= weight[y][:, None] / n
    grad = {"o": h.T @ dz, "ob": dz.sum(axis=0)}
    dh = (dz @ par["o"].T) * (raw > 0)
    grad["b"] = dh.sum(axis=0)
    grad["e"] = np.zeros_like(par["e"])
    for i, w in enumerate(WIDTHS):
        g, f = dh[:, i * k : (i + 1) * k], par[f"f{w}"]
        df = np.zeros_like(f)
        for j in range(w):
            at = np.take_along_axis(x, places[w] + j, axis=1)  # (n, k): the byte under place j of each filter at its maximum
            df[j] = np.einsum("nkd,nk->dk", par["e"][at], g)
            np.add.at(grad["e"], at.ravel(), (g[:, :, None] * f[j].T[None]).reshape(-1, EMBEDDING))
        grad[f"f{w}"] = df
    return grad


def predicted(data: bytes, model: Model, tables: dict) -> tuple[str, float]:
    """The likeliest language of a whole text and its mean probability."""
    x, sizes = windows(data)
    total = np.zeros(len(model.langs))
    for at in range(0, len(x), BATCH):
        p = softmax(pooled(x[at : at + BATCH], tables, model.bias) @ model.out + model.out_bias)
        total += sizes[at : at + BATCH] @ p
    best = int(total.argmax())
    return model.langs[best], float(min(1.0, total[best] / total.sum()))


def third(doc_id: Column) -> Column:
    """crc32 of a doc_id's text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fitted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MOST_TEXTS, sample: int = MOST_SAMPLE) -> Model | None:
    """A model of every language from documents outside the held-out third.

    It sees about ``most`` texts of each language, fewer where languages are so many that ``sample`` texts in all would
    not do (then ``sample`` over their number, LEAST_TEXTS at least), picked by a hash of doc_id and text, and MOST_WINDOWS
    windows spread over each. The driver holds the languages' names and the sample.
    """
    own = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & (third(F.col(doc_id)) != 1)).select(
        F.col(doc_id).alias("i"), F.col(lang).alias("lang"), F.col(text).alias("body")
    )
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return None
    most = max(LEAST_TEXTS, min(most, sample // len(counts)))
    grain = 1 << 20
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(grain, -(-most * grain // r["n"]))) for r in counts], "lang string, share long")
    body = F.col("body")
    # windows spread over the text, in code points; each is cut to WINDOW bytes later
    begins = [(F.length(body) * k / MOST_WINDOWS).cast("int") + 1 for k in range(MOST_WINDOWS)]
    cut = F.array(*[F.substring(body, b, F.lit(WINDOW)) for b in begins])
    picked = own.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64(F.lit("langid"), "i", "body"), F.lit(grain)) < F.col("share")).filter(body.rlike(r"\p{L}"))
    rows = picked.select("i", "lang", cut.alias("cut")).distinct().collect()
    rows.sort(key=lambda r: (r["i"], r["lang"], r["cut"]))
    return train([(r["lang"], c.encode("utf-8", "surrogatepass")) for r in rows for c in dict.fromkeys(r["cut"]) if c.strip()])


def identified(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of ``keep``, lang_pred and score (0 to 1) of every row.

    Texts that are null or have no letter are ``und`` with score 0, and all are if there is no model.
    """
    body = F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("__text")
    frame = docs.select(*[F.col(c) for c in keep], body)
    schema = frame.drop("__text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else {}
        for b in batches:
            texts = (t.as_py() for t in b.column("__text"))
            found = [("und", 0.0) if t is None or model is None else predicted(t.encode("utf-8", "surrogatepass"), model, tables) for t in texts]
            cols = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, "lang_pred", "score"])

    return in_batches(frame).mapInArrow(run, schema)
