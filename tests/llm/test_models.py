import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import ann, langid, quality


def test_mips_recall_ties_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[300:700] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [float("inf")] * 16), (2080, [1.0] * 3), (2100, []), (2120, [None] * 16)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, score string")
    got = ann.searched(df, F.col("vec_id") % 20 == 0, 20).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 1500, 20))
    wide, hits = x.astype(np.float64), 0
    for q, found in by.items():
        s = wide @ wide[q]
        order = [i for i in np.lexsort((np.arange(1500), -np.round(s, 9))) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert np.allclose([f[2] for f in found], s[[f[1] for f in found]], rtol=1e-12, atol=1e-12)
        hits += len(set(order) & {f[1] for f in found})
    assert hits / (20 * len(by)) >= 0.95
    few = ann.searched(df.filter("vec_id < 4"), F.col("vec_id") % 2 == 0, 20).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in few) == [(a, b) for a in (0, 2) for b in range(4) if a != b]
    assert ann.searched(df.limit(0), F.lit(True), 20).count() == 0


def test_mips_repeated_ids(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    # equal rows, and one id with two vectors: as a query the smaller of them asks, as a candidate the larger product counts
    rows += [rows[0], rows[7], (20, (x[20] + 1).tolist())]
    got = {}
    for r in ann.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, found in got.items():
        asks = min(v for i, v in rows if i == q)
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max(best.get(i, -1e9), float(np.dot(v, asks)))
        want = sorted(best.items(), key=lambda t: (-t[1], t[0]))[:20]
        assert [f[0] for f in sorted(found)] == list(range(1, 21)) and len({f[1] for f in found}) == 20
        assert [f[1] for f in sorted(found)] == [w[0] for w in want]


@pytest.mark.parametrize("n", [600, 2000, 6000])
def test_scan_ranks_more_than_is_compared(n):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 32)) + 0.4 * rng.normal(size=(20, 32))[rng.integers(0, 20, n)]
    ids = np.arange(n)
    index = ann.fit(x, n, 20)
    cell = ann.nearest(x, index.cells)
    packed = ann.pairs_of(ann.coded(x - index.cells[cell], ann.directions(x), index.books, index.eta))
    block = ann.Block(ids, x, packed, cell)
    hits = there = 0
    for q in range(0, n, n // 40):
        cells = np.sort(np.argsort(-(index.cells @ x[q]), kind="stable")[: index.visits])
        found, _, scanned, compared = block.best(q, x[q], cells, index, 20)
        assert scanned > compared == min(ann.RERANK * 21, max(ann.LEAST * 21, scanned // 4))
        score = x @ x[q]
        score[q] = -np.inf
        seen = [i for i in np.argsort(-score)[:20] if cell[i] in set(cells.tolist())]
        there += len(seen)
        hits += len(set(seen) & set(found.tolist()))
    assert hits >= 0.95 * there > 0


def test_mips_of_queries_that_lie_elsewhere(spark):
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(100, 32))[rng.integers(0, 100, 4000)] + 0.01 * rng.normal(size=(4000, 32))).astype(np.float32)
    x[::20] = rng.normal(size=(200, 32))
    got: dict = {}
    for r in ann.searched(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    score = x[::20].astype(np.float64) @ x.astype(np.float64).T
    score[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    assert np.mean([len(got[20 * i] & set(np.argsort(-s)[:20].tolist())) / 20 for i, s in enumerate(score)]) >= 0.93


def test_sure_scan_misses_nothing_of_heavy_norms():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32)) * np.exp(3 * rng.normal(size=(3000, 1)))
    index = ann.fit(x, 3000, 20)
    cell = ann.nearest(x, index.cells)
    block = ann.Block(np.arange(3000), x, ann.pairs_of(ann.coded(x - index.cells[cell], ann.directions(x), index.books, index.eta)), cell)
    hits = []
    for q in range(0, 3000, 50):
        score = x @ x[q]
        score[q] = -np.inf
        hits.append(len(set(np.argsort(-score)[:20].tolist()) & set(block.best(q, x[q], np.arange(len(index.cells)), index, 20, sure=True)[0].tolist())))
    assert np.mean(hits) >= 19.9


def test_blocks_hold_cells_whole_or_dealt():
    index = ann.Index(np.random.default_rng(1).normal(size=(50, 4)), np.zeros((2, 16, 2)), 1.0, 5)
    sizes = np.random.default_rng(2).integers(0, 3000, 50)
    sizes[7] = 5 * ann.BLOCK_ROWS + 1
    first, parts = ann.plan_blocks(index, sizes)
    load = {}
    for c in np.flatnonzero(sizes):
        for k in range(parts[c]):
            load[first[c] + k] = load.get(first[c] + k, 0) + sizes[c] / parts[c]
    assert parts[7] == 6 and max(load.values()) <= ann.BLOCK_ROWS and sorted(load) == list(range(len(load)))


def words(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(n))


def test_language_on_held_out_texts(spark):
    rng = np.random.default_rng(5)
    alphabets = {"aa": "abcdefgé", "bb": "hijklmnñ", "cc": "opqrstuv"}
    rows = [(i, words(rng, alphabets[lang], int(rng.integers(1, 200))), lang) for i in range(300) for lang in [list(alphabets)[i % 3]]]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", "cc"), (1003, "abcabc abc", None), (None, "hihihi jklm", "bb"), (1004, "op qr st " * 4000, "cc")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows + odd + rows[:2]], "doc_id long, text string, lang string, score double")
    model = langid.fitted(docs)
    got = langid.identified(docs, model, ("doc_id", "lang")).withColumn("third", langid.third(F.col("doc_id"))).collect()
    assert len(got) == len(rows) + len(odd) + 2
    held = [r for r in got if r["third"] == 1 and r["doc_id"] < 1000]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.9
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert (by[1003]["lang_pred"], by[None]["lang_pred"], by[1004]["lang_pred"]) == ("aa", "bb", "cc")
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.fitted(docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identified(docs, None).collect()} == {"und"}


def test_every_language_is_learned(spark):
    # 150 languages of one letter each: none is left out, however many there are
    rows = [(10 * k + j, chr(0x4E00 + k) * 60, f"l{k:03}") for k in range(150) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fitted(docs, sample=1500)
    assert len(model.langs) == 150


def test_prediction_equals_a_plain_network():
    rng = np.random.default_rng(9)
    model = langid.train([(k, bytes(rng.integers(97, 104, 200).astype(np.uint8)) if k == "a" else bytes(rng.integers(104, 110, 200).astype(np.uint8))) for k in "ab" for _ in range(10)], rounds=1)
    data = bytes(rng.integers(97, 110, 700).astype(np.uint8))
    total = np.zeros(2)
    for at in range(0, max(1, len(data) - max(langid.WIDTHS) + 1), langid.STEP):
        window = [*data[at : at + langid.WINDOW]]
        size = max(1, len(window))
        window += [256] * (langid.WINDOW - len(window))
        pooled = []
        for w, f in model.filters.items():
            for k in range(langid.FILTERS):
                pooled.append(max(sum(model.embedding[window[i + j]] @ f[j, :, k] for j in range(w)) for i in range(langid.WINDOW - w + 1)))
        z = np.maximum(np.array(pooled) + model.bias, 0) @ model.out + model.out_bias
        total += size * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    lang, score = langid.predicted(data, model, model.tables())
    assert lang == model.langs[int(total.argmax())] and abs(score - total.max() / total.sum()) < 1e-4


def test_windows_cover_whole_texts():
    for n in (0, 1, 255, 256, 257, 1000, 5000):
        x, sizes = langid.windows(b"\x07" * n)
        covered = np.zeros(max(n, 1), bool)
        for k in range(len(x)):
            covered[k * langid.STEP : k * langid.STEP + langid.WINDOW] = True
        assert covered.all() and (x != 256).sum() >= n and sizes.min() >= 1


def test_quality_on_held_out_labels(spark):
    rng = np.random.default_rng(6)
    good = [words(rng, "abcdefghij", 60) + ".\n" + words(rng, "abcdefghij", 30) for _ in range(400)]
    bad = [(words(rng, "ABCDEFGH", 40) + "!! ") * 2 for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(None, good[0]), (900, None), (901, ""), (902, "x" * 200_000)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(i < 400)) for i in range(480) if i % 2] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.fitted(docs, labels)
    assert 0.6 <= model.prior <= 0.98
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs.select("doc_id", "text"), model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows)
    assert np.mean([got[i] >= quality.ACCEPT for i in range(400)]) >= 0.95 and np.mean([got[i] < quality.ACCEPT for i in range(400, 480)]) >= 0.95
    assert quality.fitted(docs, labels.limit(0)) is None and quality.fitted(docs.limit(0), labels) is None
    assert {r["score"] for r in quality.scored(docs, None).collect()} == {0.5}


def test_descent_lowers_the_non_negative_risk():
    rng = np.random.default_rng(3)
    p, u = rng.normal(1, 1, (300, 4)), np.vstack([rng.normal(1, 1, (200, 4)), rng.normal(-1, 1, (200, 4))])

    def risk(w, b):
        loss = lambda z: np.logaddexp(0, -z).mean()
        zp, zu = p @ w + b, u @ w + b
        return 0.5 * loss(zp) + max(0.0, loss(-zu) - 0.5 * loss(-zp))

    w, b = quality.descend(p, u, 0.5)
    assert risk(w, b) < 0.75 * risk(np.zeros(4), 0.0)
    for _ in range(30):
        # no small step does clearly better: the decay of the weights costs a little
        assert risk(w + rng.normal(0, 0.05, 4), b + rng.normal(0, 0.05)) > risk(w, b) - 0.02


def test_quality_sample_reaches_the_driver_without_rows_of_features(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    asked, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: asked.append(self.columns) or collect(self))
    texts = [(i, f"A sentence of words, number {i}." if i % 2 else f"{i} $$$ ### {i * 7} @@@") for i in range(400)]
    docs = spark.createDataFrame([*texts, texts[1]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 200, 2)], "doc_id long, quality int")
    model = quality.fitted(docs, labels)
    assert asked and not any("features" in columns for columns in asked)
    good, free = ([quality.features(t) for i, t in texts if (zlib.crc32(str(i).encode()) % 4 != 2) and (i < 200 and i % 2 == 1) == of] for of in (True, False))
    want = quality.fit(np.array(good), np.array(free))
    assert np.allclose(model.mean, want.mean) and np.allclose(model.scale, want.scale)


def test_quality_samples_prefer_no_ids_and_a_score_column_gives_way(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text number ', id) as text", "'mine' as score")
    labels = spark.range(3000).filter("id % 3 = 0").selectExpr("id as doc_id", "1 as quality")
    ids = [r["doc_id"] for r in quality._sample(docs.select("doc_id"), "quality-u", 3000, 300).orderBy("place").limit(300).collect()]
    assert 250 <= len(ids) and 1200 < np.mean(ids) < 1800
    out = quality.scored(docs, quality.fitted(docs, labels, 100, 100))
    assert out.columns == ["doc_id", "text", "score"] and dict(out.dtypes)["score"] == "double" and out.count() == 3000
    named = docs.selectExpr("cast(doc_id as string) as doc_id", "text")
    assert quality.fitted(named, labels.selectExpr("cast(doc_id as string) as doc_id", "quality"), 100, 100) is not None
