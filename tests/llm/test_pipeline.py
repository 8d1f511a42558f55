import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from canopy.llm import simhash


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 8)))
    base = [" ".join(word() for _ in range(250)) for _ in range(40)]
    rows, group = [], []
    for g, t in enumerate(base):
        w = t.split()
        for k in range(4 if g % 2 else 1):
            v = list(w)
            if k == 2:
                v[120] = word()
            rows.append((len(rows), " ".join(v)))
            group.append(g)
    rows += [(500, ""), (501, None), (502, "tiny text"), (502, "tiny text"), (None, "nobody's text")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, root string")
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in simhash.deduplicated(docs).collect())
    first = sorted({g: i for i, g in reversed(list(enumerate(group)))}.values())
    assert kept == [-1, *first, 500, 502]
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == names
        n = out.count()
        assert 0.5 * before < n <= before
        docs, before = (out, n) if k < 4 else (docs, n)
    empty = spark.read.parquet(f"{sf}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def copies_of(seed, families, versions, changes, drift):
    """Texts of 250 words in families: each version changes words of the first one, or (drift) of the one before."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    texts = []
    for _ in range(families):
        first = last = [word() for _ in range(250)]
        texts.append(" ".join(first))
        for _ in range(versions):
            last = list(last if drift else first)
            for at in rng.choice(250, rng.integers(*changes), replace=False):
                last[at] = word()
            texts.append(" ".join(last))
    return texts


def brute_kept(texts):
    """Places that stay, and how many pairs have a similarity of 0.8."""
    sets = [simhash.shingles(t, 5) for t in texts]
    label, links = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links += 1
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return sorted(set(label)), links


def test_near_dedup_finds_similarities_just_over_the_bound(spark):
    texts = copies_of(11, 60, 1, (3, 6), False)
    want, links = brute_kept(texts)
    assert links > 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == want


def test_near_dedup_is_not_misled_by_failing_links(spark):
    texts = copies_of(12, 12, 12, (3, 7), True)
    want, links = brute_kept(texts)
    assert links > 100 and len(want) > 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == want
