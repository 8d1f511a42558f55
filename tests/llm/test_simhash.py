import random
import re

import numpy as np
import pytest
import xxhash

from canopy.llm import simhash as S


def brute(fps):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    fps = [0, (1 << 64) - 1]
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 6, 40])):
            fps.append(f)
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                f ^= 1 << rng.randrange(64)
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(sorted({(r[0],) for r in rows}), "fp long")
    for distance, parts in ((3, 2), (3, 4), (3, 1)):
        found = {r["node"]: r["root"] for r in S.components(S.links(nodes, distance, parts)).collect()}
        root = [found.get(f, f) for f, _ in rows]
        want = brute(fps)
        assert len(set(zip(root, want))) == len(set(root)) == len(set(want))


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(5, "One two three", 1), (2, "one TWO\tthree", 1), (9, None, 1), (7, "", 1), (None, "alone here", 1), (3, long, 1), (4, long + " more", 1), (5, "One two three", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = {(r["doc_id"], r["component_id"]) for r in S.near_duplicates(docs).collect()}
    assert {(5, 2), (2, 2), (9, 7), (7, 7), (None, None)} <= got
    assert S.near_duplicates(docs).count() == 8
    assert S.near_duplicates(docs.limit(0)).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("cut", [S.SLICE, 7])
def test_fingerprints_against_brute_force(spark, monkeypatch, cut):
    monkeypatch.setattr(S, "SLICE", cut)
    rng = random.Random(8)
    texts = [None, "", " \t\x0b", "One", "one TWO", "a b a b a b a b", "É é\u00a0x y\u2003z ñ", *(" ".join(rng.choice("abcdE") for _ in range(rng.randrange(3, 60))) for _ in range(60))]
    for t in texts:
        assert S.simhash(t) == brute_fingerprint(t), t
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in S.fingerprints(docs).collect()} == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


def test_hubs_are_dealt(spark, monkeypatch):
    from canopy.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(S, "FILE_EDGES", 10)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(20)] + [(300, 59)]
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in [*range(60), 300]} | {i: 100 for i in range(100, 121)}
    rows = [(i, "the same text of several words" if i % 2 else f"text of its own number {i} and {i * 7}") for i in range(60)]
    found = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == 1 for i in range(1, 60, 2)) and len(found) == 60


def jobs_of(spark, work):
    """What work returns, and how many Spark jobs it took."""
    sc, group = spark.sparkContext, f"jobs-{random.random()}"
    sc.setJobGroup(group, group)
    try:
        return work(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_few_edges_are_settled_at_once(spark):
    edges = [(i, i + 1) for i in range(0, 3000) if i % 1000 != 999] + [(9, -5), (-(1 << 62), 2500), (7, 7), (8, 9), (9, 8)]
    table = spark.createDataFrame(edges, "u long, v long")
    got, jobs = jobs_of(spark, lambda: {r["node"]: r["root"] for r in S.components(table).collect()})
    want = {i: -5 if i < 1000 else 1000 if i < 2000 else -(1 << 62) for i in range(3000)} | {-5: -5, -(1 << 62): -(1 << 62)}
    assert got == want and jobs <= 12
    assert S.components(table.filter("u = 7 and v = 7")).count() == 0


def test_sketches_pass_over_no_true_pair():
    rng = np.random.default_rng(2)
    sets = []
    for n in (1, 3, 40, 64, 65, 200, 1000):
        base = rng.integers(0, 1 << 64, n, np.uint64)
        for share in (0.0, 0.05, 0.1, 0.2, 0.3, 0.6):
            keep = base[rng.random(n) >= share]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 64, int(n * share), np.uint64), base[:1]])))
    sketches, n = [np.frombuffer(S.sketch(s), np.uint8) for s in sets], np.array([len(s) for s in sets])
    x, y = (a.ravel() for a in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    jaccard = np.array([len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i, j in zip(x, y)])
    gone = S.unlike(sketches, n, x, y, 0.8)
    near = np.minimum(n[x], n[y]) >= 0.8 * np.maximum(n[x], n[y])
    assert not gone[jaccard >= 0.8].any() and gone[near & (jaccard < 0.5) & (n[x] > 30)].mean() > 0.9


@pytest.mark.parametrize("block", [3, 2048])
def test_buckets_give_every_pair_once_in_its_round(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BUCKET", block)
    mark = S.sketch(np.arange(5, dtype=np.uint64))
    rows = [(7, i, 5, i, mark) for i in range(25)] + [(8, i, 5, 0, mark) for i in range(4)]
    buckets = spark.createDataFrame(rows, "key long, node long, n long, root long, sketch binary")
    for low, high in ((1, 2), (2, 9), (9, 40)):
        got = sorted((r["u"], r["v"]) for r in S.bucket_pairs(buckets, low, high, 0.8).collect())
        assert sorted(tuple(sorted(p)) for p in got) == [(i, j) for i in range(25) for j in range(i + low, min(25, i + high))]
