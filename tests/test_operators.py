"""Node store, transactions, collections, structures, search, loaders, lint and streams on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import analytics as A
from canopy.operators import collections as K
from canopy.operators import lint, nodes, search
from canopy.operators.transactions import Transactions
from canopy.sources import loaders
from canopy.streaming import stateful


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def tree(spark):
    return nodes.of_rows(spark, [("^C", ["30"], "a"), ("^C", ["2"], "b"), ("^C", ["A"], "c"), ("^C", ["10"], "d"), ("^Q", ["1", "2"], "x"), ("^Q", ["1"], "y"), ("^Q", ["3", "z", "w"], "q")])


def test_walks(spark, tree):
    by = {r["sub"]: (r["next"], r["previous"]) for r in nodes.siblings(tree).filter("name = '^C'").collect()}
    assert by == {"2": ("10", ""), "10": ("30", "2"), "30": ("A", "10"), "A": ("", "30")}
    walk = {r["ref"]: r["next"] for r in nodes.walk(tree).filter("name = '^Q'").collect()}
    assert walk == {"^Q(1)": "^Q(1,2)", "^Q(1,2)": '^Q(3,"z","w")', '^Q(3,"z","w")': ""}
    deep = nodes.of_rows(spark, [(n, [str(i), str(j)], "") for n in ("^A", "^B") for i in range(40) for j in range(5)])
    refs = [f"{n}({i},{j})" for n in ("^A", "^B") for i in range(40) for j in range(5)]
    after = {r["ref"]: (r["next"], r["previous"]) for r in nodes.walk(deep).collect()}
    for k, ref in enumerate(refs):
        assert after[ref] == (refs[k + 1] if k % 200 != 199 else "", refs[k - 1] if k % 200 else "")
    data = rows(nodes.with_interior(tree).filter("name = '^Q'").select(F.array_join("subs", "/").alias("p"), "data"), "p", "data")
    assert data == [("", 10), ("1", 11), ("1/2", 1), ("3", 10), ("3/z", 10), ("3/z/w", 1)]
    asked = spark.createDataFrame([("^C", [], "10"), ("^C", [], ""), ("^C", [], "15"), ("^C", [], "A"), ("^Q", ["3"], "a"), ("^N", [], "1")], "name string, parent array<string>, sub string")
    assert rows(nodes.order(tree, asked), "name", "sub", "found") == [("^C", "", "2"), ("^C", "10", "30"), ("^C", "15", "30"), ("^C", "A", ""), ("^N", "1", ""), ("^Q", "a", "z")]
    assert rows(nodes.order(tree, asked, backward=True), "name", "sub", "found")[:4] == [("^C", "", ""), ("^C", "10", "2"), ("^C", "15", "10"), ("^C", "A", "30")]
    assert [r["line"] for r in nodes.dump(tree).collect()][:3] == ['^C(2)="b"', '^C(10)="d"', '^C(30)="a"']


def test_changes(spark, tree):
    assert rows(nodes.kill(tree, "^Q", "1"), "value") == [("a",), ("b",), ("c",), ("d",), ("q",)]
    assert nodes.kill(tree, "^Q").count() == 4 and nodes.kill_value(tree, "^Q", "1").count() == 6 and nodes.kill_except(tree, "^Q").count() == 3
    merged = nodes.merge(tree, "^C", "^Q", at=("A",), of=("1",))
    assert rows(merged.filter("name = '^C'").select(F.array_join("subs", "/").alias("p"), "value"), "p", "value") == [("10", "d"), ("2", "b"), ("30", "a"), ("A", "y"), ("A/2", "x")]
    assert rows(nodes.descendants(tree, "^Q", "3").select(F.array_join("subs", "/").alias("p")), "p") == [("z/w",)]
    assert rows(nodes.names(tree, "^"), "name") == [("^C",), ("^Q",)]
    store = loaders.Store(tree)
    store.batch_put([("^C", ["2"], "new"), ("^Z", [], "root")])
    store.batch_delete([("^C", ["30"]), ("^None", ["1"])])
    assert (store.get("^C", "2"), store.get("^C", "30"), store.get("^Z"), store.names()) == ("new", "", "root", ["^C", "^Q", "^Z"])


def test_transactions(spark, tree):
    t = Transactions(tree)
    t.start()
    t.set("^C", "2", "inside")
    assert t.depth == 1 and rows(t.view().filter("value = 'inside'"), "name") == [("^C",)]
    t.start()
    t.kill("^C")
    t.rollback()
    t.start()
    t.set("^C", "2", "deeper")
    t.commit()
    t.commit()
    assert t.depth == 0 and rows(t.base.filter(F.col("subs")[0] == "2"), "value") == [("deeper",)]
    t.commit()
    t.kill("^Q", "1")
    assert t.view().filter("name = '^Q'").count() == 1


def test_logs_against_replay(spark):
    rng = random.Random(9)
    log = [(i % 3, n, rng.choice(["push", "push", "pop"] if i else ["pop", "pop", "push"]), f"v{n}") for n in range(200) for i in [rng.randrange(3)]]
    df = spark.createDataFrame(log, "id long, seq long, op string, value string")
    queue, stack, bags = {}, {}, {}
    q_out, s_out = [], []
    for i, n, op, v in log:
        q, s = queue.setdefault(i, []), stack.setdefault(i, [])
        if op == "push":
            q.append(v)
            s.append(v)
        elif q:
            q_out.append((i, n, q.pop(0)))
            s_out.append((i, n, s.pop()))
        b = bags.setdefault((i, v[-1]), 0)
        bags[i, v[-1]] = b + 1 if op == "push" else max(0, b - 1)
    assert rows(K.queue_pairs(df), "id", "seq", "value") == sorted(q_out)
    assert rows(K.stack_pairs(df), "id", "seq", "value") == sorted(s_out)
    assert rows(K.queue_rest(df), "id", "place", "value") == sorted((i, k, v) for i, q in queue.items() for k, v in enumerate(q, 1))
    assert rows(K.stack_rest(df), "id", "place", "value") == sorted((i, k, v) for i, s in stack.items() for k, v in enumerate(s, 1))
    bag = K.bag(df.select("id", "seq", F.right("value", F.lit(1)).alias("value"), F.when(F.col("op") == "push", "add").otherwise("del").alias("op")))
    assert rows(bag, "id", "value", "n") == sorted((i, v, n) for (i, v), n in bags.items() if n)
    d = spark.createDataFrame([(1, 1, "addlast", "a"), (1, 2, "addfirst", "b"), (1, 3, "poplast", ""), (1, 4, "addlast", "c"), (2, 1, "popfirst", "")], "id long, seq long, op string, value string")
    assert rows(K.deques(d), "id", "items", "len") == [(1, "b,c", 2), (2, "", 0)]
    c = spark.createDataFrame([(1, n, op, k, "v") for n, (op, k) in enumerate([("put", "a"), ("put", "b"), ("get", "a"), ("put", "c"), ("get", "b")])], "id long, seq long, op string, key string, value string")
    assert rows(K.lru_replay(c, 2), "hits", "misses", "keys") == [(1, 1, "a,c")]
    assert rows(K.array_set(spark.createDataFrame([(1, 1, 0, "x"), (1, 2, 0, "y")], "id long, seq long, pos long, value string")), "pos", "value") == [(0, "y")]


def test_structures(spark):
    words = spark.createDataFrame([("hello",), ("help",), ("hero",)], "w string")
    assert rows(A.autocomplete(words, "w", "hel"), "w") == [("hello",), ("help",)]
    banana = spark.createDataFrame([(1, "banana"), (2, "")], "k long, t string")
    assert rows(A.occurrences(banana, "k", "t", "ana"), "pos") == [(1,), (3,)]
    assert [(r["pos"], r["lcp"]) for r in A.suffixes(banana, "k", "t").orderBy("rank").collect()] == [(5, 0), (3, 1), (1, 3), (0, 0), (4, 0), (2, 2)]
    numbers = spark.createDataFrame(list(enumerate([1, 2, 3, 4, 5])), "i long, v long")
    asked = spark.createDataFrame([(0, 4), (1, 3), (7, 9)], "lo long, hi long")
    assert rows(A.range_aggregates(numbers, asked, "i", "v", 2).fillna(-1), "lo", "hi", "n", "sum", "min", "max") == [(0, 4, 5, 15, 1, 5), (1, 3, 3, 9, 2, 4), (7, 9, 0, -1, -1, -1)]
    iv = spark.createDataFrame([(15, 20, "a"), (10, 30, "b"), (17, 19, "c"), (5, 20, "d")], "low long, high long, data string")
    assert rows(A.overlaps(iv, spark.createDataFrame([(14, 16)], "qlow long, qhigh long"), 4), "data") == [("a",), ("b",), ("d",)]
    bits = A.bits(spark.createDataFrame([(0,), (63,), (64,), (64,), (40000,)], "v long"), [], "v")
    assert A.bits_count(bits, []).first()["n"] == 4
    points = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [5.0, 6.0])], "id long, p array<double>")
    assert A.nearest_point(points, spark.createDataFrame([(9, [2.5, 3.0])], "qid long, q array<double>"), 2).first()["id"] == 2
    fnv = spark.range(1).select(A.fnv(F.lit("abc")).alias("h"), A.fnv(F.lit("")).alias("e")).first()
    assert (fnv["h"], fnv["e"]) == (440920331, 2166136261)
    leaves = ["a", "b", "c", "d", "e"]

    def brute(lo, hi):
        def h(s):
            x = 2166136261
            for ch in s:
                x = ((x ^ ord(ch)) * 16777619) % 2**32
            return str(x)

        mid = lo + (hi - lo + 1) // 2
        return h(leaves[lo]) if hi - lo == 1 else h(brute(lo, mid) + brute(mid, hi))

    m = {(r["lo"], r["hi"]): r["hash"] for r in A.merkle(spark.createDataFrame(list(enumerate(leaves)), "i long, t string"), "i", "t").collect()}
    assert len(m) == 9 and all(m[k] == brute(*k) for k in m)
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 3.0), ("x", "y", 1.0)], "src string, dst string, weight double")
    assert rows(A.connected(edges), "node", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert A.dfs_order(spark, edges, "a") == ["a", "b", "c"] and rows(A.bfs(edges, ["a"]), "node", "level") == [("a", 0), ("b", 1), ("c", 1)]
    maybe = rows(A.bloom_maybe(spark.createDataFrame([("hello",), ("foo",)], "w string"), "w", A.bloom(words, "w", 1000), 1000), "w", "maybe")
    assert maybe == [("foo", False), ("hello", True)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "The dog. the end"), (3, ""), (4, None), (5, "cat cat cat")], "doc_id long, text string")
    top = search.bm25(docs, "cat", 10).collect()
    assert [r["doc_id"] for r in top] == [5, 1] and top[0]["score"] > top[1]["score"] > 0
    assert search.bm25(docs, "", 3).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (5, [0.6, 0.8]), (7, [0.0, 0.0]), (8, None)], "vec_id long, embedding array<double>")
    assert [(r["doc_id"], round(r["score"], 6)) for r in search.knn(vectors, [1.0, 0.0], 3).collect()] == [(1, 1.0), (5, 0.6), (7, 0.0)]
    assert {r["doc_id"] for r in search.hybrid(docs, vectors, "cat", [1.0, 0.0], 3).collect()} == {1, 5, 7}


def test_loaders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1, Ann \n2,Bo\n")
    assert rows(loaders.csv(spark, str(tmp_path / "a.csv")).select(F.array_join("subs", "/").alias("p"), "value"), "p", "value") == [("2/0", "1"), ("2/1", "Ann"), ("3/0", "2"), ("3/1", "Bo")]
    assert rows(loaders.csv(spark, str(tmp_path / "a.csv"), "^R", globals_per_row=True).select("name"), "name")[0] == ("^R2",)
    (tmp_path / "a.json").write_text('["x", {"k": "v", "n": 1}]')
    assert rows(loaders.json(spark, str(tmp_path / "a.json")).select(F.array_join("subs", "/").alias("p"), "value"), "p", "value") == [("0", "x"), ("1/k", "v"), ("1/n", "")]
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "one.txt").write_text("l1\nl2")
    (folder / "two.txt").write_text("z")
    assert rows(loaders.directory(spark, str(folder)).select(F.col("subs")[0].alias("f"), "value"), "f", "value") == [("one.txt", "l1\nl2"), ("two.txt", "z")]
    assert loaders.text(spark, str(folder / "one.txt")).first()["value"] == "l1\nl2"
    assert rows(loaders.lines(spark, str(folder / "one.txt")), "line") == [("l1",), ("l2",)]
    t = nodes.of_rows(spark, [("^A", ["1", "x"], "v"), ("^B", [], "r")])
    loaders.save(t, str(tmp_path / "store"))
    assert rows(loaders.load(spark, str(tmp_path / "store")).select("name", "value"), "name", "value") == [("^A", "v"), ("^B", "r")]
    key = t.select(loaders.encoded_key(F.col("name"), F.col("subs")).alias("k")).select(loaders.decoded_key(F.col("k")).alias("d"))
    assert sorted(r["d"] for r in key.collect()) == [["^A", "1", "x"], ["^B"]]
    loaders.write_lines(t, str(tmp_path / "out"), "value")
    assert rows(loaders.lines(spark, str(tmp_path / "out")), "line") == [("r",), ("v",)]


def test_thesaurus(spark, tmp_path):
    files = {
        "eric_thesaurus.txt": "TERM|NOTE\nLearning|x\nTeaching|y",
        "eric_thesaurus_bt.txt": "TERM|BT\nTeaching|Education",
        "eric_thesaurus_rt.txt": "TERM|RT\nLearning|Teaching",
        "eric_thesaurus_synonyms.txt": "SYN|TERM\nStudy|Learning",
        "eric_citations.txt": "DOC|REST\nE1|title",
        "eric_citation_subjects.txt": "DOC|TERM\nE1|Learning\nE1|Teaching",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body + "\n")
    t = loaders.thesaurus(spark, str(tmp_path))
    assert rows(t["terms"], "term") == [("Learning",), ("Teaching",)] and rows(t["broader"], "term", "broader") == [("Teaching", "Education")]
    assert rows(t["related"], "term", "related") == [("Learning", "Teaching")] and rows(t["synonyms"], "synonym", "term") == [("Study", "Learning")]
    assert rows(t["term_citations"], "term", "document") == [("Learning", "E1"), ("Teaching", "E1")] and rows(t["citations"], "document", "rest") == [("E1", "title")]


def test_lint(spark):
    source = "MAIN ; start\n SET A=1\n SET B=2 WRITE B\n WRITE B\n DO SUB\n DO NONE\n QUIT\n WRITE 1\nSUB WRITE 2\n QUIT"
    found = rows(lint.report(lint.lines_of(spark, "R", source)), "code", "line_no")
    assert found == [("W001", 2), ("W002", 8), ("W003", 6)]
    assert lint.text_of(lint.lines_of(spark, "R", source), "SUB", 1).first()["text"] == " QUIT"


def test_streams(spark, tmp_path):
    log = [("q", 1, "push", "a"), ("q", 2, "pop", ""), ("q", 3, "pop", ""), ("r", 1, "push", "z"), ("q", 4, "push", "b"), ("q", 5, "pop", "")]
    spark.createDataFrame(log, "id string, seq long, op string, value string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, seq long, op string, value string").parquet(str(tmp_path / "in"))
    q = stateful.queues(stream).writeStream.format("memory").queryName("queue_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("queue_out"), "id", "seq", "value") == [("q", 2, "a"), ("q", 5, "b")]


def test_order_from_places_that_need_not_exist(spark):
    t = nodes.of_rows(spark, [("^A", [s], "") for s in ("1", "3", "10", "b")])
    asked = [("", "1", ""), ("0", "1", ""), ("1", "3", ""), ("2", "3", "1"), ("3", "10", "1"), ("a", "b", "10"), ("b", "", "10"), ("c", "", "b")]
    want = spark.createDataFrame([("^A", [], s) for s, _, _ in asked], "name string, parent array<string>, sub string")
    for back, at in ((False, 1), (True, 2)):
        got = {r["sub"]: r["found"] for r in nodes.order(t, want, back).collect()}
        assert got == {x[0]: x[at] for x in asked}


def test_as_of_across_ranges_groups_and_nulls(spark):
    left = spark.createDataFrame([(g, t) for g in ("a", None) for t in range(100)], "g string, t int")
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 11, None), ("a", 60, 2.0), (None, 0, 9.0)], "g string, t int, v double")
    got = {(r["g"], r["t"]): r["v"] for r in nodes.as_of(left, right, ["g"], "t", "v").collect()}
    assert got == {("a", t): None if t < 10 else 1.0 if t < 60 else 2.0 for t in range(100)} | {(None, t): 9.0 for t in range(100)}
    assert nodes.as_of(left.limit(0), right, ["g"], "t", "v").count() == 0


def test_long_chains_are_followed_to_their_end(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(90)], "src long, dst long, weight double")
    levels = {r["node"]: r["level"] for r in A.bfs(A.graph_edges(chain, directed=True), [0]).collect()}
    assert levels == {i: i for i in range(91)}
    assert {r["component"] for r in A.connected(chain).collect()} == {0}


def test_ranks_of_all_hits(spark):
    hits = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "doc_id long, score double")
    got = {r["doc_id"]: r["rank"] for r in search.ranked(hits, None).collect()}
    assert got == {d: k for k, d in enumerate(sorted(range(200), key=lambda i: (-(i % 7), i)), 1)}


def test_cache_of_keys_that_were_never_put(spark):
    log = spark.createDataFrame([(1, k, o, x, x) for k, (o, x) in enumerate([("get", "z"), ("put", "a"), ("put", "b"), ("get", "a"), ("put", "c"), ("get", "b")])], "id int, seq int, op string, key string, value string")
    assert sorted((r["key"], r["back"]) for r in K.lru(log, 2).collect()) == [("a", 2), ("c", 1)]


def test_ranges_take_blocks_of_blocks(spark):
    rng = random.Random(4)
    values = {i: rng.randrange(-50, 50) for i in range(400) if rng.random() < 0.8}
    df = spark.createDataFrame(list(values.items()) + [(7, None)], "at long, v long")
    asked = [(0, 399), (5, 5), (3, 370), (16, 31), (15, 32), (390, 380), (-20, 500)] + [tuple(sorted((rng.randrange(400), rng.randrange(400)))) for _ in range(30)]
    got = {(r["lo"], r["hi"]): (r["n"], r["sum"], r["min"], r["max"]) for r in A.range_aggregates(df, spark.createDataFrame(asked, "lo long, hi long"), "at", "v", 4).collect()}
    for lo, hi in asked:
        own = [v for i, v in values.items() if lo <= i <= hi]
        assert got[lo, hi] == (len(own), sum(own) if own else None, min(own, default=None), max(own, default=None)), (lo, hi)


def test_ranges_are_one_row_each(spark):
    rng = random.Random(5)
    values = [(rng.randrange(2000), rng.choice([None, rng.randrange(-50, 50)])) for _ in range(3000)]
    df = spark.createDataFrame(values, "at long, v long")
    asked = [(k, *rng.choice([(a, a + rng.randrange(60)), (a, rng.randrange(a, 2300)), (a % 7, 1990 + a % 9), (None, a), (a, a - 1)])) for k in range(300) for a in [rng.randrange(-100, 2100)]]
    got = A.range_aggregates(df, spark.createDataFrame(asked + asked[:5], "k long, lo long, hi long"), "at", "v", 16)
    want = []
    for k, lo, hi in asked + asked[:5]:
        own = [v for i, v in values if v is not None and lo is not None and lo <= i <= hi]
        want.append((k, len(own), sum(own) if own else None, min(own, default=None), max(own, default=None)))
    assert sorted(tuple(r[c] for c in ("k", "n", "sum", "min", "max")) for r in got.collect()) == sorted(want, key=lambda r: r[0])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_distinct" not in plan and "sequence(" not in plan.replace("sequence(0", "")
    none = A.range_aggregates(df.limit(0), spark.createDataFrame([(0, 9)], "lo long, hi long"), "at", "v", 4).first()
    assert (none["n"], none["sum"]) == (0, None)


def test_kill_by_roots_of_several_depths(spark):
    rng = random.Random(6)
    paths = {tuple(str(rng.randrange(4)) for _ in range(rng.randrange(5))) for _ in range(300)}
    t = nodes.of_rows(spark, [(n, list(p), "v") for n in ("^A", "^B", "^C") for p in sorted(paths)])
    roots = [("^A", ["1"]), ("^A", ["0", "2"]), ("^A", ["0", "2"]), ("^A", ["3", "3", "0", "1"]), ("^A", ["9"] * 7), ("^B", []), ("^C", ["2", "2", "1"])]
    got = nodes.kill_all(t, spark.createDataFrame(roots, "name string, subs array<string>"))
    want = sorted((n, p) for n in ("^A", "^B", "^C") for p in paths if not any(n == r and list(p[: len(q)]) == q for r, q in roots))
    assert sorted((r["name"], tuple(r["subs"])) for r in got.collect()) == want
    # no node is several rows: what one parent's many nodes share would be one task's
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert nodes.kill_all(t, spark.createDataFrame([], "name string, subs array<string>")).count() == t.count()


def test_nearest_points_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "POINTS", 8)
    rng = random.Random(9)
    rows = [(i, rng.choice([[rng.gauss(0, 1), rng.gauss(0, 1)], [1.0, 2.0], [rng.gauss(5, 0.01), 0.0], [float(rng.randrange(4)), float(rng.randrange(4))]])) for i in range(400)]
    rows += [(400, [float("nan"), 1.0]), (401, [None, 1.0]), (450, None), (402, [float("inf"), 1.0]), (500, [float("-inf"), 1.0])]
    df = spark.createDataFrame(rows, "id long, p array<double>")
    extra = spark.createDataFrame([(1000 + i, [rng.gauss(0, 9), rng.gauss(0, 9)]) for i in range(40)], "qid long, q array<double>")
    asked = df.filter("id % 5 = 0").selectExpr("id as qid", "p as q").unionByName(extra)
    finite = [(i, p) for i, p in rows if i < 400]
    for own in (False, True):
        got = {r["qid"]: (r["id"], r["dist2"]) for r in A.nearest_point(df, asked, 2, own).collect()}
        for r in asked.filter("qid < 400 or qid >= 1000").collect():
            want = min(((p[0] - r["q"][0]) * (p[0] - r["q"][0]) + (p[1] - r["q"][1]) * (p[1] - r["q"][1]), i) for i, p in finite if own or i != r["qid"])
            assert got[r["qid"]] == (want[1], want[0])
        assert got[400][0] == 0 and got[450][0] == 0
    plan = A.nearest_point(df, asked, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0" not in plan
