import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from canopy.llm import bpe, decontaminate, licenses, queries

PATH = public_tokenizers.path(queries.RANKS)
ODD = [None, "", " ", "a", "\n\n \t x", "it's we'll 'TWAS", "naïve café 東京 🙂\u0085  x", "x" * 1500 + " ab" * 30, "\x1c\x1d y", "123456 7 é́", "the the the", "a\x00b"]


def test_bpe_equals_the_library(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcé '’\n\t.,0日🙂ñ~") for _ in range(rng.randrange(60))) for _ in range(150)]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, None), (3, "a")], "doc_id long, text string")
    got = bpe.encoded(docs, PATH, public_tokenizers.PATTERN, chunk=300)
    rows = got.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert np.frombuffer(r["tokens"], "<u4").tolist() == enc.encode_ordinary(texts[r["doc_id"]] or ""), texts[r["doc_id"]]
    for r in bpe.decoded(got, PATH, ("doc_id",)).collect():
        assert bytes(r["decoded"]).decode() == (texts[r["doc_id"]] or "")
    assert queries.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_digests_are_of_ids_and_bytes(spark):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})
    texts = [*ODD, "word " * 30_000, "é" * 50_000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").select("doc_id", "text")
    for r in queries.digests(docs, PATH, public_tokenizers.PATTERN).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]] or "")
        packed = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), packed, hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest())


def test_items_of_equal_words_are_one_in_any_number_of_blocks(spark, monkeypatch):
    same = ["One two three four five six", "one two, three four five six!", "ONE TWO THREE FOUR FIVE SIX", "one\u2003two three four five six", "«one two three four five six»"]
    bench = spark.createDataFrame([(10 + i, t) for i, t in enumerate([*same, "other words stand here instead"])], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so one two three four five six seven")], "doc_id long, text string")
    for most in (20_000, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", most)
        assert [(r["item_id"], r["item_ids"]) for r in decontaminate.contained(docs, bench).collect()] == [(10, [10, 11, 12, 13, 14])]


def test_heap_merges_equal_the_library():
    table = bpe.ranks(PATH)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    rng = random.Random(2)
    for _ in range(100):
        word = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 80)))
        ids = bpe.merged_long(word.encode(), table)
        assert ids == enc.encode_ordinary(word)


def brute_license(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
    places, labels = [], set()
    for phrase, name in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(name)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses_against_brute_force(spark):
    texts = ODD + [
        "Released under the MIT License. and UNDER-THE-MIT-LICENSE; under the mit license under the mit license",
        "Apache License, Version 2.0 é Apache License Version 2 version 20",
        "cc by nc by nc cc-by-nc sa 4.0",
        "# SPDX-License-Identifier: (MIT OR GPL-3.0-or-later) AND Apache-2.0 WITH LLVM-exception\nrest",
        "All rights reserved.",
        "under the mit license " * 300,
    ]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, texts[-2], 1)], "doc_id long, text string, n_words int")
    rows = licenses.scanned(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(texts[r["doc_id"]]), texts[r["doc_id"]]
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    tagged = next(r for r in rows if r["doc_id"] == len(ODD) + 3)
    assert tagged["labels"] == "apache-2,gpl-3,mit" and tagged["score"] == 1.0
    assert licenses.scanned(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("expression", "labels", "freedom"),
    [("MIT", {"mit"}, 1.0), ("MIT AND GPL-2.0-only", {"mit", "gpl-2"}, 0.4), ("(Apache-2.0", {"apache-2"}, None), ("MIT OR (CC-BY-NC-4.0 AND ISC)", {"mit", "cc-by-nc", "isc"}, 1.0), ("OR MIT", None, None)],
)
def test_expressions(expression, labels, freedom):
    found = licenses.parsed(expression)
    if labels is None or freedom is None:
        assert found is None
    else:
        assert found == (frozenset(labels), freedom)


def test_long_expressions_are_read_whole():
    names = [f"lic-a{i}" for i in range(3000)]
    for expression in (" AND ".join(names), "(" + " OR ".join(names) + ")", "(" * 80 + names[0] + ")" * 80 + " AND " + " AND ".join(names[1:])):
        assert licenses.parsed(expression)[0] == frozenset(names)
    assert licenses.parsed(" AND ".join(["MIT"] * 100 + ["GPL-2.0-only"])) == (frozenset({"mit", "gpl-2"}), 0.4)
    assert licenses.parsed("MIT AND (ISC OR (BSD " + "AND X " * 100)[0] == frozenset({"mit"})


def test_containment_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    items = [" ".join(word() for _ in range(rng.choice([3, 6, 12, 30, 50]))) for _ in range(40)] + ["", None, "Un Éclair"]
    docs = [None, "", "a b"]
    for k in range(120):
        words = [word() for _ in range(rng.choice([0, 5, 200, 3000]))]
        if k % 3:
            piece = (rng.choice(items) or "").split()
            if len(piece) > 20 and k % 2:
                for _ in range(rng.randrange(3)):
                    piece[rng.randrange(len(piece))] = word()
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in piece]
        docs.append(rng.choice([" ", "  ", "\n"]).join(words))
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)) + [(100, items[4])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_found"], tuple(r["item_ids"])) for r in decontaminate.contained(table, bench).collect()}
    want = {}
    for d, t in enumerate(docs):
        held = {}
        for i, item in enumerate(items):
            width, sh = decontaminate.shingles_of(item)
            if sh:
                if width not in held:
                    w = decontaminate.split_words(decontaminate.W.folded(t))
                    held[width] = {b" ".join(w[a : a + width]) for a in range(len(w) - width + 1)}
                n = len(held[width] & sh.keys())
                if n >= 0.8 * len(sh):
                    want[d, i] = (n, (4, 100) if i == 4 else (i,))
    assert got == want and len(want) > 40
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert {(r["doc_id"], r["item_id"]): (r["n_found"], tuple(r["item_ids"])) for r in decontaminate.contained(table, bench).collect()} == want
    assert decontaminate.without(table, bench).count() == len(docs) - len({d for d, _ in want})
    assert decontaminate.contained(table.limit(0), bench).count() == 0
    assert decontaminate.contained(table, bench.limit(0)).count() == 0
