"""Every registered query outside llm against its SQL, over the smallest tables."""

import pytest
from oracle import assert_same, connection

from canopy.plans import catalogue, scripts  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, con, name):
    assert_same(spark, con, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("name", "of"), [("as_of_join", "lineitem"), ("segment_ranges", "orders"), ("bloom_no_false_negatives", "part"), ("fold_hash", "customer")])
def test_tables_are_asked(spark, con, name, of):
    assert catalogue.QUERIES[name](spark, SF).count() == con.execute(f"SELECT count(*) FROM {of}").fetchone()[0]


def test_fold_hash_of_all_customers(spark, con):
    want = {}
    for key, name in con.execute("SELECT c_custkey, c_name FROM customer").fetchall():
        h = 7
        for x in name:
            h = (h * 31 + ord(x)) % 4294967296
        want[key] = h
    assert {r["c_custkey"]: r["h"] for r in catalogue.QUERIES["fold_hash"](spark, SF).collect()} == want


def test_bloom_rejects_values_outside(spark):
    from canopy.operators import analytics

    p = catalogue.table(spark, SF, "part")
    asked = spark.createDataFrame([(f"absent {i}",) for i in range(500)], "p_brand string")
    assert analytics.bloom_maybe(asked, "p_brand", analytics.bloom(p, "p_brand", 4096), 4096).filter("maybe").count() < 50


def test_nearest_point_may_be_an_asked_one(spark):
    from canopy.operators import analytics

    e = spark.createDataFrame([(0, [0.0, 0.0]), (50, [1.0, 0.0]), (3, [9.0, 0.0])], "id long, p array<double>")
    asked = e.filter("id % 50 = 0").select(e.id.alias("qid"), e.p.alias("q"))
    assert {(r["qid"], r["id"]) for r in analytics.nearest_point(e, asked, 2, own=False).collect()} == {(0, 50), (50, 0)}


def test_texts_have_suffixes_and_prefixes(spark, con):
    n, longest = con.execute("SELECT sum(length(text)), max(length(text)) FROM benchmark").fetchone()
    found = catalogue.QUERIES["suffix_array"](spark, SF)
    assert found.count() == n and found.agg({"pos": "max"}).first()[0] == longest - 1 > 60
    assert catalogue.QUERIES["trie_prefixes"](spark, SF).selectExpr("max(length(prefix))").first()[0] == con.execute("SELECT max(length(p_name)) FROM part").fetchone()[0]
