"""The thin queries: SQL where there is some, otherwise the columns that their contracts fix."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import assert_same, connection  # noqa: E402

from canopy.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_mips": {"query_id", "rank", "vec_id", "score"},
    "op3_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op5_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op6_quality": {"doc_id", "held_out", "score", "predicted"},
    "op7_licenses": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op8_simhash": {"doc_id", "fingerprint", "component_id"},
    "op9_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert_same(spark, connection(SF), queries.QUERIES[name], queries.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert set(out.columns) == COLUMNS[name]
    n = out.count()
    assert n == 200 if name != "op2_mips" else n == 25 * 20


def test_all_are_here():
    assert set(COLUMNS) | set(queries.ORACLES) == set(queries.QUERIES)
