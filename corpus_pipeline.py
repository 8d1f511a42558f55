"""A pipeline over the documents table: quality, line and near-duplicate removal, decontamination, and encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents. Empty tables pass through; null ids and texts are treated as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import decontaminate, linededup, quality, simhash
from canopy.llm.common import documents, stored
from canopy.llm.queries import RANKS, digests


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # without any model every document would have the same score, which says nothing against it
    return quality.scored(docs, model, score="__score").filter(F.col("__score") >= quality.ACCEPT).drop("__score") if model else docs


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share, but for the one of largest doc_id; n_chars follows the text."""
    kept = linededup.with_kept(docs, linededup.keep_bitmaps(docs))
    cut = F.col("__n_dropped") > 0
    changed = {"text": F.when(cut, F.col("__kept")).otherwise(F.col("text")), "n_chars": F.when(cut, F.length("__kept").cast("long")).otherwise(F.col("n_chars"))}
    return kept.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: fingerprints of five-word shingles, Jaccard similarity 0.8."""
    return simhash.deduplicated(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return digests(docs.select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", distinct_lines),
    ("near_dedup", distinct_documents),
    ("decontamination", clean_of_benchmark),
    ("encoding", token_digests),
]

#: The classifier, fingerprints and merges can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result stored before the next."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
