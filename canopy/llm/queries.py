"""The thin queries of the operators, in the shape that their contracts fix, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, langid, licenses, linededup, quality, secrets, shards, simhash
from .common import documents

#: The ranks that the tokenizer queries use.
RANKS = "byte_bpe_multi_50k.tiktoken"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    """Registers f by its name."""
    QUERIES[f.__name__] = f
    return f


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of documents, encoded and then decoded from their ids."""
    both = bpe.encoded(docs, path, pattern, back=True)
    return both.select(
        "doc_id",
        F.floor(F.octet_length("tokens") / 4).cast("long").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document with the public multilingual ranks, and back."""
    import public_tokenizers

    return digests(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels outside the held-out quarter."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = quality.scored(docs, quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(quality.quarter(F.col("doc_id")) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and labels of every document."""
    return licenses.scanned(documents(spark, sf_dir))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word SimHash fingerprints differ in at most three bits."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of which a document holds at least four fifths of the five-word shingles."""
    found = decontaminate.contained(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("item_ids"), "n_shingles", "n_found", "containment")


#: Items of fewer than five words, which count as one shingle, don't occur in the tables and are left out here.
ORACLES["op1_decontamination"] = r"""
WITH w AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{A1}\x{AB}\x{BB}\x{BF}\x{2000}-\x{206F}\x{3000}-\x{3003}]+') AS w FROM documents
           UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{A1}\x{AB}\x{BB}\x{BF}\x{2000}-\x{206F}\x{3000}-\x{3003}]+') FROM benchmark),
s AS (SELECT kind, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s
      FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
u AS (SELECT DISTINCT kind, id, s FROM s),
c AS (SELECT id, count(*) AS n, string_agg(s, '|' ORDER BY s) AS content FROM u WHERE kind = 'i' GROUP BY id),
g AS (SELECT min(id) AS item_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS item_ids, any_value(n) AS n FROM c GROUP BY content)
SELECT d.id AS doc_id, g.item_id, g.item_ids, g.n AS n_shingles, count(*) AS n_found, count(*) / CAST(g.n AS DOUBLE) AS containment
FROM g JOIN u i ON i.kind = 'i' AND i.id = g.item_id JOIN u d ON d.kind = 'd' AND d.s = i.s
GROUP BY d.id, g.item_id, g.item_ids, g.n HAVING count(*) >= 0.8 * g.n
"""


@query
def op2_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty rows of largest inner product found for every embedding whose id is divisible by 20."""
    return ann.searched(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out third."""
    docs = documents(spark, sf_dir)
    found = langid.identified(docs.select("doc_id", "text"), langid.fitted(docs))
    return found.select("doc_id", F.coalesce(langid.third(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and a digest of the base kinds, and all spans."""
    rules = secrets.BASE + secrets.ADDED
    found = secrets.scanned(documents(spark, sf_dir).select("doc_id", "text"), rules)
    base = F.filter("__spans", lambda x: x["k"] < len(secrets.BASE))

    def count(k: int, kind: str):
        return F.size(F.filter("__spans", lambda x: x["k"] == k)).cast("long").alias(f"n_{kind}")

    counts = [count(k, r.kind) for k, r in enumerate(secrets.BASE)]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.rendered(base, rules).cast("binary"), 256).alias("base_sha256"), secrets.rendered(F.col("__spans"), rules).alias("spans")
    )


ORACLES["op4_secrets"] = secrets.oracle()


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of documents with near-equal bytes; equal texts stay together."""
    found = shards.sharded(documents(spark, sf_dir), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and after dropping those that three or more documents share, and a digest of what stays."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept = linededup.with_kept(docs, linededup.keep_bitmaps(docs))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op10_line_dedup"] = """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cut),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (g.key IS NOT NULL AND k.doc_id <> g.top) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (g.key IS NULL OR k.doc_id = g.top), '')) AS kept_sha256
FROM k LEFT JOIN g ON k.key = g.key GROUP BY k.doc_id
"""
