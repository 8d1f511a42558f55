"""Keyword (BM25), vector (cosine) and hybrid (reciprocal rank fusion) search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import numbered

# Fixed values of the ranking functions and of the tokenizer.
K1, B, RRF_K = 1.2, 0.75, 60
SEPARATORS = "[\\s,.!?;:()\\[\\]{}\"']"


@dataclass
class Bm25:
    """postings (doc_id, term, tf), lengths (doc_id, len) and terms (term, df)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame

    def totals(self) -> tuple[int, float]:
        r = self.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("a")).first()
        return r["n"], r["a"] or 0.0


def tokens(text: Column) -> Column:
    """Words in lower case between separators, empty ones included: they count for the length."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1)


def bm25_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Bm25:
    """Terms are counted within a document before anything moves; one shuffle by term gives document frequencies."""
    cut = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("w"))
    terms = cut.select("doc_id", F.explode("w").alias("term")).filter("term <> ''").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return Bm25(terms, cut.select("doc_id", F.size("w").alias("len")), terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def bm25(docs: DataFrame, query: str, k: int | None = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and rank of the k best documents for a query (all, if k is None).

    One scan: the terms of the query are few and known, so a document's counts of them are columns, and totals and
    document frequencies are one aggregate over those.
    """
    asked = [t for t in query.lower().split() if t]
    terms = sorted(set(asked))
    if not terms:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    cut = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("w"))

    def count(t: str) -> Column:
        return F.size(F.filter("w", lambda x: x == t))

    counted = cut.select("doc_id", F.size("w").alias("len"), *[count(t).alias(f"t{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    # one row
    joined = counted.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for t in asked:
        i = terms.index(t)
        tf, df = F.col(f"t{i}").cast("double"), F.col(f"d{i}").cast("double")
        idf = F.ln((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        norm = tf + K1 * (1 - B + B * F.col("len") / F.col("avg"))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / norm).otherwise(0.0)
    hits = joined.select("doc_id", score.alias("score")).filter("score > 0")
    return ranked(hits, k)


def ranked(hits: DataFrame, k: int | None) -> DataFrame:
    """hits (doc_id, score) with their rank, the best k of them, or all."""
    order = [F.desc("score"), "doc_id"]
    if k is None:
        return numbered(hits, order, "rank")
    # k rows, sorted in one task
    return hits.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where either is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(F.try_divide(dot(a, b), size))


def knn(vectors: DataFrame, query: list[float], k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """doc_id, score and rank of the k vectors nearest to a query by cosine: exact, a projection and a top k.

    Vectors that are null or of another length take no part.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    hits = vectors.filter(F.size(vector) == len(query)).select(F.col(vec_id).alias("doc_id"), cosine(F.col(vector), q).alias("score"))
    return ranked(hits, k)


def fused(*lists: DataFrame, k: int = RRF_K, most: int | None = None) -> DataFrame:
    """doc_id, score and rank by reciprocal rank fusion of lists (doc_id, rank)."""
    all_ = lists[0].select("doc_id", "rank")
    for x in lists[1:]:
        all_ = all_.unionByName(x.select("doc_id", "rank"))
    return ranked(all_.groupBy("doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score")), most)


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, vector: list[float], k: int = 10) -> DataFrame:
    """Both searches to twice the depth, fused."""
    return fused(bm25(docs, query, 2 * k), knn(vectors, vector, 2 * k), most=k)


def documents_of(nodes: DataFrame, prefix: str = "") -> DataFrame:
    """doc_id and text of the root values of trees whose name begins with prefix: what an index over a store holds."""
    return nodes.filter(F.col("name").startswith(prefix) & (F.size("subs") == 0)).select(F.col("name").alias("doc_id"), F.col("value").alias("text"))


def expanded(query: DataFrame, thesaurus: DataFrame) -> DataFrame:
    """term, to: the terms of a query with their synonyms (thesaurus: term, synonym)."""
    own = query.select("term", F.col("term").alias("to"))
    return own.unionByName(query.join(thesaurus, "term").select("term", F.col("synonym").alias("to"))).distinct()
