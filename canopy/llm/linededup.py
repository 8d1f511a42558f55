"""Line deduplication with DataFrame functions only.

Hashes of long line keys are range-partitioned and, within a partition, sorted by hash, document and position. Windows
over that order stream through each hash once: its first occurrence is the line in the largest document, all later ones
are lost if enough documents hold the line. The few hashes that a thousandth of all lines have are dealt over several
ranges by document; what those ranges hold of such a hash is settled from one row for each range. The result is a keep
bitmap for each document that loses lines, compressed to run boundaries; texts are cut from the bitmaps in a later step.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, hot_keys, parts_of, stored

#: White space at a line's ends that isn't part of its key.
BLANKS = " \t\n\x0b\x0c\r"


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, all else as it is; the quick built-in serves where there is nothing else."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def lines(text: Column) -> Column:
    """A text's lines; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_key(text: Column) -> Column:
    """Tells rows with one doc_id and different texts apart; equal rows share it, and their decisions."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, min_chars: int, doc_id: str, text: str) -> DataFrame:
    """h and h2 (hashes of the key), doc_id, row_key and pos of every line whose key is long enough."""
    ids, texts = F.col(doc_id), F.col(text)
    exploded = docs.filter(ids.isNotNull() & texts.isNotNull()).select(
        ids.alias("doc_id"), row_key(texts).alias("row_key"), F.posexplode(lines(texts)).alias("pos", "line")
    )
    key = lower_ascii(F.col("key"))
    return (
        exploded.select("doc_id", "row_key", "pos", F.btrim("line", F.lit(BLANKS)).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select(F.xxhash64(key).alias("h"), F.hash(key).alias("h2"), "doc_id", "row_key", "pos")
    )


def lost_lines(hashed: DataFrame, min_docs: int) -> DataFrame:
    """doc_id, row_key and pos of the lines that go."""
    hot = hot_keys(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h", hashed.count())
    spread = hashed.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts_of(F.col("h"), hot)).cast("int"))
    ordered = spread.repartitionByRange("h", "h2", "part").sortWithinPartitions("h", "h2", "part", F.desc("doc_id"), "row_key", "pos")
    line = Window.partitionBy("h", "h2", "part")
    streamed = ordered.withColumns({"first": F.first("doc_id").over(line.orderBy(F.desc("doc_id"))), "rank": F.dense_rank().over(line.orderBy(F.desc("doc_id")))})
    counted = streamed.withColumn("n", F.max("rank").over(line))
    gone = (F.col("n") >= min_docs) & (F.col("doc_id") != F.col("first"))
    if not hot:
        return counted.filter(gone).select("doc_id", "row_key", "pos")
    divided = parts_of(F.col("h"), hot) > 1
    marked = stored(counted.filter(gone | divided).withColumn("divided", divided))
    # one row for each range of a divided hash, then one for the hash: no more than there are hot hashes
    ranges = marked.filter("divided").groupBy("h", "h2", "part").agg(F.max("first").alias("first"), F.max("n").alias("n"))
    whole = ranges.groupBy("h", "h2").agg(F.max("first").alias("top"), F.sum("n").alias("all"))
    settled = marked.filter("divided").join(F.broadcast(whole), ["h", "h2"]).filter((F.col("all") >= min_docs) & (F.col("doc_id") != F.col("top")))
    return marked.filter("not divided").select("doc_id", "row_key", "pos").unionByName(settled.select("doc_id", "row_key", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_key, n_dropped and keep_bitmap of each row that loses lines.

    A line whose key has at least min_chars code points and stands in at least min_docs documents goes from all of
    them but the one with the largest doc_id. keep_bitmap holds big-endian 32-bit line numbers at which runs change,
    beginning with a kept run. Rows with a null doc_id take no part: they neither count nor lose lines.
    """
    hashed = stored(hashed_lines(docs, min_chars, doc_id, text))
    dropped_ = lost_lines(hashed, min_docs).groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    begins = F.expr("filter(p, (x, i) -> i = 0 or p[greatest(i - 1, 0)] <> x - 1)")
    ends = F.expr("filter(p, (x, i) -> i = size(p) - 1 or p[least(i + 1, size(p) - 1)] <> x + 1)")
    turns = F.expr("flatten(transform(arrays_zip(a, b), r -> array(r.a, r.b + 1)))")
    packed = F.expr("unhex(array_join(transform(turns, x -> lpad(hex(cast(x as bigint)), 8, '0')), ''))")
    out = stored(
        dropped_.select("doc_id", "row_key", F.size("p").cast("long").alias("n_dropped"), begins.alias("a"), ends.alias("b"))
        .select("doc_id", "row_key", "n_dropped", turns.alias("turns"))
        .select("doc_id", "row_key", "n_dropped", packed.alias("keep_bitmap"))
    )
    dropped(hashed)
    return out


def kept_text(lines_: str, bitmap: str) -> Column:
    """The lines (an array column) that a bitmap keeps, joined again; all of them where it is null."""
    turns = f"transform(sequence(0, cast(length({bitmap}) / 4 as int) - 1), i -> cast(conv(hex(substring({bitmap}, i * 4 + 1, 4)), 16, 10) as int))"
    begin = "if(k = 0, 0, t[greatest(2 * k - 1, 0)])"
    end = f"if(2 * k < size(t), t[least(2 * k, size(t) - 1)], size({lines_}))"
    kept = f"flatten(transform(sequence(0, cast(size(t) / 2 as int)), k -> slice({lines_}, {begin} + 1, greatest(0, {end} - {begin}))))"
    body = f"transform(array({turns}), t -> {kept})[0]"
    return F.expr(f"array_join(if({bitmap} is null, {lines_}, {body}), '\n')")


def with_kept(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with __n_lines, __n_dropped and __kept (the text without its dropped lines).

    Bitmaps meet their rows by doc_id and a hash of the text. Columns whose names begin with two underscores are this
    function's own: docs must not have __id, __key, __lost, __bitmap, __lines, __n_lines, __n_dropped or __kept.
    """
    keyed = docs.withColumn("__key", row_key(F.col(text))).withColumn("__id", F.col(doc_id))
    own = bitmaps.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), F.col("n_dropped").alias("__lost"), F.col("keep_bitmap").alias("__bitmap"))
    # one plan at every size: small tables too are merged, not broadcast
    cut = keyed.join(own.hint("merge"), ["__id", "__key"], "left").select(
        *[F.col(c) for c in docs.columns], lines(F.col(text)).alias("__lines"), F.col("__bitmap"), F.coalesce("__lost", F.lit(0)).cast("long").alias("__n_dropped")
    )
    return cut.select(*[F.col(c) for c in docs.columns], F.size("__lines").cast("long").alias("__n_lines"), "__n_dropped", kept_text("__lines", "__bitmap").alias("__kept"))
