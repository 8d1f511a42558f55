"""Analytic structures as joins, windows and aggregates: bitsets, prefixes, graphs, matrices, ranges, intervals, text, points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut, ranged

# Fixed values of the hashes: a fold by 31 and 32-bit FNV-1a.
TWO32, FOLD, FNV_BASIS, FNV_PRIME = 4294967296, 31, 2166136261, 16777619


# --- bit sets -------------------------------------------------------------------------------------------------


def bits(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, bucket and bitmap of non-negative whole numbers; a bitmap holds 32768 of them."""
    at = F.col(value).cast("bigint") + 1
    return df.select(*group, F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy(*group, "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def bits_count(bitmaps: DataFrame, group: list[str]) -> DataFrame:
    return bitmaps.groupBy(*group).agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def bits_or(a: DataFrame, b: DataFrame) -> DataFrame:
    """bucket and bitmap of the union."""
    return a.select("bucket", "bitmap").unionByName(b.select("bucket", "bitmap")).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bits_and(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Values that both sides have."""
    return a.select(value).distinct().join(b.select(value).distinct(), value, "left_semi")


# --- prefixes and text ----------------------------------------------------------------------------------------


def autocomplete(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Distinct values that begin with prefix; the filter reaches the scan."""
    return df.filter(F.col(column).startswith(prefix)).select(column).distinct()


def prefixes(df: DataFrame, column: str, longest: int) -> DataFrame:
    """Each prefix of up to ``longest`` characters with how many distinct values it begins: the trie's inner nodes."""
    words = df.select(F.col(column).alias("w")).filter("w <> ''").distinct()
    cut = F.transform(F.sequence(F.lit(1), F.least(F.length("w"), F.lit(longest))), lambda n: F.substring("w", F.lit(1), n))
    return words.select(F.explode(cut).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


def suffixes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 0), suffix, rank in byte order within the text, and lcp, the common prefix with the suffix before.

    Grows with the square of a text's length: for short texts.
    """
    at = df.filter(F.length(text) > 0).select(key, F.explode(F.sequence(F.lit(0), F.length(text) - 1)).alias("pos"), F.col(text).alias("t"))
    own = at.select(key, "pos", F.expr("substring(t, pos + 1)").alias("suffix"))
    by = Window.partitionBy(key).orderBy("suffix")
    before = F.coalesce(F.lag("suffix").over(by), F.lit(""))
    ranked = own.select(key, "pos", "suffix", F.row_number().over(by).alias("rank"), before.alias("b"))
    longest = F.expr("size(filter(sequence(1, greatest(least(length(suffix), length(b)), 1)), n -> length(b) >= n and left(suffix, n) = left(b, n)))")
    return ranked.select(key, "pos", "suffix", "rank", longest.alias("lcp"))


def occurrences(df: DataFrame, key: str, text: str, wanted: str) -> DataFrame:
    """key and pos (from 0) of every place, overlaps included, where wanted stands in a text; one row without suffixes."""
    if not wanted:
        return df.select(key, F.lit(0).alias("pos")).limit(0)
    hit = df.filter(F.contains(text, F.lit(wanted)))
    at = F.filter(F.sequence(F.lit(0), F.length(text) - len(wanted)), lambda p: F.substring(F.col(text), p + 1, F.lit(len(wanted))) == wanted)
    return hit.select(key, F.explode(at).alias("pos"))


def rope(df: DataFrame, group: str, order: list[str], text: str) -> DataFrame:
    """group and its texts concatenated in order, with their length: a value of one row, so for groups that fit into one."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), "")
    return df.filter(F.col(text).isNotNull()).groupBy(group).agg(joined.alias("rope")).withColumn("len", F.length("rope"))


def rope_substring(ropes: DataFrame, start: int, size: int) -> Column:
    """size characters of the column ``rope`` from start, counted from 0."""
    return F.substring("rope", start + 1, size)


# --- hashes: Bloom and Merkle ---------------------------------------------------------------------------------


def _codes(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), F.ascii))


def fold_hash(text: Column, seed: int) -> Column:
    """h * 31 + code, modulo 2**32, from seed on."""
    return F.aggregate(_codes(text), F.lit(seed).cast("bigint"), lambda h, c: F.pmod(h * FOLD + c, F.lit(TWO32)))


def bloom_bits(text: Column, size: int, k: int = 3) -> Column:
    """The k bits of a text."""
    return F.array(*[F.pmod(fold_hash(text, i), F.lit(size)) for i in range(k)])


def bloom(df: DataFrame, text: str, size: int, k: int = 3) -> DataFrame:
    """The distinct bits that texts set; at most ``size`` rows."""
    return df.select(F.explode(bloom_bits(F.col(text), size, k)).alias("bit")).distinct()


def bloom_maybe(df: DataFrame, text: str, filter_: DataFrame, size: int, k: int = 3) -> DataFrame:
    """df with maybe: whether all bits of a text are set. The bits are at most ``size``, so they are broadcast below a million."""
    bits_ = filter_ if size > 1_000_000 else F.broadcast(filter_)
    asked = df.select(text).distinct().withColumn("bit", F.explode(F.array_distinct(bloom_bits(F.col(text), size, k))))
    hit = asked.join(bits_.withColumn("set", F.lit(1)), "bit", "left").groupBy(text).agg((F.count(F.lit(1)) == F.count("set")).alias("maybe"))
    return df.join(hit, text)


def fnv(text: Column) -> Column:
    """32-bit FNV-1a."""
    return F.aggregate(_codes(text), F.lit(FNV_BASIS), lambda h, c: F.pmod(h.bitwiseXOR(c.cast("bigint")) * FNV_PRIME, F.lit(TWO32)))


def merkle(df: DataFrame, pos: str, text: str) -> DataFrame:
    """level, lo, hi, hash of every node of a Merkle tree over rows numbered from 0 without gaps.

    A node covers the leaves lo to hi - 1; its left half has the larger part. A node's parent follows from its place
    alone, so each level is one aggregate of the level below.
    """
    leaves = df.select(F.col(pos).cast("long").alias("lo"), (F.col(pos) + 1).cast("long").alias("hi"), fnv(F.col(text)).cast("string").alias("hash"))
    n = leaves.count()
    deepest = max(n - 1, 0).bit_length()
    root = f"named_struct('a', 0L, 'b', {n}L)"
    middle = "(s.a + shiftright(s.b - s.a + 1, 1))"
    part = f"if(lo < {middle}, named_struct('a', s.a, 'b', {middle}), named_struct('a', {middle}, 'b', s.b))"
    grown = f"transform(array({part}), x -> named_struct('a', x.a, 'b', x.b, 'p', concat(s.p, array(x))))[0]"
    start = f"named_struct('a', 0L, 'b', {n}L, 'p', array({root}))"
    path = f"aggregate(sequence(1, {max(deepest, 1)}), {start}, (s, k) -> if(s.b - s.a <= 1, s, {grown}), s -> s.p)"
    # a leaf stands on the last level of its path
    placed = leaves.withColumn("path", F.expr(path)).withColumn("level", F.size("path") - 1)
    out = placed.select("level", "lo", "hi", "hash")
    below = placed.filter(F.col("level") == deepest)
    for level in range(deepest - 1, -1, -1):
        up = below.select(F.get("path", F.lit(level)).alias("up"), "path", "lo", "hash").groupBy("up").agg(
            F.min_by("path", "lo").alias("path"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "hash"))), lambda x: x["hash"]), "").alias("both")
        )
        made = up.select(F.lit(level).alias("level"), F.col("up.a").alias("lo"), F.col("up.b").alias("hi"), fnv(F.col("both")).cast("string").alias("hash"), "path")
        made = cut(made)
        out = out.unionByName(made.drop("path"))
        below = made.unionByName(placed.filter(F.col("level") == level).select("level", "lo", "hi", "hash", "path"))
    return out


# --- graphs ---------------------------------------------------------------------------------------------------


def graph_edges(edges: DataFrame, directed: bool) -> DataFrame:
    """src, dst, weight both ways unless directed; the last of equal edges doesn't count twice."""
    one = edges.select("src", "dst", "weight")
    both = one if directed else one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.dropDuplicates(["src", "dst"])


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight"))


def graph_counts(edges: DataFrame, directed: bool) -> DataFrame:
    """One row: nodes and edges (an undirected edge counts once)."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("n")).agg(F.count_distinct("n").alias("nodes"))
    ends = F.struct(F.least("src", "dst"), F.greatest("src", "dst")) if not directed else F.struct("src", "dst")
    return nodes.crossJoin(edges.agg(F.count_distinct(ends).alias("edges")))


def bfs(edges: DataFrame, start: list) -> DataFrame:
    """node and level (0 at the start) of all reachable nodes; each level is one join and one anti join, until none is new."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    known = spark.createDataFrame([(s, 0) for s in start], f"node {kind}, level int")
    front, level = known, 0
    while True:
        level += 1
        step = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(known, "node", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            return known
        known = known.unionByName(front)
        if level % 16 == 0:
            known = cut(known)


def connected(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node), by taking the neighbourhood's smallest label and following labels twice as far each round, until none changes."""
    both = graph_edges(edges.withColumn("weight", F.lit(1.0)), directed=False).select("src", "dst")
    labels = cut(both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    changed = True
    while changed:
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("label").alias("m"))
        low = labels.join(near, labels.node == near.src, "left").select("node", "label", F.least("label", F.coalesce("m", "label")).alias("to"))
        far = low.select(F.col("node").alias("to"), F.col("to").alias("further"))
        now = cut(low.join(far, "to", "left").select("node", "label", F.least("to", F.coalesce("further", "to")).alias("new")))
        changed = now.filter("label <> new").limit(1).count()
        labels = now.select("node", F.col("new").alias("label"))
    return labels.withColumnRenamed("label", "component")


def dfs_order(spark: SparkSession, edges: DataFrame, start: object, most_edges: int = 1_000_000) -> list:
    """Nodes in depth-first order: sequential, so on the driver, for graphs of at most ``most_edges`` edges."""
    rows = edges.select("src", "dst").limit(most_edges + 1).collect()
    if len(rows) > most_edges:
        raise ValueError(f"depth-first order is for at most {most_edges} edges")
    out, seen, stack, near = [], set(), [start], {}
    for r in sorted(rows):
        near.setdefault(r["src"], []).append(r["dst"])
    while stack:
        node = stack.pop()
        if node not in seen:
            seen.add(node)
            out.append(node)
            stack += [n for n in reversed(near.get(node, ())) if n not in seen]
    return out


# --- matrices (i, j, v) ---------------------------------------------------------------------------------------


def matrix_add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v")).filter("v <> 0")


def matrix_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    joined = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
    return joined.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v")).filter("v <> 0")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def nonzero(a: DataFrame) -> DataFrame:
    return a.filter("v <> 0").agg(F.count(F.lit(1)).alias("nnz"))


def dense(a: DataFrame, rows: int, columns: int) -> DataFrame:
    """Every cell, zeros included: rows * columns of them, as asked."""
    cells = a.sparkSession.range(rows * columns).select(F.floor(F.col("id") / columns).cast("int").alias("i"), (F.col("id") % columns).cast("int").alias("j"))
    return cells.join(a, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


# --- ranges ---------------------------------------------------------------------------------------------------


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """df with prefix, the sum of value up to each row of its group."""
    return df.withColumn("prefix", F.sum(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


#: Blocks of a range summary, about, and rows of a table that goes to all tasks.
BLOCKS, SMALL = 16_384, 200_000


def _to_end(values: DataFrame, ends: DataFrame, key: str, at: str, forward: bool) -> DataFrame:
    """ends (key, at) with n, s, a and b over the values (key, at, n, s, a, b) of their key: those before and at each end if forward, else those from it on."""
    rows = values.select(key, at, "n", "s", "a", "b", F.lit(0).alias("end")).unionByName(ends.select(key, at).withColumn("end", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(at).asc() if forward else F.col(at).desc(), "end").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(key, at, "end", F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s"), F.min("a").over(w).alias("a"), F.max("b").over(w).alias("b")).filter("end = 1").drop("end")


def range_aggregates(df: DataFrame, ranges: DataFrame, at: str, value: str, width: int = 1024) -> DataFrame:
    """ranges (lo, hi, and others) with n, sum, min and max of the values at places lo to hi, both included.

    A range over several blocks of ``width`` places (wider ones, where there would be more than BLOCKS of them) is the rest
    of its first block, whole blocks, and the beginning of its last one. Rests and beginnings are running aggregates, one for
    each different end. Runs of whole blocks from i to j meet at the middle of the smallest dyadic cell that holds both: one
    run from i to the middle and one from there to j, from a table of BLOCKS * log2(BLOCKS) rows. So a range is one row all
    along and sums are never differences. Ranges within one block are compared with its values, equal ones once.
    """
    span = df.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    if span["lo"] is None:
        span = {"lo": 0, "hi": 0}
    width = max(width, int(-(-(span["hi"] - span["lo"] + 1) // BLOCKS)))
    least, most = int(span["lo"] // width), int(span["hi"] // width)
    # numbers of blocks from 1, so that ends outside of all places have blocks of their own
    block = lambda c: (F.greatest(F.lit(least - 1), F.least(F.lit(most + 1), F.floor(c / width))) - (least - 1)).cast("int")
    levels = (most - least + 2).bit_length()
    v = F.col(value)
    values = df.filter(v.isNotNull() & F.col(at).isNotNull()).select(block(F.col(at)).alias("block"), F.col(at).alias("at"), F.lit(1).alias("n"), v.alias("s"), v.alias("a"), v.alias("b"))
    of = lambda d, *by: d.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("a").alias("a"), F.max("b").alias("b"))
    first, last, some = block(F.col("lo")), block(F.col("hi")), F.col("lo") <= F.col("hi")
    several, one = ranges.filter(some & (first < last)), ranges.filter(some & (first == last))

    # for each level, from each block to the end of its cell of 2 ** level blocks, and from the cell's beginning to it
    whole = cut(of(values, "block"))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: k.cast("int")))
    leveled = lambda d, *more: d.select("block", *more, cell.alias("level")).select((F.col("level").cast("long") * (1 << 32) + F.expr("shiftright(block, level)")).alias("cell"), "block", *more)
    held, every = leveled(whole, "n", "s", "a", "b"), leveled(df.sparkSession.range(most - least + 3).select(F.col("id").cast("int").alias("block")))
    tables = {}
    for name, forward in (("left", False), ("right", True)):
        runs = _to_end(held, every, "cell", "block", forward)
        tables[name] = F.broadcast(runs.select(F.shiftright("cell", 32).cast("int").alias("__level"), F.col("block").alias(f"__{name}"), *[F.col(c).alias(f"__{c}_{name}") for c in "nsab"]))
    # ends within blocks
    different = several.agg(F.approx_count_distinct("lo").alias("lo"), F.approx_count_distinct("hi").alias("hi")).first()
    for name, forward in (("lo", False), ("hi", True)):
        ends = several.select(F.col(name).alias("at")).distinct().withColumn("block", block(F.col("at")))
        tables[name] = _to_end(values, ends, "block", "at", forward).select(F.col("at").alias(name), *[F.col(c).alias(f"__{c}_{name}") for c in "nsab"])
        if different[name] <= SMALL:
            tables[name] = F.broadcast(tables[name])

    # runs of whole blocks lie between the ends' blocks; the level of the highest bit that differs, 0 for one block, which counts once
    left, right = first + 1, last - 1
    differ = left.bitwiseXOR(right)
    level = F.when(left < right, F.length(F.bin(differ)) - 1).when(left == right, F.lit(0)).cast("int")
    out = several
    # the larger table first, while rows are narrow
    for name in sorted(("lo", "hi"), key=lambda k: -different[k]):
        out = out.join(tables[name], name, "left")
    out = out.withColumns({"__level": level, "__left": left, "__right": F.when(left < right, right)})
    for name in ("left", "right"):
        out = out.join(tables[name], ["__level", f"__{name}"], "left")
    parts = ("lo", "left", "right", "hi")
    each = lambda c: [F.col(f"__{c}_{p}") for p in parts]
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = lambda c: sum((zero(x) for x in each(c)[1:]), zero(each(c)[0]))
    shown = [*ranges.columns]
    wide = out.select(*shown, total("n").alias("n"), F.when(F.coalesce(*each("s")).isNotNull(), total("s")).alias("sum"), F.least(*each("a")).alias("min"), F.greatest(*each("b")).alias("max"))

    asked = one.select("lo", "hi").distinct().withColumn("block", first)
    inside = asked.join(values, "block").filter("at between lo and hi").groupBy("block", "lo", "hi").agg(F.sum("n").alias("n"), F.sum("s").alias("sum"), F.min("a").alias("min"), F.max("b").alias("max"))
    narrow = one.join(inside.drop("block"), ["lo", "hi"], "left").select(*shown, F.coalesce("n", F.lit(0)).alias("n"), "sum", "min", "max")
    none = ranges.filter("not coalesce(lo <= hi, false)").select(*shown, F.lit(0).alias("n"))
    return wide.unionByName(narrow).unionByName(none, allowMissingColumns=True)


def sliding(df: DataFrame, group: list[str], order: list[str], value: str, before: int, after: int = 0) -> DataFrame:
    """df with low, high and total of value over rows from ``before`` back to ``after`` ahead."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-before, after)
    return df.withColumns({"low": F.min(value).over(w), "high": F.max(value).over(w), "total": F.sum(value).over(w)})


def count_in_range(df: DataFrame, at: str, value: str, wanted: object, lo: int, hi: int) -> DataFrame:
    """How often a value stands at places lo to hi."""
    return df.agg(F.count_if((F.col(value) == wanted) & F.col(at).between(lo, hi)).alias("n"))


def overlaps(intervals: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """Pairs of intervals (low, high, data) and asked ones (qlow, qhigh, and others) that share a point; both are closed.

    Both sides go to the buckets of ``width`` that they touch; a pair counts in the first bucket of both, so once.
    """
    cut = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    a = intervals.filter("low <= high").withColumn("bucket", cut("low", "high"))
    b = asked.filter("qlow <= qhigh").withColumn("bucket", cut("qlow", "qhigh"))
    met = a.join(b, "bucket").filter((F.col("low") <= F.col("qhigh")) & (F.col("qlow") <= F.col("high")))
    return met.filter(F.col("bucket") == F.floor(F.greatest("low", "qlow") / width)).drop("bucket")


# --- membership and points ------------------------------------------------------------------------------------


def members(df: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Rows whose value is a member: skip lists and treaps as a semi join."""
    return df.join(values.select(column), column, "left_semi")


#: Points of a block of the nearest-point search.
POINTS = 256


def nearest_point(points: DataFrame, asked: DataFrame, d: int, own: bool = True) -> DataFrame:
    """For each asked point (qid, q) the id, squared distance, of the nearest point (id, p) by its first d coordinates; ties to the smaller id.

    Points and asked ones are sorted together into ranges of the first coordinate and blocks of POINTS points by the second.
    What an asked point meets in its own block bounds its distance; then it goes to those blocks whose boxes come as near.
    Equal points are one, with their two smallest ids. Points with coordinates that are null or not finite, alike in which
    ones are how, are equal for this: any two of a kind stand for it, and the finite ones stand for all before such asked points.
    Without ``own`` a point whose id is qid doesn't count.
    """
    kind = lambda c: F.when(c.isNull(), "null").when(F.isnan(c), "nan").when(c == float("inf"), "high").when(c == float("-inf"), "low").otherwise("")
    at, to = [f"__p{i}" for i in range(d)], [f"__q{i}" for i in range(d)]
    p = points.select("id", *[F.get("p", F.lit(i)).cast("double").alias(c) for i, c in enumerate(at)]).withColumn("__kind", F.concat_ws("/", *[kind(F.col(c)) for c in at]))
    q = asked.select("qid", *[F.get("q", F.lit(i)).cast("double").alias(c) for i, c in enumerate(to)]).withColumn("__finite", F.concat_ws("", *[kind(F.col(c)) for c in to]) == "")
    fine = "/" * (d - 1)

    def two(rows: DataFrame, *by: str) -> DataFrame:
        """The two smallest ids of each group."""
        least = rows.groupBy(*by).agg(F.min("id").alias("__a"))
        same = [F.col(c) == F.col(f"__x{i}") for i, c in enumerate(by)]
        mine = least.select(*[F.col(c).alias(f"__x{i}") for i, c in enumerate(by)], F.col("__a").alias("__y"))
        more = rows.join(mine, reduce(lambda x, y: x & y, same)).filter(F.col("id") > F.col("__y")).groupBy(*by).agg(F.min("id").alias("__b"))
        return least.join(more, list(by), "left")

    gap = lambda x, y: (F.col(x) - F.col(y)) * (F.col(x) - F.col(y))
    dist = reduce(lambda x, y: x + y, [gap(x, y) for x, y in zip(at, to, strict=True)])
    allowed = lambda: F.col("__a") if own else F.when(F.col("__a") == F.col("qid"), F.col("__b")).otherwise(F.col("__a"))
    # a distance that is null comes last
    best = lambda met: met.select("qid", dist.alias("dist2"), allowed().alias("id")).filter("id is not null").groupBy("qid").agg(F.min(F.struct(F.col("dist2").isNull().alias("none"), "dist2", "id")).alias("x"))
    # one or two points of each kind, 5 ** d kinds at most
    reps = two(p, "__kind").join(p.groupBy("__kind").agg(*[F.min_by(c, "id").alias(c) for c in at]), "__kind")
    few = reps.select("__a", F.lit(None).cast("bigint").alias("__b"), *at)
    second = p.join(F.broadcast(reps.select(F.col("__b").alias("id"))), "id").select(F.col("id").alias("__a"), F.lit(None).cast("bigint").alias("__b"), *at)
    odd = best(q.crossJoin(F.broadcast(few.unionByName(second).distinct())))

    # finite points in blocks
    spots = two(p.filter(F.col("__kind") == fine), *at)
    both = spots.unionByName(q.filter("__finite").select("qid", *[F.col(y).alias(x) for x, y in zip(at, to, strict=True)]), allowMissingColumns=True)
    strips = ranged(both, *at)
    along = Window.partitionBy("__range").orderBy(*[at[(i + 1) % d] for i in range(d)], F.col("qid").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = cut(strips.withColumn("__block", F.floor((F.count("__a").over(along) - 1) / POINTS)))
    blocks = placed.filter("qid is null").drop("qid")
    home = placed.filter("qid is not null").select("qid", "__range", "__block", *[F.col(x).alias(y) for x, y in zip(at, to, strict=True)])
    near = best(home.join(blocks.select("__range", "__block", "__a", "__b", *at), ["__range", "__block"]))
    bound = cut(q.join(odd.select("qid", F.col("x").alias("__odd")), "qid", "left").join(near.select("qid", F.col("x").alias("__near")), "qid", "left").withColumn("x", F.least("__odd", "__near")).drop("__odd", "__near"))
    box = [F.min(c).alias(f"{c}_low") for c in at] + [F.max(c).alias(f"{c}_high") for c in at]
    boxes = blocks.groupBy("__range", "__block").agg(*box)
    wide = boxes.groupBy("__range").agg(*[F.min(f"{c}_low").alias(f"{c}_low") for c in at], *[F.max(f"{c}_high").alias(f"{c}_high") for c in at])
    beyond = lambda x, y: F.greatest(F.lit(0.0), F.col(f"{x}_low") - F.col(y), F.col(y) - F.col(f"{x}_high"))
    away = reduce(lambda x, y: x + y, [beyond(x, y) * beyond(x, y) for x, y in zip(at, to, strict=True)])
    edges = [f"{c}_{e}" for c in at for e in ("low", "high")]
    # ranges, then their blocks, whose boxes come as near as what is known; a margin for the rounding of distances
    asking = bound.filter("__finite").select("qid", *to, (F.coalesce(F.col("x.dist2"), F.lit(float("inf"))) * (1 + 1e-9)).alias("__bound"))
    reach = asking.join(F.broadcast(wide), away <= F.col("__bound")).drop(*edges).join(boxes, "__range").filter(away <= F.col("__bound")).select("qid", *to, "__range", "__block")
    found = best(reach.join(blocks.select("__range", "__block", "__a", "__b", *at), ["__range", "__block"]))
    out = bound.select("qid", "x").unionByName(found).groupBy("qid").agg(F.min("x").alias("x")).filter("x is not null")
    return out.select("qid", "x.id", "x.dist2")
