"""The node store: sparse trees name(sub, ...) = value as rows (name, subs, value).

Only nodes with a value are rows; interior nodes follow from their descendants. Everything is DataFrame to DataFrame:
lookups are joins, siblings and walks are windows in collation order, deletion is an anti join. Windows are partitioned
by tree and parent path, so that one hot tree still spreads over its branches; the depth-first walk of whole trees and
the as-of join work on ranges of their order, whose ends meet through a table of one row for each range.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strings import reference
from ..functions.values import collation, collation_key, number_text, text
from .lineage import ranged

SCHEMA = "name string, subs array<string>, value string"
#: Roots of one depth that go to all nodes.
FEW_ROOTS = 10_000


def of_rows(spark: SparkSession, rows: Iterable[tuple[str, list[str], str]]) -> DataFrame:
    """Nodes from Python rows."""
    return spark.createDataFrame([(n, [str(s) for s in k], str(v)) for n, k, v in rows], SCHEMA)


def of_table(df: DataFrame, name: str, subs: list[Column], value: Column) -> DataFrame:
    """Nodes name(subs...) = value, one for each row of a table."""
    return df.select(F.lit(name).alias("name"), F.array(*[text(s) for s in subs]).alias("subs"), text(value).alias("value"))


def latest(nodes: DataFrame, order: str) -> DataFrame:
    """The last value set for each node, by an order column."""
    return nodes.groupBy("name", "subs").agg(F.max_by("value", order).alias("value"))


def get(nodes: DataFrame, wanted: DataFrame, default: str = "") -> DataFrame:
    """wanted (name, subs) with the value of each, or the default."""
    return wanted.join(nodes.select("name", "subs", "value"), ["name", "subs"], "left").withColumn("value", F.coalesce("value", F.lit(default)))


def put(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes with the values of changes, which win."""
    kept = nodes.join(changes.select("name", "subs"), ["name", "subs"], "left_anti")
    return kept.select("name", "subs", "value").unionByName(changes.select("name", "subs", "value"))


def delete(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """nodes without exactly these keys; what has no node doesn't matter."""
    return nodes.join(keys.select("name", "subs"), ["name", "subs"], "left_anti")


def below(subs: Column, prefix: list[str], proper: bool = False) -> Column:
    """Whether a path begins with prefix (and goes on, if proper)."""
    same = F.slice(subs, 1, len(prefix)) == F.array(*map(F.lit, prefix)).cast("array<string>") if prefix else F.lit(True)
    return same & (F.size(subs) > len(prefix) if proper else F.size(subs) >= len(prefix))


def kill(nodes: DataFrame, name: str, *prefix: str) -> DataFrame:
    """nodes without a node and all below it."""
    return nodes.filter(~((F.col("name") == name) & below(F.col("subs"), list(prefix))))


def kill_all(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes without any node of roots (name, subs) and all below.

    For each depth that roots have, nodes meet them by their own path cut to that depth, by hash; a few roots go to all
    nodes. Shorter paths, which many nodes share, take no part, and no node is ever several rows.
    """
    depths = {r["depth"]: r["n"] for r in roots.groupBy(F.size("subs").alias("depth")).agg(F.count(F.lit(1)).alias("n")).collect() if r["depth"] >= 0}
    left = nodes
    for depth in sorted(depths):
        own = roots.filter(F.size("subs") == depth).select(F.col("name").alias("__name"), F.col("subs").alias("__root"))
        own = F.broadcast(own) if depths[depth] <= FEW_ROOTS else own
        left = left.join(own, (F.col("name") == F.col("__name")) & (F.slice("subs", 1, depth) == F.col("__root")), "left_anti")
    return left


def kill_value(nodes: DataFrame, name: str, *subs: str) -> DataFrame:
    """nodes without one node; what is below stays."""
    return nodes.filter(~((F.col("name") == name) & (F.col("subs") == F.array(*map(F.lit, subs)).cast("array<string>"))))


def kill_except(nodes: DataFrame, *names: str) -> DataFrame:
    """Only the trees of these names."""
    return nodes.filter(F.col("name").isin(*names))


def merge(nodes: DataFrame, target: str, source: str, at: tuple[str, ...] = (), of: tuple[str, ...] = ()) -> DataFrame:
    """nodes with the tree at source(of...) copied onto target(at...); nodes that only the target has stay."""
    copied = nodes.filter((F.col("name") == source) & below(F.col("subs"), list(of))).select(
        F.lit(target).alias("name"), F.concat(F.array(*map(F.lit, at)).cast("array<string>"), F.slice("subs", len(of) + 1, F.size("subs"))).alias("subs"), "value"
    )
    return put(nodes, copied)


def descendants(nodes: DataFrame, name: str, *prefix: str) -> DataFrame:
    """subs (relative) and value of all nodes below a node."""
    rest = F.slice("subs", len(prefix) + 1, F.size("subs"))
    return nodes.filter((F.col("name") == name) & below(F.col("subs"), list(prefix), proper=True)).select(rest.alias("subs"), "value")


def names(nodes: DataFrame, prefix: str = "") -> DataFrame:
    """The names of trees that begin with prefix."""
    return nodes.filter(F.col("name").startswith(prefix)).select("name").distinct()


def with_interior(nodes: DataFrame) -> DataFrame:
    """name, subs and data of every node, interior ones too: 1 for a value, 10 for descendants, 11 for both."""
    own = F.transform(F.sequence(F.lit(0), F.size("subs")), lambda k: F.struct(F.slice("subs", F.lit(1), k).alias("subs"), (k == F.size("subs")).alias("own")))
    each = nodes.select("name", F.explode(own).alias("x")).select("name", "x.subs", "x.own")
    flags = F.max(F.col("own").cast("int")) + 10 * F.max((~F.col("own")).cast("int"))
    return each.groupBy("name", "subs").agg(flags.alias("data"))


def data(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (name, subs) with data: 0 where there is nothing, else as in with_interior."""
    return wanted.join(with_interior(nodes), ["name", "subs"], "left").withColumn("data", F.coalesce("data", F.lit(0)))


def siblings(nodes: DataFrame) -> DataFrame:
    """name, parent and sub of every node, with the next and previous sub below the same parent (empty at the ends)."""
    every = with_interior(nodes).filter(F.size("subs") > 0)
    split = every.select("name", F.slice("subs", F.lit(1), F.size("subs") - 1).alias("parent"), F.element_at("subs", -1).alias("sub"), "data")
    order = Window.partitionBy("name", "parent").orderBy(collation(F.col("sub")))
    return split.withColumns({"next": F.coalesce(F.lead("sub").over(order), F.lit("")), "previous": F.coalesce(F.lag("sub").over(order), F.lit(""))})


def order(nodes: DataFrame, wanted: DataFrame, backward: bool = False) -> DataFrame:
    """wanted (name, parent, sub) with ``found``: the sub that follows (or comes before) below the same parent, which need not exist.

    From the empty sub the first follows; backwards nothing does.
    """
    subs = with_interior(nodes).filter(F.size("subs") > 0).select("name", F.slice("subs", F.lit(1), F.size("subs") - 1).alias("parent"), F.element_at("subs", -1).alias("sub"))
    asked = wanted.select("name", "parent", "sub").distinct()
    both = subs.withColumn("own", F.lit(True)).unionByName(asked.withColumn("own", F.lit(False)))
    at = collation(F.col("sub"))
    # subs and asked places in one order, walked against the direction; an asked place comes before its equal
    rest = Window.partitionBy("name", "parent").orderBy(at.asc() if backward else at.desc(), "own").rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("found", F.last(F.when(F.col("own"), F.col("sub")), ignorenulls=True).over(rest)).filter("not own")
    found = F.when(F.col("sub") == "", F.lit(None)).otherwise(F.col("found")) if backward else F.col("found")
    return wanted.join(near.select("name", "parent", "sub", found.alias("found")), ["name", "parent", "sub"], "left").withColumn("found", F.coalesce("found", F.lit("")))


def first_last(nodes: DataFrame) -> DataFrame:
    """The first and last sub below every parent."""
    key = collation(F.col("sub"))
    return siblings(nodes).groupBy("name", "parent").agg(F.min_by("sub", key).alias("first"), F.max_by("sub", key).alias("last"))


def walk(nodes: DataFrame) -> DataFrame:
    """nodes in depth-first order within a tree: ref, next and previous as references (empty at the ends).

    Ranges of the order are walked apart, and the ends of each range meet the next one's.
    """
    shown = nodes.withColumn("ref", reference(F.col("name"), F.col("subs"))).withColumn("__key", collation_key(F.col("subs")))
    placed = ranged(shown, "name", "__key")
    by, across = Window.partitionBy("name", "__range").orderBy("__key"), Window.partitionBy("name").orderBy("__range")
    ends = placed.groupBy("name", "__range").agg(F.min_by("ref", "__key").alias("first"), F.max_by("ref", "__key").alias("last"))
    ends = ends.select("name", "__range", F.lead("first").over(across).alias("__after"), F.lag("last").over(across).alias("__before"))
    met = placed.join(ends, ["name", "__range"])
    none = F.lit("")
    out = met.withColumns({"next": F.coalesce(F.lead("ref").over(by), "__after", none), "previous": F.coalesce(F.lag("ref").over(by), "__before", none)})
    return out.select(*nodes.columns, "ref", "next", "previous")


def dump(nodes: DataFrame) -> DataFrame:
    """Lines ref="value" in order of trees and nodes."""
    line = F.concat(reference(F.col("name"), F.col("subs")), F.lit('="'), F.regexp_replace("value", '"', '""'), F.lit('"'))
    return nodes.orderBy("name", collation_key(F.col("subs"))).select(line.alias("line"))


def tally(df: DataFrame, name: str, subs: list[Column], value: Column) -> DataFrame:
    """The counting idiom: for each path the sum of a number, as nodes."""
    keys = [text(s).alias(f"k{i}") for i, s in enumerate(subs)]
    grouped = df.select(*keys, value.alias("v")).groupBy(*[f"k{i}" for i in range(len(subs))]).agg(F.sum("v").cast("double").alias("v"))
    return of_table(grouped, name, [F.col(f"k{i}") for i in range(len(subs))], number_text(F.col("v")))


def increment(df: DataFrame, group: list[str], by: list[str], step: Column | int = 1) -> DataFrame:
    """df with ``counter``: the running sum of step in each group."""
    amount = step if isinstance(step, Column) else F.lit(step)
    return df.withColumn("counter", F.sum(amount).over(Window.partitionBy(*group).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)))


def as_of(left: DataFrame, right: DataFrame, on: list[str], at: str, value: str) -> DataFrame:
    """left with the value of the last row of right at or before its ``at`` (same ``on``, or any row if that is empty).

    Both sides are sorted together in ranges; a range without a row of right before a place takes the last one of the
    ranges before it. Of several rows of right at one place any may count. Null values count as no row.
    """
    rows = left.withColumns({"__v": F.lit(None).cast(dict(right.dtypes)[value]), "__left": F.lit(1)}).unionByName(
        right.select(*on, at, F.col(value).alias("__v")).withColumn("__left", F.lit(0)), allowMissingColumns=True
    )
    placed = ranged(rows, *on, at, "__left")
    within = Window.partitionBy("__range", *on).orderBy(at, "__left").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.groupBy("__range", *on).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(at, "__left"))).alias("__last"))
    before = Window.partitionBy(*on).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range and group
    own = [f"__on{i}" for i in range(len(on))]
    carried = ends.select(F.col("__range").alias("__r"), *[F.col(c).alias(k) for c, k in zip(on, own, strict=True)], F.last("__last", ignorenulls=True).over(before).alias("__before"))
    same = F.col("__range") == F.col("__r")
    for c, k in zip(on, own, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    met = placed.join(carried, same, "left").drop("__r", *own)
    found = F.coalesce(F.last("__v", ignorenulls=True).over(within), "__before")
    return met.withColumn(value, found).filter("__left = 1").drop("__v", "__left", "__range", "__before")
