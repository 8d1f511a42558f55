"""Collections, addressed by id, as results of operation logs.

A log has one row for each operation: id (which collection), seq (the order within it), op, and key or value columns.
Final states are aggregates or windows within an id; stacks and queues pair removals with additions by counting, so no
log is replayed row by row. Deques, whose ends mix, are replayed in Python, one id at a time.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUNNING = (Window.unboundedPreceding, 0)


def array(log: DataFrame) -> DataFrame:
    """id, items in order, length, of logs of additions; an array is a value of one row, so for ids whose items fit into one."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"])
    return log.groupBy("id").agg(items.alias("items")).withColumn("len", F.size("items"))


def array_get(log: DataFrame, at: int) -> DataFrame:
    """id and the item at a place counted from 0, empty beyond the end."""
    return array(log).select("id", F.coalesce(F.get("items", F.lit(at)), F.lit("")).alias("value"))


def array_set(log: DataFrame) -> DataFrame:
    """id, pos, value: the last value set at each place (log: id, seq, pos, value)."""
    return log.groupBy("id", "pos").agg(F.max_by("value", "seq").alias("value"))


def mapping(log: DataFrame) -> DataFrame:
    """id, key, value of maps and objects after sets and deletions (op 'set' or 'del'); the last operation on a key counts."""
    last = log.groupBy("id", "key").agg(F.max_by(F.struct("op", "value"), "seq").alias("x"))
    return last.filter(F.col("x.op") == "set").select("id", "key", "x.value")


def map_keys(entries: DataFrame) -> DataFrame:
    """id, keys and values joined by commas in byte order of keys, and how many."""
    sorted_ = F.array_sort(F.collect_list(F.struct("key", "value")))
    out = entries.groupBy("id").agg(sorted_.alias("e"))
    return out.select("id", F.array_join(F.col("e.key"), ",").alias("keys"), F.array_join(F.col("e.value"), ",").alias("values"), F.size("e").alias("len"))


def distinct_set(log: DataFrame) -> DataFrame:
    """id, value of sets after additions and removals (op 'add' or 'del')."""
    return log.groupBy("id", "value").agg(F.max_by("op", "seq").alias("op")).filter("op = 'add'").select("id", "value")


def sorted_values(values: DataFrame) -> DataFrame:
    """id and its distinct values in byte order, comma-joined, and how many."""
    out = values.groupBy("id").agg(F.array_sort(F.collect_set("value")).alias("v"))
    return out.select("id", F.array_join("v", ",").alias("items"), F.size("v").alias("len"))


def bag(log: DataFrame) -> DataFrame:
    """id, value and count of multisets; a removal takes one copy if there is one (op 'add' or 'del')."""
    step = F.when(F.col("op") == "add", 1).otherwise(-1)
    order = Window.partitionBy("id", "value").orderBy("seq").rowsBetween(*RUNNING)
    run = log.withColumn("sum", F.sum(step).over(order))
    # removals of nothing lower the running sum below zero; the lowest point says how many
    out = run.groupBy("id", "value").agg((F.max_by("sum", "seq") - F.least(F.min("sum"), F.lit(0))).alias("n"))
    return out.filter("n > 0")


def bag_size(bag_: DataFrame) -> DataFrame:
    """id, all copies and distinct values."""
    return bag_.groupBy("id").agg(F.sum("n").alias("len"), F.count(F.lit(1)).alias("unique_len"))


def queue_pairs(log: DataFrame) -> DataFrame:
    """id, seq of each dequeue and the value it gets: the k-th successful one gets the k-th value (op 'push' or 'pop').

    A dequeue of an empty queue gets nothing and has no row.
    """
    ok = _successful(log)
    number = F.row_number().over(Window.partitionBy("id", "op").orderBy("seq")).alias("k")
    counted = ok.select("id", "seq", "op", "value", number)
    pushed = counted.filter("op = 'push'").select("id", "k", "value")
    return counted.filter("op = 'pop'").select("id", "k", "seq").join(pushed, ["id", "k"]).select("id", "seq", "value")


def queue_rest(log: DataFrame) -> DataFrame:
    """id, value, place (from 1) of what stays in each queue."""
    ok = _successful(log)
    gone = ok.groupBy("id").agg(F.count_if(F.col("op") == "pop").alias("gone"))
    number = F.row_number().over(Window.partitionBy("id").orderBy("seq")).alias("k")
    pushed = ok.filter("op = 'push'").select("id", "seq", "value", number)
    return pushed.join(gone, "id").filter("k > gone").select("id", "value", (F.col("k") - F.col("gone")).alias("place"))


def _successful(log: DataFrame) -> DataFrame:
    """The log without removals from empty collections: those at which the running sum reaches a new low below zero."""
    order = Window.partitionBy("id").orderBy("seq").rowsBetween(*RUNNING)
    run = log.withColumn("sum", F.sum(F.when(F.col("op") == "push", 1).otherwise(-1)).over(order))
    low = run.withColumn("low", F.coalesce(F.min("sum").over(Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return low.filter((F.col("op") == "push") | (F.col("sum") >= F.least("low", F.lit(0)))).drop("sum", "low")


def stack_pairs(log: DataFrame) -> DataFrame:
    """id, seq of each successful pop and the value it gets: the last push that came to the height the pop leaves."""
    order = Window.partitionBy("id").orderBy("seq").rowsBetween(*RUNNING)
    run = _successful(log).withColumn("height", F.sum(F.when(F.col("op") == "push", 1).otherwise(-1)).over(order))
    at = run.withColumn("h", F.when(F.col("op") == "push", F.col("height")).otherwise(F.col("height") + 1))
    by = Window.partitionBy("id", "h").orderBy("seq")
    return at.withColumn("got", F.lag("value").over(by)).filter("op = 'pop'").select("id", "seq", F.col("got").alias("value"))


def stack_rest(log: DataFrame) -> DataFrame:
    """id, place from the bottom (1) and value of what stays on each stack; the top is the largest place."""
    order = Window.partitionBy("id").orderBy("seq").rowsBetween(*RUNNING)
    run = _successful(log).withColumn("height", F.sum(F.when(F.col("op") == "push", 1).otherwise(-1)).over(order))
    later = Window.partitionBy("id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    low = run.withColumn("least", F.min("height").over(later))
    return low.filter((F.col("op") == "push") & (F.col("least").isNull() | (F.col("least") >= F.col("height")))).select("id", F.col("height").alias("place"), "value")


def deques(log: DataFrame) -> DataFrame:
    """id, items (comma-joined from the front) and len after addfirst, addlast, popfirst and poplast, in order of seq."""

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        d: deque = deque()
        do = {"addfirst": d.appendleft, "addlast": d.append}
        take = {"popfirst": d.popleft, "poplast": d.pop}
        for op, value in pdf.sort_values("seq")[["op", "value"]].itertuples(index=False):
            if op in do:
                do[op](value)
            elif d:
                take[op]()
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "items": [",".join(map(str, d))], "len": [len(d)]})

    kind = dict(log.dtypes)["id"]
    return log.groupBy("id").applyInPandas(replay, f"id {kind}, items string, len long")


def ring(log: DataFrame, capacity: int) -> DataFrame:
    """id, place (oldest first, from 1) and value: the last ``capacity`` values of each id."""
    back = Window.partitionBy("id").orderBy(F.desc("seq"))
    last = log.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= capacity)
    return last.select("id", F.row_number().over(Window.partitionBy("id").orderBy("seq")).alias("place"), "seq", "value")


def lru(log: DataFrame, capacity: int) -> DataFrame:
    """id, key, value and back (1 for the last used) of what a cache holds in the end; gets that find their key and all puts count as use.

    Whether a get finds its key depends on all that came before, so each id's log is replayed.
    """
    rows = lru_replay(log, capacity).select("id", F.posexplode("held").alias("at", "x"), F.size("held").alias("n"))
    return rows.select("id", "x.key", "x.value", (F.col("n") - F.col("at")).alias("back"))


def lru_replay(log: DataFrame, capacity: int) -> DataFrame:
    """id, hits, misses, keys (least used first) and held (keys and values, in that order) of a cache replayed operation by operation."""

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        hits = misses = 0
        for op, key, value in pdf.sort_values("seq")[["op", "key", "value"]].itertuples(index=False):
            if op == "get":
                if key in held:
                    held[key] = held.pop(key)
                    hits += 1
                else:
                    misses += 1
                continue
            held.pop(key, None)
            held[key] = value
            if len(held) > capacity:
                held.pop(next(iter(held)))
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "hits": [hits], "misses": [misses], "keys": [",".join(map(str, held))], "held": [[{"key": k, "value": v} for k, v in held.items()]]})

    kinds = dict(log.dtypes)
    return log.groupBy("id").applyInPandas(replay, f"id {kinds['id']}, hits long, misses long, keys string, held array<struct<key:{kinds['key']},value:{kinds['value']}>>")


def heap(df: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """The k smallest values of each group, with their rank; equal values keep their places."""
    by = Window.partitionBy(*group).orderBy(value)
    return df.select(*group, value, F.row_number().over(by).alias("rank")).filter(F.col("rank") <= k)


def top(df: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows of an order."""
    return df.orderBy(*order).limit(k)

