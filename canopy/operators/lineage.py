"""Cutting lineage in loops, so that plans stay short and lost executors cost one round, and orders over several tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in the folder that spark.checkpoint.dir names.

    Where none is named, a local master gets a temporary folder, as in tests; on a cluster this raises.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="canopy-"))
    return df.checkpoint()


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """df in ranges of an order, numbered by __range in that order: what no single task could sort."""
    # fixed behind the checkpoint: the ranges come from a sample
    return cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))


def numbered(df: DataFrame, order: list, column: str) -> DataFrame:
    """df with its place, from 1, in an order: places within ranges, after all rows of the ranges before."""
    placed = ranged(df, *order)
    before = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    # a row for each range
    before = before.withColumn("__before", F.sum("n").over(Window.orderBy("__range")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.col("__before")
    return placed.join(F.broadcast(before), "__range").withColumn(column, place).select(*df.columns, column)
