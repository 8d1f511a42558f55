"""Reading parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Inputs of more splits than this are read as they lie, however many cores there are.
FEW_SPLITS = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores where it has but a few splits, fewer than there are cores: for costly work on small inputs.

    A file of one row group is one task, however costly the expressions on it. Larger inputs have splits enough and are
    never shuffled for this; what is shuffled is FEW_SPLITS splits at most.
    """
    cores, n = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores) if n < min(cores, FEW_SPLITS + 1) else df
