"""Tables by folder and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table, spread over the cores where it has fewer splits than there are cores.

    A large table has more splits than cores and is left as it is; only a table of a few row groups, whose work would all be
    one task's, is dealt out. Column pruning reaches the scan through that step.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df
