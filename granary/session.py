"""Session with the settings that the operators are planned for."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, partitions: int | None = None, memory: str | None = None, name: str = "granary") -> SparkSession:
    """A session; without ``master`` the submitting cluster's. On a cluster leave ``partitions`` to AQE's advisory size."""
    builder = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that all executors share for checkpoints, as the cluster names it; None where it names none."""
    return spark.conf.get("spark.checkpoint.dir", None)


_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist what an operator reads twice. It stays until ``release``, as the operator's result is computed later; lost blocks are made again."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(df)
    return df


def release() -> None:
    """Free all that operators kept, once their results are written."""
    while _kept:
        df = _kept.pop()
        if df.sparkSession.sparkContext._jsc is not None:
            df.unpersist()
