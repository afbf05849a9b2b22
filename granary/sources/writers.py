"""Writers: delimited tables, JSON lines, wrapped exports, content-addressed caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def write_delimited(df: DataFrame, path: str, separator: str = "\t", joiner: str = " | ") -> None:
    """A delimited table with a header; arrays are joined in one cell."""
    flat = df.select(*[F.array_join(F.transform(f.name, lambda x: x.cast("string")), joiner).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in df.schema.fields])
    flat.write.mode("overwrite").csv(path, sep=separator, header=True, quote='"', escape='"')


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Several tables of one run side by side."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that an earlier, broken-off run has not finished."""
    return todo.join(done.select(key), key, "left_anti")


def fingerprint(df: DataFrame, key: str, *columns: str) -> str:
    """A digest of a table's content that does not depend on the order of its rows."""
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(key, *columns)).alias("x"), F.sum(F.xxhash64(key, *columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']:x}-{(row['x'] or 0) & (2**64 - 1):016x}-{int(row['s'] or 0) & (2**64 - 1):016x}"


def cached(spark: SparkSession, folder: str, name: str, print_: str, make) -> DataFrame:
    """The table made for this fingerprint before, else made now and kept. The folder must be one that all executors share."""
    path = f"{folder}/{name}/{print_}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def wrapped(df: DataFrame, **meta: str) -> DataFrame:
    """One row per partition of records in an export's envelope: meta data, count, docs. For files that are read as wrapper objects."""
    record = F.struct(*[F.col(c) for c in df.columns])
    part = df.select(F.spark_partition_id().alias("_p"), record.alias("d"))
    docs = part.groupBy("_p").agg(F.count("*").alias("n"), F.collect_list("d").alias("docs"))  # a partition's rows
    head = F.struct(*[F.lit(v).alias(k) for k, v in meta.items()]) if meta else F.lit(None).cast("string")
    return docs.select(head.alias("meta"), F.struct(F.col("n").alias("docs")).alias("counts"), "docs")
