"""Ranks over a whole table without a window over all rows.

Equal values are counted first; the distinct values are range-partitioned and counted up inside each
partition, and the totals of the partitions, one number each, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import keep


def cumulative(df: DataFrame, value: str, by: list[str] | None = None, weight: Column | None = None, partitions: int | None = None) -> DataFrame:
    """(by..., value, n, below, total): how many rows of the group have the value, a smaller one, and are there at all. Null values are left out."""
    by = by or []
    n = F.count("*") if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("n"))
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = counts.repartitionByRange(parts, *by, value).withColumn("_p", F.spark_partition_id())
    ordered = keep(ordered)
    inside = Window.partitionBy("_p", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sums = ordered.groupBy(*by, "_p").agg(F.sum("n").alias("_n"))  # a number for each group and partition
    along = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = sums.select(*by, "_p", F.coalesce(F.sum("_n").over(along.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_n").over(along).alias("total"))
    out = ordered.withColumn("_b", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, [*by, "_p"])
    return out.select(*by, value, "n", (F.col("_b") + F.col("_o")).alias("below"), "total")


def average_rank(below: Column, n: Column) -> Column:
    """Rank from 1 in which equal values share the mean of their places."""
    return below + (n + 1) / 2


def at_index(cum: DataFrame, value: str, by: list[str], position: Column, name: str) -> DataFrame:
    """(by..., name): the value at a position counted from 0 in ascending order; ``position`` may use total."""
    hit = (position >= F.col("below")) & (position < F.col("below") + F.col("n"))
    found = cum.where(hit).select(*by, F.col(value).alias(name))
    return found


def quantiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by..., n, one column per share): quantiles with linear interpolation between places, exact, null values aside.

    Each is read off the cumulative counts at the two places around it, so no group is gathered: what is shuffled are distinct values with their counts.
    """
    cum = cumulative(df, value, by)
    place = {name: (F.col("total") - 1) * share for name, share in shares.items()}
    at = lambda i: F.max(F.when((i >= F.col("below")) & (i < F.col("below") + F.col("n")), F.col(value).cast("double")))
    ends = [c for name, i in place.items() for c in (at(F.floor(i)).alias(f"_a_{name}"), at(F.ceil(i)).alias(f"_z_{name}"), F.max(i - F.floor(i)).alias(f"_f_{name}"))]
    out = cum.groupBy(*by).agg(F.max("total").alias("n"), *ends)
    return out.select(*by, "n", *[(F.col(f"_a_{x}") + (F.col(f"_z_{x}") - F.col(f"_a_{x}")) * F.col(f"_f_{x}")).alias(x) for x in shares])


def ranked_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, rx, ry): rows where both are known, with average ranks."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    for c, r in ((x, "rx"), (y, "ry")):
        rows = rows.join(cumulative(rows, c).select(c, average_rank(F.col("below"), F.col("n")).alias(r)), c)
    return rows


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, rho. Null where a side does not vary."""
    return ranked_pair(df, x, y).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))
