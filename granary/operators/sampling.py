"""Deterministic samples: every choice is by a hash of the key, so partitions and runs do not matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int) -> Column:
    """The sort key of a row: the same in any engine that has md5."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def quotas(df: DataFrame, strata: list[str], target: int) -> DataFrame:
    """(strata..., n, quota): proportional places by largest remainder; equal remainders go to the stratum that is last in order.

    With no more rows than places everything is taken. A stratum never gets more than it has.
    """
    counts = df.groupBy(*strata).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    ideal = counts.crossJoin(F.broadcast(total)).withColumn("ideal", F.col("n") * target / F.col("total")).withColumn("base", F.floor("ideal"))
    left = ideal.agg((F.lit(target) - F.sum("base")).alias("left"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("ideal") - F.col("base"), 9)), *[F.desc(s) for s in strata])  # one row per stratum
    placed = ideal.crossJoin(F.broadcast(left)).withColumn("i", F.row_number().over(order))
    quota = F.when(F.col("total") <= target, F.col("n")).otherwise(F.least("n", F.col("base") + F.when(F.col("i") <= F.col("left"), 1).otherwise(0)))
    return placed.select(*strata, "n", quota.cast("long").alias("quota"))


def lane_ranked(df: DataFrame, by: list[str], key: str, seed: int, most: int | None = None) -> DataFrame:
    """Rows with ``place`` from 1 in the order of their draw within each group.

    With ``most``, a group is first cut to its ``most`` lowest draws in each of 64 hash lanes, so a hot group is thinned in parallel before its rows meet.
    """
    rows = df.withColumn("_d", draw(F.col(key), seed)).withColumn("_lane", F.pmod(F.xxhash64(key), F.lit(64)))
    if most is not None:
        lane = Window.partitionBy(*by, "_lane").orderBy("_d", key)
        rows = rows.withColumn("_i", F.row_number().over(lane)).where(F.col("_i") <= most).drop("_i")
    place = Window.partitionBy(*by).orderBy("_d", key) if by else Window.partitionBy(F.lit(0)).orderBy("_d", key)
    return rows.withColumn("place", F.row_number().over(place).cast("long")).drop("_d", "_lane")


def stratified(df: DataFrame, strata: list[str], key: str, target: int, seed: int = 42) -> DataFrame:
    """A sample of ``target`` rows in the proportions of the strata."""
    want = quotas(df, strata, target).where("quota > 0").select(*strata, "quota")  # at most ``target`` strata have a place
    return lane_ranked(df, strata, key, seed, most=target).join(F.broadcast(want), strata).where("place <= quota").drop("quota")


def per_group(df: DataFrame, by: list[str], key: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each group."""
    return lane_ranked(df, by, key, seed, most).where(F.col("place") <= most)


def round_robin(df: DataFrame, by: list[str], key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows by taking one of each group in turn, groups in order: (key, by..., place, turn)."""
    ranked = lane_ranked(df, by, key, seed, most=size)
    near = ranked.orderBy("place", *by, key).limit(size)
    turn = Window.partitionBy(F.lit(0)).orderBy("place", *by, key)  # size rows
    return near.withColumn("turn", F.row_number().over(turn).cast("long"))


def detection_size(confidence: float, defect_rate: float) -> Column:
    """How many rows to look at to meet a defect of this rate with this confidence."""
    return F.ceil(F.ln(F.lit(1 - confidence)) / F.ln(F.lit(1 - defect_rate)))
