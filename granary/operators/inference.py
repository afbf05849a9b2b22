"""Intervals and tests: bootstraps by hash, partial rank correlation, power, thresholds, rank stability."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.arrow import map_columns
from granary.operators.ranks import average_rank, cumulative, quantiles
from granary.session import keep


def _poisson_table(bits: int = 16) -> np.ndarray:
    """Poisson(1) draws for all values of so many random bits."""
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(steps, (np.arange(1 << bits) + 0.5) / (1 << bits)).astype(np.float32)


def poisson_weights(hashes: list[int], rounds: int, block: int = 256) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, rows x rounds of Poisson(1) weights) for blocks of hashed rows: each weight is a mixture of the row's hash and the round's number, so it does not
    depend on partitions."""
    table = _poisson_table()
    seeds = np.array(hashes, np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        turns = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for start in range(0, len(seeds), block):
            x = seeds[start : start + block, None] + turns
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            yield slice(start, start + block), table[(x ^ (x >> np.uint64(31))) >> np.uint64(48)]


def _weighted_sums(df: DataFrame, key: str, values: list[str], rounds: int, seed: int) -> DataFrame:
    """(r, n, value sums) per bootstrap round: rows weigh Poisson(1) by a hash of their key; one vector per batch is shuffled."""

    def make():
        def work(hashes, *columns):
            matrix = np.array([[1.0] * len(hashes), *columns])
            sums = np.zeros((len(matrix), rounds))
            for at, weights in poisson_weights(hashes, rounds):
                sums += matrix[:, at] @ weights
            return [list(range(rounds)), *sums.tolist()]

        return work

    known = df.where(" AND ".join(f"`{v}` IS NOT NULL" for v in values))
    rows = known.select(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), *[F.col(v).cast("double").alias(f"x{i}") for i, v in enumerate(values)])
    schema = "r int, n double, " + ", ".join(f"s{i} double" for i in range(len(values)))
    out = map_columns(rows, make, schema)
    return out.groupBy("r").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(values))]).where("n > 0")


def mean_interval(df: DataFrame, key: str, value: str, rounds: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """One row: n, mean, low, high; under five values low and high are the mean."""
    point = df.where(F.col(value).isNotNull()).agg(F.count("*").alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))
    means = _weighted_sums(df, key, [value], rounds, seed).select((F.col("s0") / F.col("n")).alias("m"))
    spread = quantiles(means, "m", [], {"lo": alpha / 2, "hi": 1 - alpha / 2}).drop("n")
    few = F.col("n") < 5
    return point.crossJoin(spread).select("n", "mean", F.when(few, F.col("mean")).otherwise(F.col("lo")).alias("low"), F.when(few, F.col("mean")).otherwise(F.col("hi")).alias("high"))


def paired_test(df: DataFrame, key: str, a: str, b: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """One row: n, difference of means b - a, two-sided p by a centred bootstrap, at least 1 / rounds."""
    point = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.avg(F.col(b).cast("double") - F.col(a)).alias("difference"))
    drawn = _weighted_sums(df, key, [a, b], rounds, seed).select(((F.col("s1") - F.col("s0")) / F.col("n")).alias("d"))
    both = drawn.crossJoin(point)
    extreme = both.groupBy("n", "difference").agg(F.avg((F.abs(F.col("d") - F.col("difference")) >= F.abs("difference")).cast("double")).alias("share"))
    return extreme.select("n", "difference", F.greatest("share", F.lit(1.0 / rounds)).alias("p"))


def significance(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def partial_spearman(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """One row: n, rho, rho with the ranks of z held fixed; null where it is not defined."""
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (x, y, z))).select(x, y, z)
    rows = keep(rows)
    for c in (x, y, z):
        rows = rows.join(cumulative(rows.select(c), c).select(c, average_rank(F.col("below"), F.col("n")).alias(f"_r{c}")), c)
    r = rows.agg(F.count("*").alias("n"), F.corr(f"_r{x}", f"_r{y}").alias("xy"), F.corr(f"_r{x}", f"_r{z}").alias("xz"), F.corr(f"_r{y}", f"_r{z}").alias("yz"))
    return r.select("n", F.col("xy").alias("rho"), F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))).alias("partial_rho"))


def spearman_brown(r: Column, k: float) -> Column:
    """Reliability of k raters together from that of one."""
    return k * r / (1 + (k - 1) * r)


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution, by bisection on its closed form."""
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    low, high = -12.0, 12.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if 0.5 * math.erfc(-middle / math.sqrt(2)) < p else (low, middle)
    return (low + high) / 2


def needed_size(n: int, standard_error: float, effect: float, alpha: float = 0.05, power: float = 0.8) -> float:
    """How many observations find an effect, when n have this standard error."""
    return n * (standard_error * (normal_quantile(1 - alpha / 2) + normal_quantile(power)) / effect) ** 2


def lowest_lasting(bins: DataFrame, order: str, low: str, rate: str, target: float) -> DataFrame:
    """One row: the lower edge of the first bin whose rate reaches the target while no later one falls under nine tenths of it; no row without one."""
    later = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(0, Window.unboundedFollowing)  # a few bins
    good = bins.withColumn("_least", F.min(rate).over(later)).where((F.col(rate) >= target) & (F.col("_least") >= 0.9 * target))
    return good.orderBy(order).limit(1).select(F.col(low).alias("threshold"))


def rank_stability(df: DataFrame, key: str, indicators: list[str], weightings: dict[str, dict[str, float]], nominal: dict[str, float]) -> DataFrame:
    """(weighting, n, rho, mean_shift, max_shift, over_tenth): how the ranking of rows moves when the indicators are weighed differently."""
    mean = lambda w: sum((F.col(c) * w.get(c, 0.0) for c in indicators), F.lit(0.0)) / sum(w.get(c, 0.0) for c in indicators)
    base = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in indicators)).select(key, F.round(mean(nominal), 9).alias("_base"), *[F.round(mean(w), 9).alias(f"_w_{n}") for n, w in weightings.items()])
    base = keep(base)
    rank = lambda c: cumulative(base.select(c), c).select(c, average_rank(F.col("below"), F.col("n")).alias(f"_r{c}"))
    rows = base.join(rank("_base"), "_base")
    out = None
    for n in weightings:
        c = f"_w_{n}"
        part = rows.join(rank(c), c)
        shift = F.abs(F.col("_r_base") - F.col(f"_r{c}"))
        one = part.agg(F.count("*").alias("n"), F.corr("_r_base", f"_r{c}").alias("rho"), F.avg(shift).alias("mean_shift"), F.max(shift).alias("max_shift"), F.avg(F.lit(0.0)).alias("_")).drop("_")
        over = part.crossJoin(part.agg(F.count("*").alias("_n"))).agg(F.avg((shift > 0.1 * F.col("_n")).cast("double")).alias("over_tenth"))
        one = one.crossJoin(over).select(F.lit(n).alias("weighting"), "n", "rho", "mean_shift", "max_shift", "over_tenth")
        out = one if out is None else out.unionByName(one)
    return out


def error_patterns(df: DataFrame, truth: str, guess: str, by: list[str]) -> DataFrame:
    """(by..., n, bias, spread, over, under, exact): how guesses miss; exact is within half a step."""
    e = F.col(guess) - F.col(truth)
    return df.where(e.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(e).alias("bias"), F.stddev_pop(e).alias("spread"), F.avg((e > 0.5).cast("double")).alias("over"), F.avg((e < -0.5).cast("double")).alias("under"), F.avg((F.abs(e) <= 0.5).cast("double")).alias("exact")
    )
