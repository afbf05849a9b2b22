"""Agreement, calibration, drift and weighting statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.numeric import bands
from granary.operators.ranks import average_rank, cumulative, quantiles
from granary.session import keep


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agreement, kappa of two columns of labels; kappa is 1 where chance agreement is complete. Rows with a null are left out."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))  # as many rows as pairs of labels
    rows = pairs.groupBy(F.col(a).alias("v")).agg(F.sum("n").alias("ra"))
    cols = pairs.groupBy(F.col(b).alias("v")).agg(F.sum("n").alias("rb"))
    total = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    chance = rows.join(cols, "v").agg(F.coalesce(F.sum(F.col("ra").cast("double") * F.col("rb")), F.lit(0.0)).alias("both"))
    out = total.crossJoin(chance).select("n", (F.col("same") / F.col("n")).alias("agreement"), (F.col("both") / (F.col("n") * F.col("n"))).alias("pe"))
    return out.select("n", "agreement", F.when(F.col("pe") >= 1, 1.0).otherwise((F.col("agreement") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def fleiss_kappa(votes: DataFrame, items: list[str], vote: str, raters: int, order: str | None = None) -> DataFrame:
    """One row: n_items, agreement, kappa. Items with fewer than ``raters`` votes are left out; items with more give their first ones by the column ``order``, and are left out without it."""
    if order:
        # A rater's place among an item's votes: as many rows as raters, never a hot group.
        place = F.row_number().over(Window.partitionBy(*items).orderBy(order, vote))
        votes = votes.where(F.col(vote).isNotNull()).withColumn("_i", place).where(F.col("_i") <= raters).drop("_i")
    counts = votes.groupBy(*items, vote).agg(F.count("*").alias("c"))
    per_item = counts.groupBy(*items).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq")).where(F.col("m") == raters)
    p = per_item.agg(F.count("*").alias("n_items"), F.avg((F.col("sq") - raters) / (raters * (raters - 1))).alias("agreement"))
    full = counts.join(per_item.select(*items), items, "left_semi").groupBy(vote).agg(F.sum("c").alias("t"))
    chance = full.agg((F.sum(F.col("t") * F.col("t")) / F.pow(F.sum("t"), F.lit(2))).alias("pe"))
    return p.crossJoin(chance).select("n_items", "agreement", F.when(F.col("pe") >= 1, 1.0).otherwise((F.col("agreement") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def panel_grades(votes: DataFrame, items: list[str], vote: str) -> DataFrame:
    """(items..., grade, spread, n_votes, status): the most frequent vote, of equals the lower; unanimous, majority or split."""
    counts = votes.where(F.col(vote).isNotNull()).groupBy(*items, vote).agg(F.count("*").alias("c"))
    out = counts.groupBy(*items).agg(F.max(F.struct("c", (-F.col(vote)).alias("g"))).alias("top"), (F.max(vote) - F.min(vote)).alias("spread"), F.sum("c").alias("n_votes"))
    share = F.col("top.c") / F.col("n_votes")
    status = F.when(F.col("spread") == 0, "unanimous").when(share > 0.5, "majority").otherwise("split")
    return out.select(*items, (-F.col("top.g")).alias("grade"), "spread", "n_votes", status.alias("status"))


def rater_pairs(votes: DataFrame, items: list[str], rater: str, vote: str, raters: list[int]) -> DataFrame:
    """(a, b, n, agreement, kappa) for each pair of a small, given set of raters."""
    wide = votes.groupBy(*items).pivot(rater, raters).agg(F.first(vote))
    out = None
    for a, b in combinations(raters, 2):
        one = cohens_kappa(wide, str(a), str(b)).select(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), "n", "agreement", "kappa")
        out = one if out is None else out.unionByName(one)
    return out


def calibration_bins(df: DataFrame, score: str, good: str, bins: int, least: int) -> DataFrame:
    """(bin, low, high, n, p): share of good rows in bins of equal count by score; a short last bin joins the one before.

    ``good`` is 0 or 1. Rows of one score may fall into two bins, as counted; within a score the good ones come first.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.sum(good).alias("g"))
    cum = cumulative(df, score).select(score, "below", "total").join(counts, score)
    per = F.greatest(F.lit(least), F.floor(F.col("total") / bins))
    last = F.greatest(F.lit(0), F.floor(F.col("total") / per) - 1 + F.when(F.col("total") % per >= least, 1).otherwise(0))
    clip = lambda i: F.least(F.floor(i / per), last)
    parts = cum.withColumns({"per": per, "last": last}).withColumn("bin", F.explode(F.sequence(clip(F.col("below")), clip(F.col("below") + F.col("n") - 1))))
    start = F.greatest(F.col("below"), F.col("bin") * F.col("per"))
    end = F.when(F.col("bin") == F.col("last"), F.col("below") + F.col("n")).otherwise(F.least(F.col("below") + F.col("n"), (F.col("bin") + 1) * F.col("per")))
    took = lambda at: F.least(F.greatest(at - F.col("below"), F.lit(0)), F.col("g"))
    parts = parts.withColumns({"k": end - start, "h": took(end) - took(start)})
    return parts.groupBy("bin").agg(F.min(score).alias("low"), F.max(score).alias("high"), F.sum("k").alias("n"), (F.sum("h") / F.sum("k")).alias("p"))


def area_under_curve(df: DataFrame, score: str, good: str) -> DataFrame:
    """One row: n, auc: chance that a good row scores above a bad one, ties half. Null with one kind only."""
    rows = df.where(F.col(score).isNotNull())
    ranks = cumulative(rows, score).select(score, average_rank(F.col("below"), F.col("n")).alias("r"))
    per = rows.groupBy(score).agg(F.sum(good).alias("pos"), F.count("*").alias("c")).join(ranks, score)
    s = per.agg(F.sum(F.col("pos") * F.col("r")).alias("s"), F.sum("pos").alias("p"), F.sum("c").alias("n"))
    return s.select("n", F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def drift(df: DataFrame, value: str, is_new: str) -> DataFrame:
    """One row: n_old, n_new, ks: largest distance of the two samples' cumulative shares."""
    cum = cumulative(df, value).select(value, "below", "n")
    total = df.where(F.col(value).isNotNull()).agg(F.sum(is_new).alias("n_new"), F.sum(1 - F.col(is_new)).alias("n_old"))
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum(is_new).alias("x"))
    seen = cumulative_sum(counts, value, "x")
    both = cum.join(seen, value).crossJoin(total)
    up_to_new = F.col("x_up_to") / F.col("n_new")
    up_to_old = (F.col("below") + F.col("n") - F.col("x_up_to")) / F.col("n_old")
    return both.groupBy("n_old", "n_new").agg(F.max(F.abs(up_to_new - up_to_old)).alias("ks"))


def cumulative_sum(counts: DataFrame, value: str, x: str) -> DataFrame:
    """(value, x_up_to): running sum of x over distinct values, in two levels as in ``cumulative``."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = counts.repartitionByRange(parts, value).withColumn("_p", F.spark_partition_id())
    ordered = keep(ordered)
    inside = Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sums = ordered.groupBy("_p").agg(F.sum(x).alias("_n"))
    offsets = sums.select("_p", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return ordered.withColumn("_s", F.sum(x).over(inside)).join(F.broadcast(offsets), "_p").select(value, (F.col("_s") + F.col("_o")).alias("x_up_to"))


def entropy_weights(df: DataFrame, columns: list[str]) -> DataFrame:
    """(indicator, weight): columns whose positive values are spread unevenly weigh more."""
    logs = [F.sum(F.when(F.col(c) > 0, F.col(c) * F.ln(c)).otherwise(0.0)) for c in columns]
    row = df.where(" AND ".join(f"{c} IS NOT NULL" for c in columns)).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in columns], *[x.alias(f"l_{c}") for c, x in zip(columns, logs)])
    # -sum p ln p with p = v / s equals ln s - (sum v ln v) / s.
    gap = {c: 1 - (F.ln(f"s_{c}") - F.col(f"l_{c}") / F.col(f"s_{c}")) / F.ln("n") for c in columns}
    total = sum(gap.values(), F.lit(0.0))
    pairs = F.array(*[F.struct(F.lit(c).alias("indicator"), (g / total).alias("weight")) for c, g in gap.items()])
    return row.select(F.inline(pairs))


def critic_weights(df: DataFrame, columns: list[str]) -> DataFrame:
    """(indicator, weight): the standard deviation of a scaled column times its lack of correlation with the others."""
    lo_hi = df.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in columns]).first()
    scaled = df.select(*[((F.col(c) - float(lo_hi[c][0] or 0.0)) / (float((lo_hi[c][1] or 0) - (lo_hi[c][0] or 0)) or 1.0)).alias(c) for c in columns])
    row = scaled.agg(*[F.stddev_samp(c).alias(f"d_{c}") for c in columns], *[F.coalesce(F.corr(a, b), F.lit(0.0)).alias(f"r_{a}_{b}") for a, b in combinations(columns, 2)])
    r = lambda a, b: F.col(f"r_{a}_{b}" if columns.index(a) < columns.index(b) else f"r_{b}_{a}")
    info = {c: F.col(f"d_{c}") * sum((1 - r(c, o) for o in columns if o != c), F.lit(0.0)) for c in columns}
    total = sum(info.values(), F.lit(0.0))
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("indicator"), F.try_divide(x, total).alias("weight")) for c, x in info.items()])))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of all pairs of columns, in one aggregate."""
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in combinations(columns, 2)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in combinations(columns, 2)])))


def band_counts(df: DataFrame, value: Column, edges: list[float], labels: list[str]) -> DataFrame:
    """(band, n, pct): every band, also empty ones; percentages of all rows."""
    counted = df.select(bands(value, edges, labels).alias("band")).groupBy("band").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    every = df.sparkSession.createDataFrame([(x,) for x in labels], "band string")
    return every.join(counted, "band", "left").crossJoin(F.broadcast(total)).select("band", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(100.0 * F.try_divide("n", "total"), F.lit(0.0)).alias("pct"))


def effect_table(df: DataFrame, group: str, value: str, is_after: Column, threshold: float) -> DataFrame:
    """(group, median and quartile range before and after, share below the threshold before and after, change of the median)."""
    rows = df.where(is_after.isNotNull()).select(group, is_after.alias("_after"), F.col(value).alias("_v"))
    q = quantiles(rows, "_v", [group, "_after"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    side = lambda after: [F.max(F.when(F.col("_after") == after, F.struct("q1", "q2", "q3"))).alias("a" if after else "b")]
    below = rows.groupBy(group).agg(*[(100.0 * F.avg(F.when(F.col("_after") == after, (F.col("_v") < threshold).cast("double")))).alias(n) for after, n in ((False, "below_before"), (True, "below_after"))])
    out = q.groupBy(group).agg(*side(False), *side(True)).join(below, group, "right")
    return out.select(
        group, F.col("b.q2").alias("median_before"), F.col("a.q2").alias("median_after"), (F.col("b.q3") - F.col("b.q1")).alias("iqr_before"), (F.col("a.q3") - F.col("a.q1")).alias("iqr_after"),
        (F.col("a.q2") - F.col("b.q2")).alias("change"), "below_before", "below_after",
    )


def tail(df: DataFrame, group: str, value: str, share: float = 0.05) -> DataFrame:
    """(group, cut, n, mean): rows of each group at or below its quantile, which is exact and interpolated. Cuts are one small row per group."""
    cut = quantiles(df, value, [group], {"cut": share}).select(group, "cut")
    return df.join(cut, group).where(F.col(value) <= F.col("cut")).groupBy(group, "cut").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, missing, mean, std, min, q1, q2, q3, max) of numeric columns; std is the sample's, null for one value."""
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])))
    moments = each.groupBy("column").agg(
        F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    q = quantiles(each, "v", ["column"], {"q1": 0.25, "q2": 0.5, "q3": 0.75}).drop("n")
    return moments.join(q, "column", "left").select("column", "n", "missing", "mean", "std", "min", "q1", "q2", "q3", "max")


def categories(df: DataFrame, columns: list[str], most: int = 20) -> DataFrame:
    """(column, n_distinct, value, n) of columns with at most ``most`` values, one row per value; of others one row with null value. Nulls are no value."""
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))).where("value IS NOT NULL")
    counts = each.groupBy("column", "value").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("column").agg(F.count("*").alias("n_distinct"), F.sum("n").alias("_all"))  # one row per column
    small = counts.join(F.broadcast(sizes.where(F.col("n_distinct") <= most)), "column").select("column", "n_distinct", "value", "n")
    return small.unionByName(sizes.where(F.col("n_distinct") > most).select("column", "n_distinct", F.lit(None).cast("string").alias("value"), F.col("_all").alias("n")))


def flag_means(df: DataFrame, flags: list[str], value: str) -> DataFrame:
    """(flag, n, pct, mean_with, mean_without): the share of rows that have a flag, and the mean of a value with and without it. Null flags are left out."""
    each = df.select(F.col(value).cast("double").alias("v"), F.inline(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).cast("boolean").alias("on")) for c in flags]))).where("on IS NOT NULL")
    return each.groupBy("flag").agg(
        F.count("*").alias("n"), (100.0 * F.avg(F.col("on").cast("double"))).alias("pct"), F.avg(F.when(F.col("on"), F.col("v"))).alias("mean_with"), F.avg(F.when(~F.col("on"), F.col("v"))).alias("mean_without")
    )


def paired_win_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, win_share: how often a pair's first value is the larger, a tie counting half. Pairs with a null are left out."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rows.agg(F.count("*").alias("n"), F.avg(F.when(F.col(a) > F.col(b), 1.0).when(F.col(a) == F.col(b), 0.5).otherwise(0.0)).alias("win_share"))


def wasserstein(df: DataFrame, value: str, is_new: str) -> DataFrame:
    """One row: the area between the two samples' cumulative shares. Values are counted up in two levels and joined to the next greater one."""
    rows = df.where(F.col(value).isNotNull())
    counts = rows.groupBy(value).agg(F.sum(F.col(is_new).cast("long")).alias("x"), F.count("*").alias("c"))
    up = cumulative_sum(counts, value, "x").join(cumulative_sum(counts, value, "c").withColumnRenamed("x_up_to", "c_up_to"), value)
    total = rows.agg(F.sum(F.col(is_new).cast("long")).alias("n_new"), F.count("*").alias("n"))
    # The area is the sum over values v of v times how much the distance changes there, in two runs: after the value and before it.
    gap = lambda x, c: F.abs(x / F.col("n_new") - (c - x) / (F.col("n") - F.col("n_new")))
    here = up.join(counts, value).crossJoin(F.broadcast(total))
    after, before = gap(F.col("x_up_to"), F.col("c_up_to")), gap(F.col("x_up_to") - F.col("x"), F.col("c_up_to") - F.col("c"))
    return here.agg(F.sum(F.col(value).cast("double") * (before - after)).alias("distance"))


def principal_weights(df: DataFrame, columns: list[str]) -> DataFrame:
    """(indicator, weight): squared loadings of the first principal component of the standardised columns; from one aggregate of correlations."""
    import numpy as np

    pairs = {(r["a"], r["b"]): r["corr"] for r in correlations(df, columns).collect()}  # one row per pair of columns
    m = np.eye(len(columns))
    for (a, b), r in pairs.items():
        m[columns.index(a), columns.index(b)] = m[columns.index(b), columns.index(a)] = r or 0.0
    loads = np.linalg.eigh(m)[1][:, -1] ** 2
    return df.sparkSession.createDataFrame([(c, float(x)) for c, x in zip(columns, loads)], "indicator string, weight double")


def redundant_pairs(df: DataFrame, columns: list[str], cut: float = 0.9) -> DataFrame:
    """(a, b, corr): pairs of columns whose correlation is at least ``cut`` either way, and (a, null, null) for a column that does not vary."""
    row = df.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns]).first()
    flat = [c for c in columns if row[c]]
    varied = [c for c in columns if not row[c]]
    alone = df.sparkSession.createDataFrame([(c, None, None) for c in flat], "a string, b string, corr double")
    return correlations(df, varied).where(F.abs("corr") >= cut).unionByName(alone) if len(varied) > 1 else alone


def problem_raters(votes: DataFrame, items: list[str], rater: str, vote: str, least_share: float = 0.6) -> DataFrame:
    """(rater, n, agreement, problem): how often a rater gives the item's majority grade, among items with at least two votes."""
    grades = panel_grades(votes, items, vote).where("n_votes >= 2").select(*items, "grade")
    per = votes.where(F.col(vote).isNotNull()).join(grades, items).groupBy(rater).agg(F.count("*").alias("n"), F.avg((F.col(vote) == F.col("grade")).cast("double")).alias("agreement"))
    return per.select(rater, "n", "agreement", (F.col("agreement") < least_share).alias("problem"))
