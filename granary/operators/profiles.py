"""Profiles learnt from a table: expected fields, usual ranges, places in a reference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.audit import long_values
from granary.operators.ranks import at_index, cumulative, quantiles


def expected_fields(df: DataFrame, key: str, fields: list[str], expected_at: float = 0.95) -> DataFrame:
    """(field, coverage, expected): the share of rows with a value, and whether that makes the field expected."""
    total = df.agg(F.count("*").alias("rows"))
    has = long_values(df, key, fields).groupBy("field", key).agg(F.count("*").alias("k")).groupBy("field").agg(F.count("*").alias("covered"))
    every = df.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    share = F.coalesce(F.try_divide("covered", "rows"), F.lit(0.0))
    return every.join(has, "field", "left").crossJoin(F.broadcast(total)).select("field", share.alias("coverage"), (share >= expected_at).alias("expected"))


def missing_fields(df: DataFrame, key: str, expected: list[str]) -> DataFrame:
    """(key, missing): expected fields that a row has no value for; arrays count when an item is not blank."""
    blank = [F.when(~_filled(F.col(f), df.schema[f].dataType.simpleString()), F.lit(f)) for f in expected]
    return df.select(key, F.array_compact(F.array(*blank)).alias("missing"))


def _filled(c: Column, kind: str) -> Column:
    solid = lambda x: F.regexp_like(x.cast("string"), F.lit(r"[^\s\p{Z}]"))
    test = F.exists(c, solid) if kind.startswith("array<string") else F.size(c) > 0 if kind.startswith(("array", "map")) else solid(c)
    return F.coalesce(test, F.lit(False))


def metric_ranges(df: DataFrame, metrics: list[str], low: float = 0.01, high: float = 0.99, least: int = 20) -> DataFrame:
    """(metric, n, low, middle, high) of metrics that vary and have at least ``least`` values."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))).where("v IS NOT NULL")
    spread = long.groupBy("metric").agg(F.min("v").alias("_a"), F.max("v").alias("_z"))
    q = quantiles(long, "v", ["metric"], {"low": low, "middle": 0.5, "high": high}).join(spread, "metric")
    return q.where((F.col("n") >= least) & (F.col("_a") < F.col("_z"))).select("metric", "n", "low", "middle", "high")


def outside_ranges(df: DataFrame, key: str, metrics: list[str], ranges: DataFrame, most: int = 8) -> DataFrame:
    """(key, unusual): a row's metrics outside their ranges, the farthest first by distance over the range's width, at most ``most``."""
    bounds = {r["metric"]: (r["low"], r["high"]) for r in ranges.collect()}  # one row per metric
    marks = []
    for m in metrics:
        if m in bounds:
            lo, hi = bounds[m]
            v = F.col(m).cast("double")
            far = F.greatest(F.lit(lo) - v, v - F.lit(hi)) / F.lit((hi - lo) or 1.0)
            marks.append(F.when(far > 0, F.struct((-far).alias("d"), F.lit(m).alias("metric"))))
    found = F.slice(F.array_sort(F.array_compact(F.array(*marks))), 1, most) if marks else F.array()
    return df.select(key, F.transform(found, lambda x: x["metric"]).alias("unusual") if marks else F.array().cast("array<string>").alias("unusual"))


def group_reference(df: DataFrame, group: str, value: str, least: int = 30) -> DataFrame:
    """(group, n, p5, p10, p95): quantiles of groups with at least ``least`` rows; smaller groups get those of the whole table."""
    shares = {"p5": 0.05, "p10": 0.1, "p95": 0.95}
    own = quantiles(df, value, [group], shares)
    whole = quantiles(df, value, [], {f"_{k}": v for k, v in shares.items()}).drop("n")  # one row
    used = own.crossJoin(F.broadcast(whole))
    return used.select(group, "n", *[F.when(F.col("n") >= least, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in shares])


def stale_before(df: DataFrame, year: str, share: float = 0.05) -> DataFrame:
    """One row: the year at the place int(n * share) of the sorted years."""
    cum = cumulative(df, year)
    return at_index(cum, year, [], F.floor(F.col("total") * share), "stale_before")


def place_in_reference(df: DataFrame, value: str, reference: DataFrame, ref_value: str) -> DataFrame:
    """The rows with ``place`` from 0 to 1 among the reference values, ties in the middle; null values have none.

    Values and reference are ordered together in one cumulative count, so neither is gathered.
    """
    both = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.lit(0).alias("w")).distinct().unionByName(reference.where(F.col(ref_value).isNotNull()).select(F.col(ref_value).alias("v"), F.lit(1).alias("w")))
    cum = cumulative(both, "v", weight=F.col("w")).select("v", F.when(F.col("total") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("below") + (F.col("n") - 1) / 2) / (F.col("total") - 1)))).alias("place"))
    return df.join(cum.withColumnRenamed("v", value), value, "left")


def perturbed(df: DataFrame, key: str, field: str) -> DataFrame:
    """(key, defect, value): one row per deliberate defect of a field, for tests that a measure must fall."""
    c = F.col(field)
    words = F.split(c, " ")
    defects = {
        "markup": F.concat(F.lit("<div><span>"), c, F.lit("</span></div>")), "cut": F.array_join(F.slice(words, 1, F.greatest(F.lit(1), F.floor(F.size(words) / 6).cast("int"))), " "), "doubled": F.concat_ws(" ", *[c] * 4),
        "symbols": F.concat(c, F.lit(" ## || == ~~ ## || ==")), "link": F.concat(c, F.lit(" https://example.org/x https://example.org/y")), "foreign": F.regexp_replace(c, r"[aeiou]", "x"), "empty": F.lit(""),
    }
    each = F.array(*[F.struct(F.lit(n).alias("defect"), v.alias("value")) for n, v in defects.items()])
    return df.where(F.regexp_like(field, F.lit(r"\S"))).select(key, F.inline(each))


def all_of(tests: list[Column]) -> Column:
    """Three-valued conjunction in which an unknown test is skipped; null where all are unknown."""
    known = reduce(lambda a, t: F.coalesce(a & t, a, t), tests)
    return known
