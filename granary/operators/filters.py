"""Chains of filters with an account of what each took out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T

KEPT = "kept"


def first_failing(tests: dict[str, Column]) -> Column:
    """Name of the first test that a row fails, in the order given, or ``kept``; a test that is null fails."""
    steps = [(name, ~F.coalesce(test, F.lit(False))) for name, test in tests.items()]
    return reduce(lambda acc, s: acc.when(s[1], s[0]), steps[1:], F.when(steps[0][1], steps[0][0])).otherwise(KEPT) if steps else F.lit(KEPT)


def funnel(df: DataFrame, tests: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all tests, (step, n) for each step), both from one reading of each row."""
    marked = df.withColumn("_step", first_failing(tests))
    return marked.where(F.col("_step") == KEPT).drop("_step"), marked.groupBy(F.col("_step").alias("step")).agg(F.count("*").alias("n"))


def has_any(values: Column, wanted: list[str]) -> Column:
    """Whether an array has one of the wanted values, case and outer blanks aside."""
    return F.coalesce(F.arrays_overlap(F.transform(values, lambda x: F.lower(F.trim(x))), F.array(*[F.lit(w.lower()) for w in wanted])), F.lit(False))


# What page controls and legal footers leave behind.
PAGE_MARKERS = ("impressum", "datenschutz", "cookies", "terms", "richtlinien", "youtube", "google llc", "sign in")


def extraction_failed(text: Column, least_chars: int = 80, least_lines: int = 20, short_line: int = 18, most_short: float = 0.6) -> Column:
    """Short or null, with two or more different page markers, or of many lines that are mostly short."""
    t = F.coalesce(text, F.lit(""))
    hits = sum((F.contains(F.lower(t), F.lit(m)).cast("int") for m in PAGE_MARKERS), F.lit(0))
    lines = F.transform(T.lines(t), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    short = F.size(F.filter(lines, lambda x: F.length(x) <= short_line))
    return (F.length(t) < least_chars) | (hits >= 2) | ((F.size(lines) >= least_lines) & (short > most_short * F.size(lines)))
