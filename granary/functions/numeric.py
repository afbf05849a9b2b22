"""Bands, clamps and gains on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def inside_band(x: Column, low: float, high: float) -> Column:
    """1 inside the band, falling linearly to 0 at 0 and at twice the upper edge."""
    return F.when(x < low, x / low if low else F.lit(0.0)).when(x <= high, F.lit(1.0)).otherwise(clamp((2 * high - x) / high))


def at_most(x: Column, cap: float) -> Column:
    return F.when(x <= cap, F.lit(1.0)).otherwise(clamp((2 * cap - x) / cap))


def at_least(x: Column, floor: float) -> Column:
    return F.least(F.lit(1.0), x / floor)


def saturating(x: Column, middle: float) -> Column:
    return F.least(F.lit(1.0), F.log1p(x) / F.log1p(F.lit(middle)))


def rank_gain(rank: Column) -> Column:
    return 1 / F.log2(1 + rank)


def scaled(x: Column, low: float, high: float) -> Column:
    """Position between two anchors in 0..1; a missing value is in the middle."""
    return F.coalesce(clamp((x - low) / (high - low)), F.lit(0.5))


def cardinality_fitness(distinct: Column) -> Column:
    """How well a number of different values suits a facet."""
    return F.when(distinct < 2, 0.0).when(distinct <= 40, 1.0).otherwise(clamp((200 - distinct) / 160.0))


def weighted_mean(values: list[Column], weights: list[float]) -> Column:
    """Mean over the values that are not null; null where none is."""
    top = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in zip(values, weights)), F.lit(0.0))
    low = sum((F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in zip(values, weights)), F.lit(0.0))
    return F.try_divide(top, low)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; 0 and 0 without observations."""
    p = successes / F.nullif(n, F.lit(0))
    below = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / below
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / below
    return tuple(F.when(n > 0, clamp(x)).otherwise(0.0) for x in (middle - margin, middle + margin))


def bands(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the left-closed band that x falls in; null for null."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        out = F.when(x < edge, label).otherwise(out)
    return F.when(x.isNotNull(), out)
