"""Summaries held against their source: overlap, coverage, length, repetition, facts.

A pair is one row, and its n-gram counts live only while it is read, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.arrow import map_columns
from granary.functions.text import STOP_WORDS

_words = re.compile(r"\w+").findall
_numbers = re.compile(r"[0-9]+(?:[.,][0-9]+)*").findall
_STOPS = frozenset(STOP_WORDS)

MEASURES = (
    "n_source", "n_summary", "compression", "rouge1_recall", "rouge1_precision", "rouge1_f1", "rouge2_recall", "rouge2_precision", "rouge2_f1", "token_f1", "coverage", "repetition", "length_score", "foreign_numbers", "score",
)


def overlap(source: list[str], summary: list[str], n: int) -> tuple[float, float, float]:
    """(recall, precision, F1) of clipped n-grams; 0 where a side has none."""
    a, b = (Counter(zip(*[t[i:] for i in range(n)])) for t in (source, summary))
    shared = sum((a & b).values())
    recall, precision = shared / (sum(a.values()) or 1), shared / (sum(b.values()) or 1)
    return recall, precision, 2 * recall * precision / (recall + precision) if shared else 0.0


def top_words(tokens: list[str], n: int) -> list[str]:
    """The most frequent content words; of equals the one that came first."""
    return [w for w, _ in Counter(t for t in tokens if t not in _STOPS and len(t) > 2).most_common(n)]


def length_score(n_source: int, n_summary: int) -> float:
    """1 inside the band of lengths that suits the source, falling linearly outside."""
    low, high = (0.3, 0.9) if n_source < 150 else (0.1, 0.5) if n_source < 1000 else (0.02, 0.25)
    share = n_summary / n_source if n_source else 0.0
    return share / low if share < low else 1.0 if share <= high else max(0.0, 1 - (share - high) / high)


def measure(source: str, summary: str) -> list[float]:
    a, b = _words(source.lower()), _words(summary.lower())
    one, two = overlap(a, b, 1), overlap(a, b, 2)
    wanted = top_words(a, 25)
    coverage = sum(1 for w in wanted if w in set(b)) / len(wanted) if wanted else 0.0
    grams = Counter(zip(b, b[1:], b[2:]))
    total = sum(grams.values())
    repetition = sum(c - 1 for c in grams.values()) / total if total else 0.0
    numbers = set(_numbers(summary))
    foreign = sum(1 for x in numbers if x not in source) / len(numbers) if numbers else 0.0
    fit = length_score(len(a), len(b))
    score = 0.45 * coverage + 0.25 * fit + 0.20 * (1 - repetition) + 0.10 * (1 - foreign) if b else 0.0
    return [len(a), len(b), len(b) / len(a) if a else 0.0, *one, *two, one[2], coverage, repetition, fit, foreign, score]


def summary_scores(df: DataFrame, key: str, source: str, summary: str) -> DataFrame:
    """(key, measures) of each row that has a summary; a null or empty source gives zeros. Repeated rows repeat."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        return lambda keys, a, b: [keys, *zip(*[measure(x or "", y) for x, y in zip(a, b)])]

    rows = df.where(F.col(summary).isNotNull()).select(F.col(key).alias("k"), F.col(source).alias("a"), F.col(summary).alias("b"))
    return map_columns(rows, make, f"k {kind}, " + ", ".join(f"{m} double" for m in MEASURES)).withColumnRenamed("k", key)
