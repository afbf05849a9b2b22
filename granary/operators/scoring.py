"""Composite scores that skip what cannot be judged, and the choice between variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import numeric
from granary.functions import text as T


def combine(parts: DataFrame, by: list[str], part: str, value: str, weights: dict[str, float]) -> DataFrame:
    """(by..., n_parts, score): weighted mean of a group's parts; null values drop out, a group of nulls has a null score."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col(part)), F.lit(0.0))
    known = F.when(F.col(value).isNotNull(), weight)
    return parts.groupBy(*by).agg(F.count(value).alias("n_parts"), F.try_divide(F.sum(F.col(value) * weight), F.sum(known)).alias("score"))


def with_required(scores: DataFrame, required: list[str], field: str, is_empty: Column) -> DataFrame:
    """Scores of fields where an empty required field is worth 0 and an empty optional one is not judged."""
    return scores.withColumn("score", F.when(is_empty, F.when(F.col(field).isin(required), 0.0)).otherwise(F.col("score")))


def recommend(variants: DataFrame, by: list[str], variant: str, score: str, accuracy: str, tolerance: float) -> DataFrame:
    """(by..., pick, gain): the variant with the higher score, unless its accuracy is lower by more than the tolerance; the first in order of equals.

    ``gain`` is the lead over the best of the others, null without others.
    """
    best = variants.groupBy(*by).agg(F.max(accuracy).alias("_top"))
    fair = variants.join(best, by).where(F.col(score).isNotNull() & (F.coalesce(F.col(accuracy), F.lit(0.0)) >= F.coalesce("_top", F.lit(0.0)) - tolerance))
    ordered = fair.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(variant).alias("v")))).alias("o"))  # a few variants per group
    return ordered.select(*by, F.get("o", F.lit(0))["v"].alias("pick"), (F.get("o", F.lit(1))["s"] - F.get("o", F.lit(0))["s"]).alias("gain"))


def field_parts(df: DataFrame, key: str, fields: dict[str, tuple[float, float]], reference: str) -> DataFrame:
    """(key, variant, field, length, cleanness, grounding): sub-scores of original and improved fields.

    ``fields`` maps a field to its band of words; ``length`` is how well it keeps to that, ``cleanness`` the share of tokens that are no debris, ``grounding`` the share of
    its words of over three letters that the reference text has. All null for an empty field.
    """
    each = [F.struct(F.lit(v).alias("variant"), F.lit(f).alias("field"), F.col(c).alias("value"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for f, (lo, hi) in fields.items() for v, c in (("original", f), ("improved", f"{f}_llm"))]
    rows = df.select(key, F.array_distinct(T.words(F.col(reference))).alias("_ref"), F.inline(F.array(*each)))
    words = T.words(F.col("value"))
    rows = rows.select("*", words.alias("_w"), F.filter(F.split(T.one_line(F.col("value")), " "), lambda x: x != "").alias("_t"))
    n = F.size("_w").cast("double")
    long = F.array_distinct(F.filter("_w", lambda w: F.length(w) > 3))
    band = F.when(n < F.col("lo"), n / F.col("lo")).when(n <= F.col("hi"), 1.0).otherwise(numeric.clamp((2 * F.col("hi") - n) / F.col("hi")))
    debris = F.size(F.filter("_t", lambda t: F.regexp_like(t, F.lit(r"<[^>]+>|&[a-z]+;|https?://|^[^\p{L}\p{N}]{2,}$"))))
    some = F.size("_w") > 0
    return rows.select(
        key, "variant", "field", F.when(some, band).alias("length"), F.when(some, 1 - debris / F.size("_t")).alias("cleanness"),
        F.when(some & (F.size("_ref") > 0), F.try_divide(F.size(F.array_intersect(long, "_ref")), F.size(long))).alias("grounding"),
    )
