"""Queries on summaries, composite scores and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import learning, providers, scoring, summaries
from granary.sources.tables import table

_FIELDS = {"title": (4, 14), "subtitle": (6, 24), "description": (40, 200)}
_WEIGHTS = {"length": 0.3, "cleanness": 0.3, "grounding": 0.4}
_FIELD_WEIGHTS = {"title": 0.3, "subtitle": 0.2, "description": 0.5}


def summary_scores(spark, sf_dir):
    rows = summaries.summary_scores(table(spark, sf_dir, "knowledge_objects"), "rec_no", "ko_content_flat", "ko_content_flat_summarised")
    whole = ("n_source", "n_summary")
    return rows.select("rec_no", *[F.col(m).cast("long").alias(m) for m in whole], *[F.round(m, 5).alias(m) for m in summaries.MEASURES if m not in whole])


def field_parts(spark, sf_dir):
    rows = scoring.field_parts(table(spark, sf_dir, "knowledge_objects"), "rec_no", _FIELDS, "ko_content_flat")
    return rows.select("rec_no", "variant", "field", *[F.round(c, 6).alias(c) for c in _WEIGHTS])


def _variant_scores(spark, sf_dir):
    parts = scoring.field_parts(table(spark, sf_dir, "knowledge_objects"), "rec_no", _FIELDS, "ko_content_flat")
    values = parts.unpivot(["rec_no", "variant", "field"], list(_WEIGHTS), "part", "value")
    fields = scoring.combine(values, ["rec_no", "variant", "field"], "part", "value", _WEIGHTS)
    fields = scoring.with_required(fields, ["title", "description"], "field", F.col("n_parts") == 0)
    total = scoring.combine(fields, ["rec_no", "variant"], "field", "score", _FIELD_WEIGHTS).withColumnRenamed("n_parts", "n_fields")
    accuracy = parts.groupBy("rec_no", "variant").agg(F.avg("grounding").alias("accuracy"))
    return total.join(accuracy, ["rec_no", "variant"])


def variant_scores(spark, sf_dir):
    return _variant_scores(spark, sf_dir).select("rec_no", "variant", "n_fields", F.round("score", 6).alias("score"), F.round("accuracy", 6).alias("accuracy"))


def recommended_variant(spark, sf_dir):
    rounded = _variant_scores(spark, sf_dir).withColumn("score", F.round("score", 6)).withColumn("accuracy", F.round("accuracy", 6))
    picked = scoring.recommend(rounded, ["rec_no"], "variant", "score", "accuracy", 0.05)
    return picked.select("rec_no", "pick", F.round("gain", 6).alias("gain"))


def gate_scores(spark, sf_dir):
    """Out-of-fold decisions of a gate that tells one class of vectors from the others."""
    rows = table(spark, sf_dir, "embeddings").withColumn("on_topic", (F.col("label") == 0).cast("int"))
    return learning.gate_report(learning.gate_probabilities(rows, "vec_id", "embedding", "on_topic"))


def embedded_titles(spark, sf_dir):
    """A vector per different title from the stand-in embedder."""
    return providers.ask(table(spark, sf_dir, "knowledge_objects"), "title", providers.HashEmbedder())


QUERIES = {f.__name__: f for f in (summary_scores, field_parts, variant_scores, recommended_variant, gate_scores, embedded_titles)}

_STOPS = ", ".join(f"'{w}'" for w in summaries.STOP_WORDS)
_W = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"


def _grams(name: str, side: str, n: int) -> str:
    return f"{name} AS (SELECT rec_no, array_to_string({side}[i:i + {n - 1}], ' ') AS g, count(*) AS c FROM w, unnest(range(1, greatest(len({side}) - {n - 2}, 1))) AS t(i) WHERE len({side}) >= {n} GROUP BY ALL)"


def _shared(name: str, a: str, b: str) -> str:
    return f"{name} AS (SELECT rec_no, sum(least(x.c, y.c)) AS s FROM {a} x JOIN {b} y USING (rec_no, g) GROUP BY rec_no)"


_FIT = "CASE WHEN n_source < 150 THEN 0.3 WHEN n_source < 1000 THEN 0.1 ELSE 0.02 END::DOUBLE AS lo, CASE WHEN n_source < 150 THEN 0.9 WHEN n_source < 1000 THEN 0.5 ELSE 0.25 END::DOUBLE AS hi"
_PART = " UNION ALL ".join(
    f"SELECT rec_no, '{v}' AS variant, '{f}' AS field, {c} AS value, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi, list_distinct({_W.format('ko_content_flat')}) AS ref FROM knowledge_objects" for f, (lo, hi) in _FIELDS.items() for v, c in (("original", f), ("improved", f"{f}_llm"))
)
_PARTS = rf"""WITH r AS ({_PART}), t AS (SELECT *, {_W.format('value')} AS w, list_filter(string_split(trim(regexp_replace(replace(coalesce(value, ''), chr(173), ''), '\s+', ' ', 'g'), ' '), ' '), lambda x: x <> '') AS ts FROM r),
 l AS (SELECT *, list_distinct(list_filter(w, lambda x: length(x) > 3)) AS long FROM t),
 p AS (SELECT rec_no, variant, field, CASE WHEN len(w) > 0 THEN CASE WHEN len(w) < lo THEN len(w) / lo WHEN len(w) <= hi THEN 1.0 ELSE greatest(0, (2 * hi - len(w)) / hi) END END AS length,
  CASE WHEN len(w) > 0 THEN 1 - len(list_filter(ts, lambda x: regexp_matches(x, '<[^>]+>|&[a-z]+;|https?://|^[^\p{{L}}\p{{N}}]{{2,}}$'))) / len(ts) END AS cleanness,
  CASE WHEN len(w) > 0 AND len(ref) > 0 THEN len(list_intersect(long, ref)) / nullif(len(long), 0) END AS grounding FROM l)"""
_mean = lambda ws: "(" + " + ".join(f"coalesce({c} * {w}::DOUBLE, 0)" for c, w in ws.items()) + ") / nullif(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w}::DOUBLE END" for c, w in ws.items()) + ", 0)"
_VARIANTS = (
    _PARTS + f""", f AS (SELECT *, CASE WHEN length IS NULL AND cleanness IS NULL AND grounding IS NULL THEN CASE WHEN field IN ('title', 'description') THEN 0.0 END ELSE {_mean(_WEIGHTS)} END AS s FROM p),
 g AS (SELECT rec_no, variant, count(s) AS n_fields, max(s) FILTER (field = 'title') AS title, max(s) FILTER (field = 'subtitle') AS subtitle, max(s) FILTER (field = 'description') AS description, avg(grounding) AS a FROM f GROUP BY ALL),
 v AS (SELECT rec_no, variant, n_fields, round({_mean(_FIELD_WEIGHTS)}, 6) AS score, round(a, 6) AS accuracy FROM g)"""
)

ORACLES = {
    "summary_scores": f"""WITH w AS (SELECT rec_no, coalesce(ko_content_flat, '') AS src, ko_content_flat_summarised AS sm, {_W.format('ko_content_flat')} AS a, {_W.format('ko_content_flat_summarised')} AS b FROM knowledge_objects WHERE ko_content_flat_summarised IS NOT NULL),
 {_grams('a1', 'a', 1)}, {_grams('b1', 'b', 1)}, {_grams('a2', 'a', 2)}, {_grams('b2', 'b', 2)}, {_grams('b3', 'b', 3)}, {_shared('s1', 'a1', 'b1')}, {_shared('s2', 'a2', 'b2')},
 r3 AS (SELECT rec_no, sum(c - 1) / sum(c) AS rep FROM b3 GROUP BY rec_no),
 o AS (SELECT rec_no, a[i] AS t, count(*) AS c, min(i) AS f FROM w, unnest(range(1, len(a) + 1)) AS u(i) WHERE length(a[i]) > 2 AND a[i] NOT IN ({_STOPS}) GROUP BY ALL), k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY rec_no ORDER BY c DESC, f) <= 25),
 cv AS (SELECT k.rec_no, avg(CASE WHEN list_contains(b, t) THEN 1.0 ELSE 0 END) AS cov FROM k JOIN w USING (rec_no) GROUP BY k.rec_no),
 nu AS (SELECT rec_no, avg(CASE WHEN contains(src, x) THEN 0.0 ELSE 1 END) AS fo FROM (SELECT rec_no, src, unnest(list_distinct(regexp_extract_all(sm, '[0-9]+(?:[.,][0-9]+)*'))) AS x FROM w) GROUP BY rec_no),
 m AS (SELECT w.rec_no, len(a) AS n_source, len(b) AS n_summary, coalesce(s1.s, 0) AS x1, coalesce(s2.s, 0) AS x2, coalesce(cov, 0) AS cov, coalesce(rep, 0) AS rep, coalesce(fo, 0) AS fo, coalesce(len(b) / nullif(len(a), 0), 0) AS cp, {_FIT.replace('n_source', 'len(a)')} FROM w LEFT JOIN s1 USING (rec_no) LEFT JOIN s2 USING (rec_no) LEFT JOIN cv USING (rec_no) LEFT JOIN r3 USING (rec_no) LEFT JOIN nu USING (rec_no)),
 z AS (SELECT *, x1 / greatest(n_source, 1) AS r1, x1 / greatest(n_summary, 1) AS p1, x2 / greatest(n_source - 1, 1) AS r2, x2 / greatest(n_summary - 1, 1) AS p2, CASE WHEN cp < lo THEN cp / lo WHEN cp <= hi THEN 1.0 ELSE greatest(0, 1 - (cp - hi) / hi) END AS fit FROM m)
 SELECT rec_no, n_source, n_summary, round(cp, 5) AS compression, round(r1, 5) AS rouge1_recall, round(p1, 5) AS rouge1_precision, round(coalesce(2 * r1 * p1 / nullif(r1 + p1, 0), 0), 5) AS rouge1_f1, round(r2, 5) AS rouge2_recall, round(p2, 5) AS rouge2_precision, round(coalesce(2 * r2 * p2 / nullif(r2 + p2, 0), 0), 5) AS rouge2_f1,
 round(coalesce(2 * r1 * p1 / nullif(r1 + p1, 0), 0), 5) AS token_f1, round(cov, 5) AS coverage, round(rep, 5) AS repetition, round(fit, 5) AS length_score, round(fo, 5) AS foreign_numbers, CASE WHEN n_summary > 0 THEN round(0.45::DOUBLE * cov + 0.25::DOUBLE * fit + 0.20::DOUBLE * (1 - rep) + 0.10::DOUBLE * (1 - fo), 5) ELSE 0.0 END AS score FROM z""",
    "field_parts": _PARTS + " SELECT rec_no, variant, field, round(length, 6) AS length, round(cleanness, 6) AS cleanness, round(grounding, 6) AS grounding FROM p",
    "variant_scores": _VARIANTS + " SELECT * FROM v",
    "recommended_variant": _VARIANTS + """, tt AS (SELECT *, max(accuracy) OVER (PARTITION BY rec_no) AS top FROM v), q AS (SELECT * FROM tt WHERE score IS NOT NULL AND coalesce(accuracy, 0) >= coalesce(top, 0) - 0.05::DOUBLE), o AS (SELECT rec_no, list(variant ORDER BY score DESC, variant) AS vs, list(score ORDER BY score DESC, variant) AS ss FROM q GROUP BY rec_no)
 SELECT rec_no, vs[1] AS pick, round(ss[1] - ss[2], 6) AS gain FROM o""",
}
