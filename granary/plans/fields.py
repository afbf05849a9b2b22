"""Queries on the sub-scores of descriptive fields and on what deliberate defects do to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import fields, statistics
from granary.sources.tables import table

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _ko(spark, sf_dir):
    return table(spark, sf_dir, "knowledge_objects")


def _r(df, places=6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def field_forms(spark, sf_dir):
    """Length, completeness and form of titles and subtitles, as given and as improved."""
    rows = fields.long_fields(_ko(spark, sf_dir), "rec_no")
    rows = fields.length_fit(fields.formatting(fields.completeness(rows))).where(F.col("field").isin("title", "subtitle"))
    return _r(rows.select(F.col("key").alias("rec_no"), "variant", "field", "length", "completeness", "formatting"))


def field_scores(spark, sf_dir):
    """All eight sub-scores of all fields."""
    return _r(fields.field_scores(_ko(spark, sf_dir), "rec_no", "ko_content_flat_summarised").withColumnRenamed("key", "rec_no"))


def field_self_test(spark, sf_dir):
    """How often each deliberate defect lowers the sub-score it aims at."""
    rows = fields.self_test(_ko(spark, sf_dir), "rec_no", "ko_content_flat_summarised")
    return rows.groupBy("defect", "sub", "outcome").agg(F.count("*").alias("n"))


def numeric_summary(spark, sf_dir):
    return _r(statistics.summary(table(spark, sf_dir, "lineitem"), _MEASURES), 4)


def category_summary(spark, sf_dir):
    return statistics.categories(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_partkey"])


def flag_means(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"returned": F.col("l_returnflag") == "R", "large": F.col("l_quantity") >= 40})
    return _r(statistics.flag_means(rows, ["returned", "large"], "l_extendedprice"), 4)


def paired_wins(spark, sf_dir):
    """How often the improved title is longer than the given one."""
    rows = _ko(spark, sf_dir).select(F.length("title_llm").alias("a"), F.length("title").alias("b"))
    return _r(statistics.paired_win_share(rows, "a", "b"))


def drift_distance(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("value", (F.col("ts") >= "2024-01-16").cast("long").alias("is_new"))
    return _r(statistics.wasserstein(rows, "value", "is_new"), 4)


def principal_weights(spark, sf_dir):
    return _r(statistics.principal_weights(table(spark, sf_dir, "lineitem"), _MEASURES), 4)


def redundant_measures(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"one": F.lit(1.0), "gross": F.col("l_extendedprice") * 2})
    return _r(statistics.redundant_pairs(rows, ["l_quantity", "l_extendedprice", "gross", "one"]), 4)


def rater_agreement(spark, sf_dir):
    return _r(statistics.problem_raters(table(spark, sf_dir, "reading_panel"), ["rec_no", "field_name"], "rater", "band"))


QUERIES = {
    f.__name__: f
    for f in (field_forms, field_scores, field_self_test, numeric_summary, category_summary, flag_means, paired_wins, drift_distance, principal_weights, redundant_measures, rater_agreement)
}

_line = lambda x: f"trim(regexp_replace(replace(coalesce({x}, ''), chr(173), ''), '\\s+', ' ', 'g'), ' ')"
_plain = lambda x: (
    "replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(" + x + r""", ''), '(?i)<li\b[^>]*>', chr(10) || '• ', 'g'), '(?i)<br\s*/?>|</(?:p|div|h[1-6]|li|tr|ul|ol)>', chr(10), 'g'), '<[^>]+>', '', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')"""
)
_words_of = lambda x: rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' ')"
_EXT = r"'\.(?:[A-Za-z][A-Za-z0-9]{2,3}|[0-9][A-Za-z][A-Za-z0-9]{1,2}|[0-9]{2}[A-Za-z][A-Za-z0-9]?|[0-9]{3}[A-Za-z])$'"
_one = "SELECT {0} AS c, {1} AS v"

ORACLES = {
    "field_forms": "WITH b AS ("
    + " UNION ALL ".join(
        f"SELECT rec_no, trim(coalesce(project_id, ''), ' ') AS project, coalesce(ko_object_name, '') AS file, '{v}' AS variant, '{f}' AS field, {f}{s} AS raw, {_line(f + s)} AS t, [lower({_line(o + s)}), lower({_line(_plain('description' + s))})] AS others FROM knowledge_objects"
        for v, s in (("original", ""), ("improved", "_llm"))
        for f, o in (("title", "subtitle"), ("subtitle", "title"))
    )
    + rf"""), s AS (SELECT variant, field, lower(t) AS low FROM b WHERE t <> '' AND project <> '' GROUP BY ALL HAVING count(DISTINCT project) > 1),
 c AS (SELECT b.*, s.low IS NOT NULL AS shared, {_words_of("regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.[A-Za-z0-9]{2,5}$', '')")} AS stem, len(regexp_extract_all(t, '\p{{Lu}}')) AS up, len(regexp_extract_all(t, '\p{{Ll}}')) AS lo FROM b LEFT JOIN s ON s.variant = b.variant AND s.field = b.field AND s.low = lower(t)),
 d AS (SELECT *, [NOT ((NOT contains(t, ' ') AND regexp_matches(t, '[_.]')) OR regexp_matches(t, {_EXT})), NOT list_contains(others, lower(t)), NOT shared] AS k,
  [coalesce(raw, '') = regexp_replace(coalesce(raw, ''), '^\s+|\s+$', '', 'g') AND NOT regexp_matches(coalesce(raw, ''), '  |\t'), NOT (up + lo >= 4 AND contains(t, ' ') AND up > 0.8 * (up + lo)), NOT contains(coalesce(raw, ''), chr(10)), NOT regexp_matches(t, '[,;:]$'), NOT (lo > 0 AND up = 0)] AS g FROM c),
 e AS (SELECT *, CASE WHEN field = 'title' THEN list_concat(k, list_concat([NOT regexp_matches(t, '{fields.INTERNAL}')], CASE WHEN stem <> '' THEN [{_words_of('t')} <> stem] ELSE [] END)) ELSE k END AS ks, length(replace(t, ' ', '')) AS n FROM d)
 SELECT rec_no, variant, field, CASE WHEN field = 'title' THEN round(CASE WHEN n <= 150 THEN 1.0 ELSE greatest(0, least(1, (300.0 - n) / 150)) END, 6) END AS length,
  round(CASE WHEN t = '' THEN 0.0 ELSE len(list_filter(ks, lambda x: x)) / len(ks) END, 6) AS completeness, CASE WHEN t <> '' THEN round(len(list_filter(g, lambda x: x)) / len(g), 6) END AS formatting FROM e""",
    "numeric_summary": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS q2, round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS max FROM lineitem"
        for c in _MEASURES
    ),
    "category_summary": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM lineitem) AS n_distinct, {c} AS value, count(*) AS n FROM lineitem GROUP BY {c}" for c in ("l_returnflag", "l_linestatus")
    )
    + " UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey), NULL, count(*) FROM lineitem",
    "flag_means": " UNION ALL ".join(
        f"SELECT '{n}' AS flag, count(*) AS n, round(100.0 * avg(({c})::INT), 4) AS pct, round(avg(l_extendedprice) FILTER ({c}), 4) AS mean_with, round(avg(l_extendedprice) FILTER (NOT ({c})), 4) AS mean_without FROM lineitem"
        for n, c in (("returned", "l_returnflag = 'R'"), ("large", "l_quantity >= 40"))
    ),
    "paired_wins": "SELECT count(*) AS n, round(avg(CASE WHEN a > b THEN 1.0 WHEN a = b THEN 0.5 ELSE 0.0 END), 6) AS win_share FROM (SELECT length(title_llm) AS a, length(title) AS b FROM knowledge_objects) WHERE a IS NOT NULL AND b IS NOT NULL",
    "drift_distance": """WITH e AS (SELECT value, (ts >= '2024-01-16')::BIGINT AS x FROM events WHERE value IS NOT NULL), t AS (SELECT sum(x) AS nn, count(*) - sum(x) AS no FROM e), c AS (SELECT value, sum(sum(x)) OVER (ORDER BY value) AS cx, sum(sum(1 - x)) OVER (ORDER BY value) AS cy, lead(value) OVER (ORDER BY value) - value AS w FROM e GROUP BY value)
 SELECT round(sum(abs(cx / nn - cy / no) * coalesce(w, 0)), 4) AS distance FROM c, t""",
    "redundant_measures": "SELECT 'l_extendedprice' AS a, 'gross' AS b, 1.0 AS corr UNION ALL SELECT 'l_quantity', x, r FROM (SELECT 'l_extendedprice' AS x, round(corr(l_quantity, l_extendedprice), 4) AS r FROM lineitem UNION ALL SELECT 'gross', round(corr(l_quantity, 2 * l_extendedprice), 4) FROM lineitem) WHERE abs(r) >= 0.9 UNION ALL SELECT 'one', NULL, NULL",
    "rater_agreement": """WITH c AS (SELECT rec_no, field_name, band, count(*) AS c FROM reading_panel WHERE band IS NOT NULL GROUP BY ALL), g AS (SELECT rec_no, field_name, arg_max(band, {'c': c, 'b': -band}) AS grade FROM c GROUP BY ALL HAVING sum(c) >= 2)
 SELECT rater, count(*) AS n, round(avg((band = grade)::INT), 6) AS agreement, avg((band = grade)::INT) < 0.6 AS problem FROM reading_panel JOIN g USING (rec_no, field_name) WHERE band IS NOT NULL GROUP BY rater""",
}
