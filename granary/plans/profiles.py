"""Queries on profiles that are learnt from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import languages
from granary.functions import text as T
from granary.operators import profiles, quality
from granary.plans.statistics import _LEN, _lengths
from granary.sources.tables import table
from granary.session import keep

_FIELDS = ["title", "subtitle", "description", "keywords", "languages", "license", "category", "creators", "topics", "project_id"]
_METRICS = ["n_words", "mean_word", "ttr"]


def _ko(spark, sf_dir):
    return table(spark, sf_dir, "knowledge_objects")


def expected_fields(spark, sf_dir):
    rows = profiles.expected_fields(_ko(spark, sf_dir), "rec_no", _FIELDS, 0.9)
    return rows.select("field", F.round("coverage", 6).alias("coverage"), "expected")


def missing_fields(spark, sf_dir):
    rows = profiles.missing_fields(_ko(spark, sf_dir), "rec_no", _FIELDS)
    return rows.select("rec_no", F.array_join(F.array_sort("missing"), ",").alias("missing"))


def metric_ranges(spark, sf_dir):
    rows = profiles.metric_ranges(_lengths(spark, sf_dir), _METRICS)
    return rows.select("metric", "n", *[F.round(c, 4).alias(c) for c in ("low", "middle", "high")])


def unusual_metrics(spark, sf_dir):
    rows = keep(_lengths(spark, sf_dir))
    found = profiles.outside_ranges(rows, "doc_id", _METRICS, profiles.metric_ranges(rows, _METRICS))
    return found.where("size(unusual) > 0").select("doc_id", F.array_join(F.array_sort("unusual"), ",").alias("unusual"))


def language_reference(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.coalesce(languages.language_code(F.col("lang")), F.lit("unknown")).alias("lang"), F.size(T.words(F.col("text"))).alias("n_words"))
    return profiles.group_reference(docs, "lang", "n_words").select("lang", "n", *[F.round(c, 4).alias(c) for c in ("p5", "p10", "p95")])


def stale_years(spark, sf_dir):
    return profiles.stale_before(_ko(spark, sf_dir).select(T.year_in(F.col("date_of_completion")).cast("long").alias("year")), "year")


def length_places(spark, sf_dir):
    """The place of every description's length among those of the summaries."""
    ko = keep(_ko(spark, sf_dir).select("rec_no", F.length("description").cast("long").alias("n"), F.length("ko_content_flat_summarised").cast("long").alias("r")))
    rows = profiles.place_in_reference(ko.select("rec_no", "n"), "n", ko, "r")
    return rows.select("rec_no", F.round("place", 6).alias("place"))


def declared_languages(spark, sf_dir):
    codes = languages.language_codes(F.col("languages"))
    return _ko(spark, sf_dir).select("rec_no", F.array_join(codes, ",").alias("codes"))


def extracted_text(spark, sf_dir):
    return _ko(spark, sf_dir).where("ko_content_flat IS NOT NULL").select("rec_no", T.extracted(F.col("ko_content_flat")).alias("clean"))


def selftest_defects(spark, sf_dir):
    """Deliberate defects in descriptions and how often the debris measure falls for each."""
    ko = _ko(spark, sf_dir)
    key = F.concat_ws(":", F.col("rec_no").cast("string"), "defect")
    bad = profiles.perturbed(ko, "rec_no", "description").withColumn("id", key)
    after = quality.noise_tokens(bad, "id", "value").select(F.split_part("id", F.lit(":"), F.lit(1)).cast("long").alias("rec_no"), F.split_part("id", F.lit(":"), F.lit(2)).alias("defect"), F.col("cleanness").alias("after"))
    before = quality.noise_tokens(ko, "rec_no", "description").select("rec_no", F.col("cleanness").alias("before"))
    both = after.join(before, "rec_no")
    return both.groupBy("defect").agg(F.count("*").alias("n"), F.sum((F.col("after") < F.col("before")).cast("long")).alias("fell"), F.sum(F.col("after").isNull().cast("long")).alias("not_judged"))


QUERIES = {f.__name__: f for f in (expected_fields, missing_fields, metric_ranges, unusual_metrics, language_reference, stale_years, length_places, declared_languages, extracted_text, selftest_defects)}

_HAS = {f: f"len(list_filter({f}, lambda x: regexp_matches(x, '[^\\s\\p{{Z}}]'))) > 0" if f in ("keywords", "languages", "creators", "topics") else f"regexp_matches({f}, '[^\\s\\p{{Z}}]')" for f in _FIELDS}
_NAMES = ", ".join(f"'{n}': '{c}'" for n, c in languages.LABEL_CODES.items())
_CODES = f"WITH m AS (SELECT MAP {{{_NAMES}}} AS m)"


def _code(x: str) -> str:
    return f"coalesce(m[lower(trim({x}, ' '))], m[regexp_extract(lower(trim({x}, ' ')), '^([a-z]{{2,3}})[-_][a-z0-9]{{2,4}}$', 1)])"


_QUANT = {m: f"quantile_cont({m}, [0.01, 0.5, 0.99])" for m in _METRICS}

ORACLES = {
    "expected_fields": " UNION ALL ".join(f"SELECT '{f}' AS field, round(avg(coalesce({h}, false)::INT), 6) AS coverage, avg(coalesce({h}, false)::INT) >= 0.9 AS expected FROM knowledge_objects" for f, h in _HAS.items()),
    "missing_fields": f"SELECT rec_no, array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN NOT coalesce({h}, false) THEN {f!r} END' for f, h in _HAS.items())}], lambda x: x IS NOT NULL)), ',') AS missing FROM knowledge_objects",
    "metric_ranges": _LEN + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) AS n, round({q}[1], 4) AS low, round({q}[2], 4) AS middle, round({q}[3], 4) AS high FROM d" for m, q in _QUANT.items()),
    "unusual_metrics": _LEN + ", q AS (SELECT " + ", ".join(f"{q} AS {m}" for m, q in _QUANT.items()) + " FROM d), u AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN d.{m} < q.{m}[1] OR d.{m} > q.{m}[3] THEN '{m}' END" for m in sorted(_METRICS)) + "], lambda x: x IS NOT NULL) AS u FROM d, q) SELECT doc_id, array_to_string(u, ',') AS unusual FROM u WHERE len(u) > 0",
    "language_reference": _CODES + rf""", d AS (SELECT coalesce({_code('lang')}, 'unknown') AS lang, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) AS n FROM documents, m), a AS (SELECT quantile_cont(n, [0.05, 0.1, 0.95]) AS q FROM d), g AS (SELECT lang, count(*) AS k, quantile_cont(n, [0.05, 0.1, 0.95]) AS o FROM d GROUP BY lang),
 u AS (SELECT lang, k, CASE WHEN k >= 30 THEN o ELSE q END AS q FROM g, a) SELECT lang, k AS n, round(q[1], 4) AS p5, round(q[2], 4) AS p10, round(q[3], 4) AS p95 FROM u""",
    "stale_years": r"WITH y AS (SELECT nullif(regexp_extract(date_of_completion, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1), '')::BIGINT AS y FROM knowledge_objects), s AS (SELECT list_sort(list(y) FILTER (y IS NOT NULL)) AS s FROM y) SELECT s[CAST(floor(len(s) * 0.05) AS BIGINT) + 1] AS stale_before FROM s",
    "length_places": """WITH r AS (SELECT length(ko_content_flat_summarised) AS r FROM knowledge_objects WHERE ko_content_flat_summarised IS NOT NULL), c AS (SELECT rec_no, n, count(r) FILTER (r < n) AS below, count(r) FILTER (r = n) AS ties FROM (SELECT rec_no, length(description) AS n FROM knowledge_objects), r GROUP BY ALL)
 SELECT rec_no, CASE WHEN n IS NULL THEN NULL ELSE round(greatest(0, least(1, (below + (ties - 1) / 2) / ((SELECT count(*) FROM r) - 1))), 6) END AS place FROM c""",
    "declared_languages": _CODES + f""" SELECT rec_no, array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(list_filter(coalesce(languages, []), lambda x: x IS NOT NULL), lambda x: regexp_split_to_array(x, '[,;/|+&]'))), lambda x: {_code('x')}), lambda c: c IS NOT NULL))), ',') AS codes FROM knowledge_objects, m""",
}
