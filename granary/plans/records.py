"""Queries on the records themselves: keys, files, links, vocabularies, duplicates, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import records as P
from granary.functions import text as T
from granary.operators import audit, sampling
from granary.sources.tables import table


def _ko(spark, sf_dir):
    return table(spark, sf_dir, "knowledge_objects")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def record_keys(spark, sf_dir):
    c = F.col
    return _ko(spark, sf_dir).select(
        "rec_no", P.record_key(c("_orig_id"), c("_id"), c("at_id")).alias("record"), P.safe_key(c("_orig_id"), c("at_id"), c("title"), c("ko_created_at")).alias("safe"),
        P.first_filled(c("project_id"), c("project_acronym"), c("project_name")).alias("project"), P.primary_language(c("languages")).alias("lang"), P.licence_norm(c("license")).alias("licence"),
    )


def file_kinds(spark, sf_dir):
    c = F.col
    ending = P.extension(c("ko_object_extension"), c("ko_object_name"), c("ko_content_url"))
    return _ko(spark, sf_dir).select("rec_no", ending.alias("ending"), P.file_kind(c("ko_object_mimetype"), ending).alias("kind"), P.host(c("ko_content_url")).alias("host"))


def project_links(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "projects")
    return rows.select("project_id", P.link(c("project_url")).alias("link"), P.host(c("project_url")).alias("host"), P.is_doi(c("project_doi")).alias("doi_ok"))


def completion_years(spark, sf_dir):
    years = T.year_in(F.col("date_of_completion"))
    return _ko(spark, sf_dir).groupBy(years.cast("long").alias("year")).agg(F.count("*").alias("n"))


def latest_records(spark, sf_dir):
    """One row per original id: the one loaded last."""
    rows = _ko(spark, sf_dir).where("_orig_id IS NOT NULL").select("_orig_id", "loaded_at", "rec_no", "title")
    return audit.latest(rows, "_orig_id", ["loaded_at", "rec_no"]).select("_orig_id", "rec_no", "title")


def exact_duplicates(spark, sf_dir):
    return audit.exact_duplicates(_docs(spark, sf_dir), "doc_id", "text")


def shared_titles(spark, sf_dir):
    rows = _ko(spark, sf_dir).withColumn("project", P.first_filled(F.col("project_id"), F.col("project_acronym"), F.col("project_name")))
    return audit.shared_values(rows, "title", "project")


_CONTROLLED = ["category", "subcategories", "topics", "themes", "intended_purposes"]


def vocabulary_use(spark, sf_dir):
    checked = audit.vocabulary_check(_ko(spark, sf_dir), "rec_no", _CONTROLLED, table(spark, sf_dir, "vocab_terms"))
    return checked.groupBy("field", "known").agg(F.count("*").alias("n"), F.countDistinct(F.lower(F.trim("value"))).alias("n_values"))


_AUDITED = ["title", "subtitle", "description", "keywords", "languages", "category", "topics", "themes", "creators", "license", "project_id", "ko_object_mimetype"]


def field_audit(spark, sf_dir):
    rows = audit.field_audit(_ko(spark, sf_dir), "rec_no", _AUDITED)
    return rows.select("field", "n_values", "distinct", *[F.round(c, 4).alias(c) for c in ("coverage", "entropy", "mean_length", "mean_reuse", "facet_fitness")])


def crosstabs(spark, sf_dir):
    c = F.col
    ending = P.extension(c("ko_object_extension"), c("ko_object_name"), c("ko_content_url"))
    rows = _ko(spark, sf_dir).select(
        F.coalesce(P.filled(c("ko_upload_source")), F.lit("missing")).alias("source"), F.coalesce(P.filled(c("ko_object_mimetype")), F.lit("missing")).alias("mime"), P.file_kind(c("ko_object_mimetype"), ending).alias("kind")
    )
    return audit.cross_tabs(rows, [("source", "mime"), ("source",), ("mime",), ("kind",), ("kind", "source"), ("kind", "mime"), ("kind", "source", "mime")])


def improved_fields(spark, sf_dir):
    """Original and improved variant of each field, side by side in length and shared words."""
    c = F.col
    pairs = [F.struct(F.lit(f).alias("field"), c(f).alias("a"), c(f"{f}_llm").alias("b")) for f in ("title", "subtitle", "description")]
    rows = _ko(spark, sf_dir).select("rec_no", F.inline(F.array(*pairs))).where("a IS NOT NULL AND b IS NOT NULL")
    rows = rows.select("rec_no", "field", F.length("a").cast("long").alias("chars"), F.length("b").cast("long").alias("chars_llm"), T.words(c("a")).alias("wa"), T.words(c("b")).alias("wb"))
    return rows.select("rec_no", "field", "chars", "chars_llm", F.round(T.jaccard(c("wa"), c("wb")), 6).alias("jaccard"), F.round(T.overlap_of_smaller(c("wa"), c("wb")), 6).alias("overlap"), F.round(T.coverage(c("wa"), c("wb")), 6).alias("coverage"))


def stratified_quota(spark, sf_dir):
    return sampling.quotas(_strata(spark, sf_dir), ["lang", "kind"], 300)


def _strata(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.coalesce(F.lower(F.trim("lang")), F.lit("unknown")).alias("lang"), F.coalesce("doc_kind", F.lit("unknown")).alias("kind"))


def stratified_sample(spark, sf_dir):
    return sampling.stratified(_strata(spark, sf_dir), ["lang", "kind"], "doc_id", 300).select("doc_id", "lang", "kind")


def per_language_sample(spark, sf_dir):
    return sampling.per_group(_strata(spark, sf_dir), ["lang"], "doc_id", 20).select("doc_id", "lang", "place")


def round_robin_sample(spark, sf_dir):
    return sampling.round_robin(_strata(spark, sf_dir), ["lang"], "doc_id", 100).select("doc_id", "lang", "place", "turn")


QUERIES = {
    f.__name__: f
    for f in (
        record_keys, file_kinds, project_links, completion_years, latest_records, exact_duplicates, shared_titles, vocabulary_use, field_audit, crosstabs,
        improved_fields, stratified_quota, stratified_sample, per_language_sample, round_robin_sample,
    )
}

_f = lambda c: f"nullif(trim({c}, ' '), '')"
_LONG = " UNION ALL ".join(
    f"SELECT rec_no, '{f}' AS field, unnest({f}) AS value FROM knowledge_objects" if f in ("keywords", "languages", "topics", "themes", "creators", "subcategories", "intended_purposes") else f"SELECT rec_no, '{f}' AS field, {f} AS value FROM knowledge_objects"
    for f in dict.fromkeys([*_AUDITED, *_CONTROLLED])
)
_V = f"WITH v AS (SELECT * FROM ({_LONG}) WHERE regexp_matches(value, '[^\\s\\p{{Z}}]'))"
_ENDING = r"coalesce(nullif(lower(regexp_replace(trim(coalesce(ko_object_extension, ''), ' '), '^\.', '')), ''), nullif(lower(regexp_extract(coalesce(ko_object_name, ''), '\.([A-Za-z0-9]{2,5})([?#].*)?$', 1)), ''), nullif(lower(regexp_extract(coalesce(ko_content_url, ''), '\.([A-Za-z0-9]{2,5})([?#].*)?$', 1)), ''))"
_KIND = """CASE WHEN coalesce(ko_object_mimetype, '') = '' AND ending IS NULL THEN 'Unknown' WHEN lower(ko_object_mimetype) = 'application/pdf' OR ending = 'pdf' THEN 'PDF' WHEN lower(ko_object_mimetype) LIKE 'video/%' OR ending IN ('mp4', 'mov', 'avi', 'mkv', 'webm') THEN 'Video'
 WHEN lower(ko_object_mimetype) LIKE 'audio/%' OR ending IN ('mp3', 'wav', 'ogg', 'm4a') THEN 'Audio' WHEN lower(ko_object_mimetype) LIKE 'image/%' OR ending IN ('png', 'jpg', 'jpeg', 'gif', 'tif', 'tiff', 'webp', 'svg') THEN 'Image' ELSE 'Other' END"""
_HOST = r"nullif(regexp_replace(lower(regexp_extract({0}, '(?i)^https?://([^/:?#\s]+)', 1)), '^www\.', ''), '')"
_LINK = "CASE WHEN regexp_matches({0}, '(?i)^https?://') THEN {0} ELSE 'https://' || {0} END"
_S = "WITH d AS (SELECT doc_id, coalesce(lower(trim(lang, ' ')), 'unknown') AS lang, coalesce(doc_kind, 'unknown') AS kind, md5(doc_id::VARCHAR || ':42') AS draw FROM documents)"
_Q = _S + """, n AS (SELECT lang, kind, count(*) AS n FROM d GROUP BY ALL), i AS (SELECT *, n * 300 / (SELECT sum(n) FROM n)::DOUBLE AS ideal FROM n), r AS (SELECT *, row_number() OVER (ORDER BY round(ideal - floor(ideal), 9) DESC, lang DESC, kind DESC) AS k FROM i),
 q AS (SELECT lang, kind, n, CASE WHEN (SELECT sum(n) FROM n) <= 300 THEN n ELSE least(n, floor(ideal) + CASE WHEN k <= 300 - (SELECT sum(floor(ideal)) FROM i) THEN 1 ELSE 0 END) END::BIGINT AS quota FROM r)"""

ORACLES = {
    "record_keys": f"""SELECT rec_no, coalesce({_f('_orig_id')}, {_f('_id')}, {_f('at_id')}) AS record, coalesce({_f('_orig_id')}, substr(md5({_f('at_id')}), 1, 24), substr(md5(coalesce(title, '') || '-' || coalesce(ko_created_at, '')), 1, 24)) AS safe,
 coalesce({_f('project_id')}, {_f('project_acronym')}, {_f('project_name')}) AS project, coalesce({_f('lower(languages[1])')}, 'unknown') AS lang, trim(regexp_replace(replace(upper(coalesce(license, '')), 'CREATIVE COMMONS', 'CC'), '[\\s_\\-]+', ' ', 'g'), ' ') AS licence FROM knowledge_objects""",
    "file_kinds": f"WITH e AS (SELECT *, {_ENDING} AS ending FROM knowledge_objects) SELECT rec_no, ending, {_KIND} AS kind, {_HOST.format(_LINK.format(_f('ko_content_url')))} AS host FROM e",
    "project_links": f"SELECT project_id, {_LINK.format(_f('project_url'))} AS link, {_HOST.format(_LINK.format(_f('project_url')))} AS host, coalesce(regexp_matches(trim(project_doi, ' '), '^10\\.[0-9]{{4,9}}/\\S+$'), false) AS doi_ok FROM projects",
    "completion_years": r"SELECT nullif(regexp_extract(date_of_completion, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1), '')::BIGINT AS year, count(*) AS n FROM knowledge_objects GROUP BY 1",
    "latest_records": "SELECT _orig_id, rec_no, title FROM (SELECT *, row_number() OVER (PARTITION BY _orig_id ORDER BY loaded_at DESC, rec_no DESC) AS i FROM knowledge_objects WHERE _orig_id IS NOT NULL) WHERE i = 1",
    "exact_duplicates": r"SELECT substr(sha1(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '))), 1, 16) AS text_key, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "shared_titles": rf"SELECT substr(sha1(lower(trim(regexp_replace(title, '\s+', ' ', 'g'), ' '))), 1, 16) AS value_key, count(*) AS n, count(DISTINCT coalesce({_f('project_id')}, {_f('project_acronym')}, {_f('project_name')})) AS n_owners FROM knowledge_objects WHERE title IS NOT NULL AND trim(regexp_replace(title, '\s+', ' ', 'g'), ' ') <> '' GROUP BY 1 HAVING count(*) > 1",
    "vocabulary_use": _V + f", k AS (SELECT DISTINCT field_name AS field, lower(trim(term, ' ')) AS v FROM vocab_terms) SELECT v.field, k.v IS NOT NULL AS known, count(*) AS n, count(DISTINCT lower(trim(value, ' '))) AS n_values FROM v LEFT JOIN k ON k.field = v.field AND k.v = lower(trim(v.value, ' ')) WHERE v.field IN ({', '.join(repr(c) for c in _CONTROLLED)}) GROUP BY 1, 2",
    "field_audit": _V + f""", c AS (SELECT field, value, count(*) AS n FROM v GROUP BY ALL), s AS (SELECT field, sum(n)::BIGINT AS n_values, count(*) AS "distinct", sum(n * length(value)) AS chars, sum(n * log2(n)) AS nl FROM c GROUP BY field), k AS (SELECT field, count(DISTINCT rec_no) AS covered FROM v GROUP BY field)
 SELECT field, n_values, "distinct", round(covered / (SELECT count(*) FROM knowledge_objects), 4) AS coverage, CASE WHEN "distinct" > 1 THEN round((log2(n_values) - nl / n_values) / log2("distinct"), 4) ELSE 0.0 END AS entropy, round(chars / n_values, 4) AS mean_length, round(n_values / "distinct", 4) AS mean_reuse,
 round(CASE WHEN "distinct" < 2 THEN 0.0 WHEN "distinct" <= 40 THEN 1.0 ELSE greatest(0, (200 - "distinct") / 160) END, 4) AS facet_fitness FROM s JOIN k USING (field) WHERE field IN ({', '.join(repr(c) for c in _AUDITED)})""",
    "crosstabs": f"""WITH e AS (SELECT *, {_ENDING} AS ending FROM knowledge_objects), r AS (SELECT coalesce({_f('ko_upload_source')}, 'missing') AS source, coalesce({_f('ko_object_mimetype')}, 'missing') AS mime, {_KIND} AS kind FROM e)
 SELECT source, mime, kind, grouping_id(source, mime, kind)::BIGINT AS level, count(*) AS n FROM r GROUP BY GROUPING SETS ((source, mime), (source), (mime), (kind), (kind, source), (kind, mime), (kind, source, mime))""",
    "improved_fields": " UNION ALL ".join(
        rf"""SELECT rec_no, '{f}' AS field, length({f}) AS chars, length({f}_llm) AS chars_llm, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) AS jaccard, round(coalesce(len(list_intersect(a, b)) / nullif(least(len(list_distinct(a)), len(list_distinct(b))), 0), 0), 6) AS overlap,
 round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(a)), 0), 0), 6) AS coverage FROM (SELECT *, regexp_extract_all(lower({f}), '[\p{{L}}\p{{N}}_]+') AS a, regexp_extract_all(lower({f}_llm), '[\p{{L}}\p{{N}}_]+') AS b FROM knowledge_objects WHERE {f} IS NOT NULL AND {f}_llm IS NOT NULL)"""
        for f in ("title", "subtitle", "description")
    ),
    "stratified_quota": _Q + " SELECT lang, kind, n, quota FROM q",
    "stratified_sample": _Q + " SELECT doc_id, lang, kind FROM (SELECT *, row_number() OVER (PARTITION BY lang, kind ORDER BY draw, doc_id) AS i FROM d) JOIN q USING (lang, kind) WHERE i <= quota",
    "per_language_sample": _S + " SELECT doc_id, lang, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY draw, doc_id) AS place FROM d) WHERE place <= 20",
    "round_robin_sample": _S + " SELECT doc_id, lang, place, row_number() OVER (ORDER BY place, lang, doc_id) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY draw, doc_id) AS place FROM d) QUALIFY turn <= 100",
}
