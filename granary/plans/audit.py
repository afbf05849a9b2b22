"""Queries on filters, field ablation and inference."""

from __future__ import annotations

from pyspark.sql import functions as F


from granary.operators import ablation, filters, inference, sentences
from granary.operators import retrieval as R
from granary.plans import retrieval as plans
from granary.plans.statistics import _LEN, _avg, _lengths
from granary.sources.tables import table
from granary.session import keep


def _ko(spark, sf_dir):
    return table(spark, sf_dir, "knowledge_objects")


def filter_funnel(spark, sf_dir):
    """Records by the first filter that they fail."""
    c = F.col
    tests = {
        "no text": F.regexp_like("ko_content_flat", F.lit(r"[^\s]")), "too short": F.length("ko_content_flat") >= 500, "no file type": F.lower(F.trim("ko_object_mimetype")) != "",
        "other language": filters.has_any(c("languages"), ["en", "eng", "english", "en-gb", "englisch"]), "no licence": F.trim("license") != "", "failed extraction": ~filters.extraction_failed(c("ko_content_flat")),
    }
    return filters.funnel(_ko(spark, sf_dir), tests)[1]


def _asked(spark, sf_dir):
    body = keep(R.postings(_ko(spark, sf_dir), "rec_no", F.col("ko_content_flat")))
    return R.pseudo_queries(body, R.corpus_size(_ko(spark, sf_dir), body))


_BUNDLE = ["title", "subtitle", "description"]


def field_mrr(spark, sf_dir):
    """How well each field alone finds the record that a query from its text is about."""
    rows = ablation.bundle_mrr(_ko(spark, sf_dir), "rec_no", {f: [f] for f in _BUNDLE}, _asked(spark, sf_dir))
    return rows.select("bundle", "n_queries", F.round("mrr", 4).alias("mrr"))


def field_ablation(spark, sf_dir):
    rows = ablation.bundle_mrr(_ko(spark, sf_dir), "rec_no", ablation.leave_one_out(_BUNDLE), _asked(spark, sf_dir))
    return rows.select("bundle", "n_queries", F.round("mrr", 4).alias("mrr"))


def tfidf_similarity(spark, sf_dir):
    return ablation.tfidf_pairs(_ko(spark, sf_dir), "rec_no", "description", "ko_content_flat").select("rec_no", F.round("cosine", 5).alias("cosine"))


def tfidf_phrase_similarity(spark, sf_dir):
    return ablation.tfidf_phrase_pairs(_ko(spark, sf_dir), "rec_no", "description", "ko_content_flat").select("rec_no", F.round("cosine", 5).alias("cosine"))


def sentence_chunks(spark, sf_dir):
    return sentences.sentence_chunks(_ko(spark, sf_dir), "rec_no", "ko_content_flat")


def acronym_check(spark, sf_dir):
    return sentences.acronym_check(_ko(spark, sf_dir), "rec_no", "description")


def partial_correlation(spark, sf_dir):
    rows = inference.partial_spearman(_lengths(spark, sf_dir), "mean_word", "ttr", "n_words")
    return rows.select("n", F.round("rho", 4).alias("rho"), F.round("partial_rho", 4).alias("partial_rho"))


def mean_word_interval(spark, sf_dir):
    return inference.mean_interval(_lengths(spark, sf_dir), "doc_id", "mean_word", rounds=1000)


def weight_stability(spark, sf_dir):
    cols = ["l_quantity", "l_discount", "l_tax"]
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), (F.col("l_quantity") / 50).alias("l_quantity"), (F.col("l_discount") * 10).alias("l_discount"), (F.col("l_tax") * 12.5).alias("l_tax"))
    out = inference.rank_stability(rows, "id", cols, {"first": {"l_quantity": 2.0, "l_discount": 1.0, "l_tax": 1.0}, "last": {"l_quantity": 1.0, "l_discount": 1.0, "l_tax": 2.0}}, dict.fromkeys(cols, 1.0))
    return out.select("weighting", "n", *[F.round(c, 3).alias(c) for c in ("rho", "mean_shift", "max_shift", "over_tenth")])


def rater_errors(spark, sf_dir):
    """How each reader of the panel departs from the panel's middle grade."""
    votes = table(spark, sf_dir, "reading_panel")
    middle = votes.groupBy("rec_no", "field_name").agg(F.percentile("band", F.lit(0.5)).alias("middle"))
    out = inference.error_patterns(votes.join(middle, ["rec_no", "field_name"]), "middle", "band", ["rater"])
    return out.select("rater", "n", *[F.round(c, 6).alias(c) for c in ("bias", "spread", "over", "under", "exact")])


QUERIES = {f.__name__: f for f in (filter_funnel, field_mrr, field_ablation, tfidf_similarity, tfidf_phrase_similarity, sentence_chunks, acronym_check, partial_correlation, mean_word_interval, weight_stability, rater_errors)}


def _bundles(bundles: dict[str, list[str]]) -> str:
    texts = " UNION ALL ".join(f"SELECT '{b}' AS bundle, rec_no AS doc, {plans_words(fields)} AS ws FROM knowledge_objects" for b, fields in bundles.items())
    return (
        "WITH " + plans._post("d", "knowledge_objects", "rec_no", "ko_content_flat") + ", " + plans._asked("d")
        + f""", w AS ({texts}), n AS (SELECT bundle, count(*) AS n_docs, avg(len(ws)) AS avg_dl FROM w GROUP BY bundle), p AS (SELECT bundle, doc, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT bundle, doc, len(ws) AS dl, unnest(ws) AS term FROM w) GROUP BY ALL), f AS (SELECT bundle, term, count(*) AS df FROM p GROUP BY ALL),
 s AS (SELECT bundle, query, p.doc, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))) AS score FROM asked a JOIN p USING (term) JOIN f USING (bundle, term) JOIN n USING (bundle) GROUP BY ALL),
 r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bundle, query ORDER BY round(score, 6) DESC, doc) AS rank FROM s) WHERE rank <= 10 AND doc = query),
 q AS (SELECT DISTINCT bundle, query FROM asked, n) SELECT bundle, count(*) AS n_queries, round(avg(coalesce(1.0 / rank, 0)), 4) AS mrr FROM q LEFT JOIN r USING (bundle, query) GROUP BY bundle"""
    )


def plans_words(fields: list[str]) -> str:
    return rf"regexp_extract_all(lower(concat_ws(' ', {', '.join(fields)})), '[\p{{L}}\p{{N}}_]+')"


ORACLES = {
    "filter_funnel": r"""WITH l AS (SELECT *, coalesce(ko_content_flat, '') AS t, list_filter(regexp_split_to_array(coalesce(ko_content_flat, ''), '\r\n|\r|\n'), lambda x: regexp_matches(x, '[^\s\p{Z}]')) AS ls FROM knowledge_objects),
 s AS (SELECT CASE WHEN NOT coalesce(regexp_matches(ko_content_flat, '[^\s]'), false) THEN 'no text' WHEN length(t) < 500 THEN 'too short' WHEN coalesce(trim(ko_object_mimetype, ' '), '') = '' THEN 'no file type'
  WHEN len(list_intersect(list_transform(coalesce(languages, []), lambda x: lower(trim(x, ' '))), ['en', 'eng', 'english', 'en-gb', 'englisch'])) = 0 THEN 'other language' WHEN coalesce(trim(license, ' '), '') = '' THEN 'no licence'
  WHEN length(t) < 80 OR len(list_filter(['impressum', 'datenschutz', 'cookies', 'terms', 'richtlinien', 'youtube', 'google llc', 'sign in'], lambda m: contains(lower(t), m))) >= 2
   OR (len(ls) >= 20 AND len(list_filter(ls, lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')) <= 18)) > 0.6 * len(ls)) THEN 'failed extraction' ELSE 'kept' END AS step FROM l)
 SELECT step, count(*) AS n FROM s GROUP BY step""",
    "field_mrr": _bundles({f: [f] for f in _BUNDLE}),
    "field_ablation": _bundles(ablation.leave_one_out(_BUNDLE)),
    "tfidf_similarity": rf"""WITH w AS (SELECT rec_no, 'a' AS side, {plans_words(['description'])} AS ws FROM knowledge_objects UNION ALL SELECT rec_no, 'b', {plans_words(['ko_content_flat'])} FROM knowledge_objects),
 p AS (SELECT rec_no, side, term, count(*) AS tf FROM (SELECT rec_no, side, unnest(ws) AS term FROM w) GROUP BY ALL), f AS (SELECT term, ln((1 + (SELECT count(*) FROM w)) / (1 + count(*))) + 1 AS idf FROM p GROUP BY term),
 x AS (SELECT rec_no, term, idf, coalesce(max(tf) FILTER (side = 'a'), 0) AS x, coalesce(max(tf) FILTER (side = 'b'), 0) AS y FROM p JOIN f USING (term) GROUP BY ALL),
 s AS (SELECT rec_no, sum(idf * idf * x * y) AS xy, sum(idf * idf * x * x) AS xx, sum(idf * idf * y * y) AS yy FROM x GROUP BY rec_no) SELECT k.rec_no, round(xy / nullif(sqrt(xx * yy), 0), 5) AS cosine FROM knowledge_objects k LEFT JOIN s USING (rec_no)""",
    "tfidf_phrase_similarity": rf"""WITH v AS (SELECT rec_no, 'a' AS side, {plans_words(['description'])} AS ws FROM knowledge_objects UNION ALL SELECT rec_no, 'b', {plans_words(['ko_content_flat'])} FROM knowledge_objects),
 w AS (SELECT rec_no, side, list_filter(ws, lambda x: length(x) > 1 AND x NOT IN ({plans._STOPS})) AS ws FROM v),
 p AS (SELECT rec_no, side, term, count(*) AS tf FROM (SELECT rec_no, side, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w) GROUP BY ALL), f AS (SELECT term, ln((1 + (SELECT count(*) FROM w)) / (1 + count(*))) + 1 AS idf FROM p GROUP BY term),
 x AS (SELECT rec_no, term, idf, coalesce(max(tf) FILTER (side = 'a'), 0) AS x, coalesce(max(tf) FILTER (side = 'b'), 0) AS y FROM p JOIN f USING (term) GROUP BY ALL),
 s AS (SELECT rec_no, sum(idf * idf * x * y) AS xy, sum(idf * idf * x * x) AS xx, sum(idf * idf * y * y) AS yy FROM x GROUP BY rec_no) SELECT k.rec_no, round(xy / nullif(sqrt(xx * yy), 0), 5) AS cosine FROM knowledge_objects k LEFT JOIN s USING (rec_no)""",
    "partial_correlation": _LEN + f""", r AS (SELECT {_avg('mean_word')} AS x, {_avg('ttr')} AS y, {_avg('n_words')} AS z FROM d), c AS (SELECT count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r)
 SELECT n, round(xy, 4) AS rho, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 4) AS partial_rho FROM c""",
    "weight_stability": f"""WITH v AS (SELECT l_quantity / 50 AS q, l_discount * 10 AS d, l_tax * 12.5::DOUBLE AS t FROM lineitem), m AS (SELECT round((q + d + t) / 3, 9) AS b, round((2 * q + d + t) / 4, 9) AS f, round((q + d + 2 * t) / 4, 9) AS l FROM v),
 r AS (SELECT {_avg('b')} AS b, {_avg('f')} AS f, {_avg('l')} AS l FROM m), n AS (SELECT count(*) AS n FROM r) SELECT 'first' AS weighting, any_value(n) AS n, round(corr(b, f), 3) AS rho, round(avg(abs(b - f)), 3) AS mean_shift, round(max(abs(b - f)), 3) AS max_shift, round(avg((abs(b - f) > 0.1 * n)::INT), 3) AS over_tenth FROM r, n
 UNION ALL SELECT 'last', any_value(n), round(corr(b, l), 3), round(avg(abs(b - l)), 3), round(max(abs(b - l)), 3), round(avg((abs(b - l) > 0.1 * n)::INT), 3) FROM r, n""",
    "rater_errors": "WITH m AS (SELECT rec_no, field_name, quantile_cont(band, 0.5) AS middle FROM reading_panel GROUP BY ALL), e AS (SELECT rater, band - middle AS e FROM reading_panel JOIN m USING (rec_no, field_name)) SELECT rater, count(*) AS n, round(avg(e), 6) AS bias, round(stddev_pop(e), 6) AS spread, round(avg((e > 0.5)::INT), 6) AS over, round(avg((e < -0.5)::INT), 6) AS under, round(avg((abs(e) <= 0.5)::INT), 6) AS exact FROM e GROUP BY rater",
}
