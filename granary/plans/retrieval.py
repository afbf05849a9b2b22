"""Queries on retrieval: the index, BM25 and its evaluation.

The query set is every document whose id is divisible by 50, searched against all documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import retrieval as R
from granary.sources.tables import table
from granary.session import keep


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _ko(spark, sf_dir):
    return table(spark, sf_dir, "knowledge_objects")


def _index(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    posted = keep(R.postings(docs, "doc_id", F.col("text")))
    return posted, R.corpus_size(docs, posted)


def corpus_terms(spark, sf_dir):
    posted, size = _index(spark, sf_dir)
    rows = R.document_frequency(posted).crossJoin(F.broadcast(size))
    return rows.select("term", "df", F.round(R.idf(F.col("df"), F.col("n_docs")), 4).alias("idf"), F.round(R.specificity(F.col("df"), F.col("n_docs")), 4).alias("specificity"))


def common_words_by_lang(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("lang", F.coalesce(F.lower(F.trim("lang")), F.lit("")))
    return R.common_terms(R.postings(docs, "doc_id", F.col("text"), "lang"), "lang", docs, 0.25, 20)


def key_terms(spark, sf_dir):
    posted, size = _index(spark, sf_dir)
    return R.key_terms(posted, size, 10).select(F.col("doc").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "term")


def pseudo_queries(spark, sf_dir):
    return R.pseudo_queries(*_index(spark, sf_dir))


def _ranked(spark, sf_dir, k):
    posted, size = _index(spark, sf_dir)
    asked = keep(R.pseudo_queries(posted, size))
    return asked, R.search(_docs(spark, sf_dir), "doc_id", F.col("text"), posted, asked, k)


def bm25_topk(spark, sf_dir):
    _, ranked = _ranked(spark, sf_dir, 10)
    return ranked.select("query", "doc", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


def known_item_rank(spark, sf_dir):
    posted, size = _index(spark, sf_dir)
    ranks = R.own_ranks(_docs(spark, sf_dir), "doc_id", F.col("text"), posted, keep(R.pseudo_queries(posted, size)))
    return ranks.select("query", "rank", F.round(1 / F.log2(1 + F.col("rank")), 4).alias("gain"))


def mrr_hit(spark, sf_dir):
    asked, ranked = _ranked(spark, sf_dir, 10)
    targets = asked.select("query", F.col("query").alias("doc")).distinct()
    per_query = R.reciprocal_rank(ranked, targets, 10)
    return per_query.agg(F.count("*").alias("n"), F.round(F.avg("rr"), 4).alias("mrr"), F.round(F.avg("hit"), 4).alias("hit1"))


def rrf_fusion(spark, sf_dir):
    """BM25 over the whole text and over its first line, fused."""
    docs = _docs(spark, sf_dir)
    asked, ranked = _ranked(spark, sf_dir, 20)
    title = F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0))
    by_title = R.search(docs, "doc_id", title, keep(R.postings(docs, "doc_id", title)), asked, 20)
    fused = R.fuse([ranked, by_title], 10)
    return fused.select("query", "doc", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def ndcg_judgments(spark, sf_dir):
    """Titles of the records searched with the judged queries, against the panel's grades."""
    ko = _ko(spark, sf_dir).select("rec_no", "_orig_id", "title", "description")
    posted = keep(R.postings(ko, "rec_no", F.concat_ws(" ", "title", "description")))
    judged = table(spark, sf_dir, "judgments")
    asked = judged.select(F.col("query_no").alias("query"), F.explode(F.array_distinct(T.words(F.col("query")))).alias("term")).distinct()
    # Judged queries of the same words are searched once; what they find is handed to each of them.
    sets = keep(asked.groupBy("query").agg(F.array_join(F.sort_array(F.collect_set("term")), " ").alias("words")))
    terms = sets.select(F.col("words").alias("query"), F.explode(F.split("words", " ")).alias("term")).distinct()
    # Several exports of a record are one document: the best of them counts. Exports without a record's id are one, behind all others of their score.
    record = ko.withColumn("_orig_id", F.coalesce("_orig_id", F.lit("\U0010ffff")))
    found = R.search(record, "_orig_id", F.concat_ws(" ", "title", "description"), posted, terms, 10, repeated=True)
    ranked = sets.join(found.select(F.col("query").alias("words"), "doc", "rank"), "words").select("query", "doc", "rank")
    grades = judged.select(F.col("query_no").alias("query"), F.explode("relevant").alias("doc", "grade"))
    m = R.graded_measures(ranked, grades, 10)
    return m.select("query", *[F.round(c, 4).alias(c) for c in m.columns if c != "query"])


def graded_qrels(spark, sf_dir):
    """Grades between every 50th record and all others by shared project and subjects."""
    ko = _ko(spark, sf_dir)
    asked = ko.where("rec_no % 50 = 0").select(F.col("rec_no").alias("query"))
    return R.related_grades(ko, "rec_no", ["project_id", "project_acronym"], ["themes", "topics", "subcategories"], asked).withColumn("grade", F.col("grade").cast("long"))


def graded_pool(spark, sf_dir):
    """Grades by shared project and subjects of the 20 best records for every 50th record's query."""
    ko = _ko(spark, sf_dir)
    body = keep(R.postings(ko, "rec_no", F.col("ko_content_flat")))
    asked = R.pseudo_queries(body, R.corpus_size(ko, body))
    both = F.concat_ws(" ", "title", "description")
    pool = R.search(ko, "rec_no", both, keep(R.postings(ko, "rec_no", both)), asked, 20)
    grades = R.shared_key_grades(pool, ko, "rec_no", ["project_id", "project_acronym"], ["themes", "topics", "subcategories"])
    return grades.withColumn("grade", F.col("grade").cast("long"))


def query_term_leakage(spark, sf_dir):
    """How many words of queries made from the text stand in the title of the same record."""
    ko = _ko(spark, sf_dir)
    body = keep(R.postings(ko, "rec_no", F.col("ko_content_flat")))
    asked = R.pseudo_queries(body, R.corpus_size(ko, body))
    leak = R.term_leakage(asked, R.postings(ko, "rec_no", F.col("title")))
    return leak.select("n_queries", F.round("leakage", 4).alias("leakage"))


QUERIES = {
    f.__name__: f
    for f in (corpus_terms, common_words_by_lang, key_terms, pseudo_queries, bm25_topk, known_item_rank, mrr_hit, rrf_fusion, ndcg_judgments, graded_qrels, graded_pool, query_term_leakage)
}


def _post(name: str, source: str, key: str, expr: str) -> str:
    """CTEs of an index: tokens, postings with length, size."""
    return rf"""{name}_w AS (SELECT {key} AS doc, regexp_extract_all(lower(coalesce({expr}, '')), '[\p{{L}}\p{{N}}_]+') AS ws FROM {source}),
 {name}_n AS (SELECT count(*) AS n_docs, avg(len(ws)) AS avg_dl FROM {name}_w),
 {name}_p AS (SELECT doc, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, len(ws) AS dl, unnest(ws) AS term FROM {name}_w) GROUP BY doc, term),
 {name}_f AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term)"""


_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _asked(name: str) -> str:
    return rf"""asked AS (SELECT doc AS query, term, i FROM (SELECT doc, term, row_number() OVER (PARTITION BY doc ORDER BY w DESC, term) AS i FROM (SELECT p.doc, p.term, round(tf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS w
 FROM {name}_p p JOIN {name}_f USING (term), {name}_n WHERE p.doc % 50 = 0 AND length(term) > 2 AND NOT regexp_matches(term, '^[0-9]+$') AND term NOT IN ({_STOPS}))) WHERE i <= 5)"""


def _scores(out: str, name: str, asked: str = "asked") -> str:
    return f"""{out} AS (SELECT query, p.doc, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))) AS score
 FROM (SELECT DISTINCT query, term FROM {asked}) a JOIN {name}_p p USING (term) JOIN {name}_f USING (term), {name}_n GROUP BY query, p.doc)"""


def _top(out: str, scores: str, k: int, places: int = 6) -> str:
    return f"{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, {places}) DESC, doc) AS rank FROM {scores}) WHERE rank <= {k})"


_D = "WITH " + _post("d", "documents", "doc_id", "text")
_FIRST = _post("t", "documents", "doc_id", "string_split(coalesce(text, ''), chr(10))[1]")
_BM = _D + ", " + _asked("d") + ", " + _scores("s", "d")

ORACLES = {
    "corpus_terms": _D + " SELECT term, df, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 4) AS idf, round(ln((n_docs + 1) / (df + 1)) / ln(n_docs + 1), 4) AS specificity FROM d_f, d_n",
    "common_words_by_lang": _D + """, l AS (SELECT doc_id AS doc, coalesce(lower(trim(lang)), '') AS lang FROM documents), n AS (SELECT lang, count(*) AS n FROM l GROUP BY lang HAVING count(*) >= 20)
 SELECT lang, term, count(*) AS df FROM d_p JOIN l USING (doc) JOIN n USING (lang) GROUP BY lang, term, n HAVING count(*) > 0.25 * n""",
    "key_terms": _D + r""", r AS (SELECT p.doc, p.term, row_number() OVER (PARTITION BY p.doc ORDER BY round((1 + ln(tf)) * ln((n_docs + 1) / (df + 1)), 6) DESC, p.term) AS rank FROM d_p p JOIN d_f USING (term), d_n
 WHERE regexp_matches(term, '^\p{L}{3,}$') AND df <= 0.2 * n_docs) SELECT doc AS doc_id, rank, term FROM r WHERE rank <= 10""",
    "pseudo_queries": _D + ", " + _asked("d") + " SELECT query, term, i FROM asked",
    "bm25_topk": _BM + ", " + _top("r", "s", 10) + " SELECT query, doc, rank, round(score, 4) AS score FROM r",
    "known_item_rank": _BM + """, m AS (SELECT query, round(score, 6) AS mine FROM s WHERE doc = query), q AS (SELECT DISTINCT query FROM asked),
 k AS (SELECT q.query, CASE WHEN mine IS NULL THEN 1 + count(*) + ((SELECT n_docs FROM d_n) - count(*) - 1) / 2 ELSE 1 + count(*) FILTER (round(score, 6) > mine) + count(*) FILTER (round(score, 6) = mine AND doc <> q.query) / 2 END AS rank FROM q LEFT JOIN m USING (query) JOIN s USING (query) GROUP BY q.query, mine)
 SELECT query, rank::DOUBLE AS rank, round(1 / log2(1 + rank), 4) AS gain FROM k""",
    "mrr_hit": _BM + ", " + _top("r", "s", 10) + """, q AS (SELECT DISTINCT query FROM asked) SELECT count(*) AS n, round(avg(coalesce(1.0 / rank, 0)), 4) AS mrr, round(avg(CASE WHEN rank = 1 THEN 1 ELSE 0 END), 4) AS hit1 FROM q LEFT JOIN (SELECT query, rank FROM r WHERE doc = query) USING (query)""",
    "rrf_fusion": _BM + ", " + _FIRST + ", " + _scores("u", "t") + ", " + _top("a", "s", 20) + ", " + _top("b", "u", 20) + """, e AS (SELECT query, doc, rank FROM a UNION ALL SELECT query, doc, rank FROM b), f AS (SELECT query, doc, sum(1.0::DOUBLE / (60 + rank)) AS score FROM e GROUP BY ALL), """ + _top("g", "f", 10, 9) + " SELECT query, doc, rank, round(score, 6) AS score FROM g",
    "ndcg_judgments": "WITH " + _post("k", "knowledge_objects", "rec_no", "concat_ws(' ', title, description)") + r""", asked AS (SELECT DISTINCT query_no AS query, unnest(regexp_extract_all(lower(coalesce(query, '')), '[\p{L}\p{N}_]+')) AS term FROM judgments), """ + _scores("s0", "k") + """, s AS (SELECT query, _orig_id AS doc, max(score) AS score FROM s0 JOIN knowledge_objects o ON o.rec_no = s0.doc GROUP BY ALL), """ + _top("r", "s", 10) + """,
 g AS (SELECT query, doc, max(grade) AS grade FROM (SELECT query_no AS query, unnest(map_keys(relevant)) AS doc, unnest(map_values(relevant)) AS grade FROM judgments) GROUP BY ALL),
 i AS (SELECT query, count(*) FILTER (grade > 0) AS n_rel, coalesce(sum((pow(2, grade) - 1) / log2(n + 1)) FILTER (n <= 10 AND grade > 0), 0) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS n FROM g) GROUP BY query),
 h AS (SELECT query, min(rank) AS first, count(*) AS hits, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg, sum(nth / rank) AS precisions FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS nth FROM r JOIN g USING (query, doc) WHERE grade > 0) GROUP BY query)
 SELECT query, round(coalesce(1.0 / first, 0), 4) AS mrr, round(coalesce(hits / greatest(n_rel, 1), 0), 4) AS recall, round(least(1.0, 10 / greatest(n_rel, 1)), 4) AS recall_ceiling, round(coalesce(dcg / nullif(ideal, 0), 0), 4) AS ndcg, round(coalesce(precisions / nullif(least(10, n_rel), 0), 0), 4) AS ap FROM i LEFT JOIN h USING (query)""",
    "graded_pool": "WITH " + _post("d", "knowledge_objects", "rec_no", "ko_content_flat") + ", " + _post("k", "knowledge_objects", "rec_no", "concat_ws(' ', title, description)") + ", " + _asked("d") + ", " + _scores("s0", "k") + ", " + _top("r", "s0", 20) + """,
 s AS (SELECT DISTINCT rec_no AS doc, k AS key FROM (SELECT rec_no, unnest([CASE WHEN trim(project_id, ' ') <> '' THEN 'project_id=' || trim(project_id, ' ') END, CASE WHEN trim(project_acronym, ' ') <> '' THEN 'project_acronym=' || trim(project_acronym, ' ') END]) AS k FROM knowledge_objects) WHERE k IS NOT NULL),
 v AS (SELECT DISTINCT doc, key FROM (SELECT rec_no AS doc, 'themes=' || lower(trim(unnest(themes), ' ')) AS key FROM knowledge_objects UNION ALL SELECT rec_no, 'topics=' || lower(trim(unnest(topics), ' ')) FROM knowledge_objects UNION ALL SELECT rec_no, 'subcategories=' || lower(trim(unnest(subcategories), ' ')) FROM knowledge_objects) WHERE key NOT IN ('themes=', 'topics=', 'subcategories=') AND key IS NOT NULL),
 u AS (SELECT * FROM v WHERE key IN (SELECT key FROM v GROUP BY key HAVING count(*) <= greatest(1, floor(0.25 * (SELECT count(*) FROM knowledge_objects))))),
 w AS (SELECT r.query, r.doc, count(*) AS n FROM r JOIN u a ON a.doc = r.query JOIN u b ON b.doc = r.doc AND b.key = a.key GROUP BY ALL), p AS (SELECT DISTINCT r.query, r.doc FROM r JOIN s a ON a.doc = r.query JOIN s b ON b.doc = r.doc AND b.key = a.key)
 SELECT r.query, r.doc, CASE WHEN r.query = r.doc THEN 3 WHEN p.doc IS NOT NULL THEN 2 WHEN w.n >= 2 THEN 1 ELSE 0 END::BIGINT AS grade FROM r LEFT JOIN w ON w.query = r.query AND w.doc = r.doc LEFT JOIN p ON p.query = r.query AND p.doc = r.doc""",
    "graded_qrels": """WITH s AS (SELECT DISTINCT rec_no AS doc, k AS key FROM (SELECT rec_no, unnest([CASE WHEN trim(project_id, ' ') <> '' THEN 'project_id=' || trim(project_id, ' ') END, CASE WHEN trim(project_acronym, ' ') <> '' THEN 'project_acronym=' || trim(project_acronym, ' ') END]) AS k FROM knowledge_objects) WHERE k IS NOT NULL),
 v AS (SELECT DISTINCT doc, key FROM (SELECT rec_no AS doc, 'themes=' || lower(trim(unnest(themes), ' ')) AS key FROM knowledge_objects UNION ALL SELECT rec_no, 'topics=' || lower(trim(unnest(topics), ' ')) FROM knowledge_objects UNION ALL SELECT rec_no, 'subcategories=' || lower(trim(unnest(subcategories), ' ')) FROM knowledge_objects) WHERE key NOT IN ('themes=', 'topics=', 'subcategories=') AND key IS NOT NULL),
 u AS (SELECT * FROM v WHERE key IN (SELECT key FROM v GROUP BY key HAVING count(*) <= greatest(1, floor(0.25 * (SELECT count(*) FROM knowledge_objects))))),
 a AS (SELECT a.doc AS query, b.doc, 1 AS grade FROM u a JOIN u b USING (key) WHERE a.doc % 50 = 0 AND a.doc <> b.doc GROUP BY ALL HAVING count(*) >= 2 UNION ALL SELECT DISTINCT a.doc, b.doc, 2 FROM s a JOIN s b USING (key) WHERE a.doc % 50 = 0 AND a.doc <> b.doc UNION ALL SELECT rec_no, rec_no, 3 FROM knowledge_objects WHERE rec_no % 50 = 0)
 SELECT query, doc, max(grade)::BIGINT AS grade FROM a GROUP BY ALL""",
    "query_term_leakage": "WITH " + _post("d", "knowledge_objects", "rec_no", "ko_content_flat") + ", " + _post("t", "knowledge_objects", "rec_no", "title") + ", " + _asked("d") + """, q AS (SELECT query, count(t.term) / count(*) AS share FROM asked a LEFT JOIN t_p t ON t.doc = a.query AND t.term = a.term GROUP BY query) SELECT count(*) AS n_queries, round(avg(share), 4) AS leakage FROM q""",
}
