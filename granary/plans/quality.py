"""Queries on the quality of single documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import lexical, quality
from granary.sources.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _ko(spark, sf_dir):
    return table(spark, sf_dir, "knowledge_objects")


def token_stats(spark, sf_dir):
    w = T.words(F.col("text"))
    rows = _docs(spark, sf_dir).select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))
    return rows.withColumn("ttr", F.round(F.try_divide("n_distinct", "n_tokens"), 6))


def lexical_entropy(spark, sf_dir):
    p = lexical.lexical_profile(_docs(spark, sf_dir), "doc_id", "text")
    return p.select("doc_id", F.round("entropy_bits", 4).alias("entropy_bits"), F.round("repeated_bigram_types", 6).alias("repeated_bigram_types"))


def information_features(spark, sf_dir):
    p = lexical.lexical_profile(_docs(spark, sf_dir), "doc_id", "text")
    r = lambda c: F.round(c, 4).alias(c)
    return p.select("doc_id", "hapax", "dis", *map(r, ("yules_k", "simpsons_d", "honore_r", "guiraud_r", "herdan_c")))


def mtld(spark, sf_dir):
    return lexical.diversity(_docs(spark, sf_dir), "doc_id", "text")


def readability_lix(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(quality.lix(F.col("text")), 4).alias("lix"))


def flesch(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(quality.flesch(F.col("text")), 4).alias("flesch"))


def _rounded(df, places=6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def quality_filters(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("lang", F.lower(F.trim("lang")))
    return _rounded(quality.filter_flags(docs, "doc_id", "text", "lang"))


def repetition_lines(spark, sf_dir):
    rows = quality.filter_flags(_docs(spark, sf_dir), "doc_id", "text")
    return _rounded(rows.select("doc_id", "dup_lines", "dup_line_chars", "dup_paragraphs", "dup_paragraph_chars"))


def ngram_repetition(spark, sf_dir):
    return _rounded(lexical.ngram_repetition(_docs(spark, sf_dir), "doc_id", "text"))


def filter_summary_by_lang(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text", F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"), F.lower(F.trim("lang")).alias("label"))
    flagged = quality.filter_flags(docs.withColumn("both", F.struct("doc_id", "lang")), "both", "text", "label").withColumn("lang", F.col("both.lang"))
    return _rounded(quality.flag_summary(flagged, "lang"))


def noise_tokens(spark, sf_dir):
    return _rounded(quality.noise_tokens(_docs(spark, sf_dir), "doc_id", "text"))


def rich_text_plain(spark, sf_dir):
    """Descriptions written in the platform's editor, as plain lines."""
    return _ko(spark, sf_dir).where("description IS NOT NULL").select("rec_no", T.rich_to_plain(F.col("description")).alias("plain"))


def sentence_stats(spark, sf_dir):
    n = T.sentence_lengths(F.col("text"))
    rows = _docs(spark, sf_dir).select("doc_id", n.alias("n"))
    return rows.select("doc_id", F.size("n").cast("long").alias("n_sentences"), F.aggregate("n", F.lit(0), lambda a, x: a + x).cast("long").alias("n_tokens"), F.coalesce(F.array_max("n"), F.lit(0)).cast("long").alias("longest"))


def token_conventions(spark, sf_dir):
    """The number of tokens of each document under each convention in use."""
    t = F.col("text")
    count = {"words": T.words(t), "long_words": T.long_words(t), "ascii_words": T.ascii_words(t), "ascii_terms": T.ascii_terms(t), "content": T.without_stop_words(T.words(t))}
    return _docs(spark, sf_dir).select("doc_id", *[F.size(c).cast("long").alias(n) for n, c in count.items()], T.approximate_tokens(t).alias("approximate"), T.quarter_tokens(t).alias("quarter"))


_W = r"WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents)"
_COUNTS = _W + ", t AS (SELECT doc_id, unnest(ws) AS w FROM w), c AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY ALL), n AS (SELECT doc_id, sum(c)::BIGINT AS n, count(*) AS v, count(*) FILTER (c = 1) AS hapax, count(*) FILTER (c = 2) AS dis, sum(c * c)::DOUBLE AS sq FROM c GROUP BY ALL)"
_LINES = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT *, list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_matches(x, '[^\s\p{Z}]')) AS ls, list_filter(regexp_split_to_array(text, '\n{2,}'), lambda x: regexp_matches(x, '[^\s\p{Z}]')) AS ps,
  regexp_extract_all(text, '[\p{L}\p{N}_]+') AS ws FROM d),
s AS (SELECT doc_id, text, length(text) AS n_chars, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')) / nullif(len(ws), 0), 0.0) AS mean_word,
  coalesce((length(text) - length(replace(text, '#', '')) + (length(text) - length(replace(text, '...', ''))) / 3 + length(text) - length(replace(text, '…', ''))) / nullif(len(ws), 0), 0.0) AS symbol_share,
  coalesce(len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) / nullif(len(ws), 0), 0.0) AS alpha_words,
  len(ls) AS n_lines, len(ps) AS n_paragraphs,
  coalesce(1 - len(list_distinct(ls)) / nullif(len(ls), 0), 0.0) AS dup_lines, coalesce(1 - length(array_to_string(list_distinct(ls), '')) / nullif(length(array_to_string(ls, '')), 0), 0.0) AS dup_line_chars,
  coalesce(1 - len(list_distinct(ps)) / nullif(len(ps), 0), 0.0) AS dup_paragraphs, coalesce(1 - length(array_to_string(list_distinct(ps), '')) / nullif(length(array_to_string(ps, '')), 0), 0.0) AS dup_paragraph_chars,
  coalesce(len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[•\-*–·▪►◦‣]\s'))) / nullif(len(ls), 0), 0.0) AS bullet_lines,
  coalesce(len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) / nullif(len(ls), 0), 0.0) AS ellipsis_lines,
  coalesce(len(list_filter(ls, lambda x: regexp_matches(x, '[.!?"''”’»)…:;]\s*$'))) / nullif(len(ls), 0), 0.0) AS punctuated_lines,
  coalesce(len(list_filter(ls, lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')) <= 30)) / nullif(len(ls), 0), 0.0) AS short_lines FROM l),
f AS (SELECT doc_id, n_chars, n_words, mean_word, symbol_share, alpha_words, n_lines, n_paragraphs, dup_lines, dup_line_chars, dup_paragraphs, dup_paragraph_chars, bullet_lines, ellipsis_lines, punctuated_lines, short_lines,
  n_words < 50 AS few_words, n_words > 100000 AS many_words, n_words > 0 AND NOT (mean_word BETWEEN 3 AND 10) AS mean_word_out, n_words > 0 AND symbol_share > 0.1 AS symbols_high, bullet_lines > 0.9 AS bullets_high,
  ellipsis_lines > 0.3 AS ellipses_high, n_words > 0 AND alpha_words < 0.8 AS alpha_low, dup_lines > 0.3 AS dup_lines_high, dup_paragraphs > 0.3 AS dup_paragraphs_high, dup_line_chars > 0.2 AS dup_line_chars_high,
  dup_paragraph_chars > 0.2 AS dup_paragraph_chars_high, n_lines > 1 AND punctuated_lines <= 0.12 AS web_few_punctuated, dup_line_chars >= 0.1 AS web_dup_chars, n_lines > 1 AND short_lines >= 0.67 AS web_short_lines,
  contains(lower(text), 'lorem ipsum') AS lorem_ipsum, contains(text, '{') AS curly_bracket, contains(lower(text), 'javascript') AS javascript FROM s),
w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM d), """
_STATS = "n_chars n_words mean_word symbol_share alpha_words n_lines n_paragraphs dup_lines dup_line_chars dup_paragraphs dup_paragraph_chars bullet_lines ellipsis_lines punctuated_lines short_lines".split()
_SHOWN = ", ".join(s if s.startswith("n_") else f"round({s}, 6) AS {s}" for s in _STATS)
_RAISED = " + ".join(f"{f}::BIGINT" for f in quality.FLAGS)


def _top(n: int) -> str:
    return (
        f"g{n} AS (SELECT doc_id, array_to_string(ws[i:i + {n - 1}], ' ') AS g, count(*) AS c, min(i) AS f FROM w, unnest(range(1, greatest(len(ws) - {n - 2}, 1))) AS t(i) WHERE len(ws) >= {n} GROUP BY ALL), "
        f"b{n} AS (SELECT doc_id, CASE WHEN max(c) > 1 THEN length(arg_max(g, {{'c': c, 'f': -f}})) * max(c) ELSE 0 END AS x FROM g{n} GROUP BY ALL)"
    )


def _cover(n: int) -> str:
    return (
        f"g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + {n - 1}], ' ')) AS c FROM w, unnest(range(1, greatest(len(ws) - {n - 2}, 1))) AS t(i) WHERE len(ws) >= {n}), "
        f"p{n} AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS p FROM g{n} WHERE c > 1), "
        f"b{n} AS (SELECT doc_id, sum(length(ws[p])) AS x FROM p{n} JOIN w USING (doc_id) GROUP BY ALL)"
    )


_NGRAMS = (
    _W + ", " + ", ".join([_top(n) for n in lexical.TOP_SIZES] + [_cover(n) for n in lexical.COVER_SIZES]) + " SELECT w.doc_id, "
    + ", ".join([f"round(coalesce(b{n}.x, 0) / greatest(length(text), 1), 6)::DOUBLE AS {'top' if n < 5 else 'cover'}_{n}" for n in range(2, 11)])
    + " FROM w " + " ".join(f"LEFT JOIN b{n} ON b{n}.doc_id = w.doc_id" for n in range(2, 11))
)

_LINES += ", ".join([_top(n) for n in lexical.TOP_SIZES] + [_cover(n) for n in lexical.COVER_SIZES])
_over = lambda limits: " OR ".join(f"coalesce(b{n}.x, 0) / greatest(length(text), 1) > {x}" for n, x in limits.items())
_LINES += (
    rf""", v AS (SELECT w.doc_id, lower(trim(lang, ' ')) AS lang, ws FROM w JOIN documents USING (doc_id)), y AS (SELECT lang, unnest(ws) AS t FROM v WHERE lang IS NOT NULL), z AS (SELECT lang, t, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, t) AS i FROM y WHERE regexp_matches(t, '^\p{{L}}+$') GROUP BY lang, t),
 q AS (SELECT lang, list(t) AS stops FROM z WHERE i <= 8 GROUP BY lang), o AS (SELECT doc_id, CASE WHEN stops IS NULL THEN false ELSE len(list_intersect(ws, stops)) < 2 END AS stop_words_low FROM v LEFT JOIN q USING (lang)),
 n3 AS (SELECT w.doc_id, {_over(quality.TOP_NGRAMS)} AS top_ngrams_high, {_over(quality.COVER_NGRAMS)} AS cover_ngrams_high FROM w {" ".join(f"LEFT JOIN b{n} ON b{n}.doc_id = w.doc_id" for n in range(2, 11))}),
 fl AS (SELECT * FROM f JOIN o USING (doc_id) JOIN n3 USING (doc_id)) """
)

_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)

QUERIES = {
    f.__name__: f
    for f in (
        token_stats, lexical_entropy, information_features, mtld, readability_lix, flesch, quality_filters, repetition_lines, ngram_repetition,
        filter_summary_by_lang, noise_tokens, rich_text_plain, sentence_stats, token_conventions,
    )
}

ORACLES = {
    "token_stats": _W + " SELECT doc_id, len(ws) AS n_tokens, len(list_distinct(ws)) AS n_distinct, round(len(list_distinct(ws)) / nullif(len(ws), 0), 6) AS ttr FROM w",
    "lexical_entropy": _COUNTS + """, e AS (SELECT doc_id, -sum(c / n * log2(c / n)) + 0.0 AS e FROM c JOIN n USING (doc_id) GROUP BY ALL),
 g AS (SELECT doc_id, ws[i] AS a, ws[i + 1] AS b, count(*) AS k FROM w, unnest(range(1, greatest(len(ws), 1))) AS t(i) WHERE len(ws) > 1 GROUP BY ALL), r AS (SELECT doc_id, count(*) FILTER (k > 1) / count(*) AS r FROM g GROUP BY ALL)
 SELECT w.doc_id, round(e, 4) AS entropy_bits, CASE WHEN len(ws) > 0 THEN round(coalesce(r, 0.0), 6) END AS repeated_bigram_types FROM w LEFT JOIN e USING (doc_id) LEFT JOIN r USING (doc_id)""",
    "information_features": _COUNTS + """ SELECT w.doc_id, coalesce(hapax, 0) AS hapax, coalesce(dis, 0) AS dis, round(1e4 * (sq - n) / (n * n), 4) AS yules_k, round((sq - n) / nullif(n * (n - 1), 0), 4) AS simpsons_d,
 CASE WHEN hapax < v THEN round(100 * ln(n) / (1 - hapax / v), 4) END AS honore_r, round(v / sqrt(n), 4) AS guiraud_r, CASE WHEN n > 1 THEN round(ln(v) / ln(n), 4) END AS herdan_c FROM w LEFT JOIN n USING (doc_id)""",
    "readability_lix": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, len(regexp_extract_all(t, '\p{L}+')) AS n, greatest(1, len(regexp_extract_all(t, '[.!?:;]+(\s|$)'))) AS s, len(regexp_extract_all(t, '\p{L}{7,}')) AS l FROM d)
 SELECT doc_id, CASE WHEN n >= 100 THEN round(n / s + 100.0 * l / n, 4) END AS lix FROM c""",
    "flesch": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:''[a-z0-9]+)?') AS ws FROM documents),
 c AS (SELECT doc_id, len(ws) AS n, greatest(1, len(regexp_extract_all(t, '[.!?]+(\s|$)'))) AS s, list_sum(list_transform(ws, lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN regexp_matches(w, '[^aeiouy]e$') AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))) AS y FROM d)
 SELECT doc_id, CASE WHEN n > 0 THEN round(206.835::DOUBLE - 1.015::DOUBLE * n / s - 84.6::DOUBLE * y / n, 4) END AS flesch FROM c""",
    "quality_filters": _LINES + f"SELECT doc_id, {_SHOWN}, {', '.join(quality.FLAGS)}, {_RAISED} AS n_raised FROM fl",
    "repetition_lines": _LINES + "SELECT doc_id, round(dup_lines, 6) AS dup_lines, round(dup_line_chars, 6) AS dup_line_chars, round(dup_paragraphs, 6) AS dup_paragraphs, round(dup_paragraph_chars, 6) AS dup_paragraph_chars FROM fl",
    "ngram_repetition": _NGRAMS,
    "filter_summary_by_lang": _LINES + f""", u AS (UNPIVOT (SELECT doc_id, {', '.join(f'{f}::BIGINT AS {f}' for f in quality.FLAGS)} FROM fl) ON {', '.join(quality.FLAGS)} INTO NAME flag VALUE v), g AS (SELECT doc_id, coalesce(lower(trim(lang)), '') AS lang FROM documents), n AS (SELECT lang, count(*) AS total FROM g GROUP BY lang)
 SELECT lang, flag, sum(v)::BIGINT AS n, round(sum(v) / any_value(total), 6) AS share FROM u JOIN g USING (doc_id) JOIN n USING (lang) GROUP BY lang, flag HAVING sum(v) > 0""",
    "sentence_stats": r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]\s+'), lambda x: regexp_matches(x, '[^\s\p{Z}]')) AS ss FROM documents),
 n AS (SELECT doc_id, list_transform(ss, lambda s: len(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(s), 'https?://\S+|www\.\S+', ' ', 'g'), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda t: length(t) >= 2))) AS n FROM d)
 SELECT doc_id, len(n) AS n_sentences, coalesce(list_sum(n), 0)::BIGINT AS n_tokens, coalesce(list_max(n), 0) AS longest FROM n""",
    "token_conventions": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS l FROM documents) SELECT doc_id, len(regexp_extract_all(l, '[\p{{L}}\p{{N}}_]+')) AS words, len(regexp_extract_all(l, '[\p{{L}}\p{{N}}_]{{2,}}')) AS long_words,
 len(regexp_extract_all(l, '[a-z0-9]+(?:''[a-z0-9]+)?')) AS ascii_words, len(regexp_extract_all(l, '[a-z][a-z0-9''-]+')) AS ascii_terms, len(list_filter(regexp_extract_all(l, '[\p{{L}}\p{{N}}_]+'), lambda x: x NOT IN ({_STOPS}))) AS content,
 len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS approximate, greatest(1, length(t) // 4) AS quarter FROM d""",
}

ORACLES |= {
    "noise_tokens": r"""WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' '), lambda x: x <> '') AS ts FROM documents),
 t AS (SELECT doc_id, ts[i] AS t, regexp_replace(lower(ts[i]), '^[.,;:]+|[.,;:]+$', '', 'g') AS l, CASE WHEN i > 1 THEN regexp_replace(lower(ts[i - 1]), '^[.,;:]+|[.,;:]+$', '', 'g') ELSE '' END AS p FROM d, unnest(range(1, len(ts) + 1)) AS u(i)),
 k AS (SELECT doc_id, CASE WHEN regexp_matches(t, '<[^>]+>|&[a-z]+;|&#\d+;') THEN 'markup' WHEN regexp_matches(t, '(?i)https?://|www\.|\S+@\S+\.[0-9A-Za-z_]+') THEN 'url'
   WHEN regexp_matches(t, 'Ã[\x{80}-\x{bf}]|â€|\x{fffd}|Â[ -\x{bf}]|[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]') THEN 'encoding'
   WHEN NOT regexp_matches(t, '[\p{L}\p{N}]') AND (length(t) >= 2 OR regexp_matches(t, '^[|■□★#*_=~^<>{}\[\]]$')) THEN 'symbols' WHEN regexp_matches(t, '\p{L}') AND l = p THEN 'repeats' END AS k FROM t),
 n AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (k = 'markup') AS markup, count(*) FILTER (k = 'url') AS url, count(*) FILTER (k = 'encoding') AS encoding, count(*) FILTER (k = 'symbols') AS symbols, count(*) FILTER (k = 'repeats') AS repeats, count(k) AS bad FROM k GROUP BY doc_id)
 SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(markup, 0) AS markup, coalesce(url, 0) AS url, coalesce(encoding, 0) AS encoding, coalesce(symbols, 0) AS symbols, coalesce(repeats, 0) AS repeats, round(1 - bad / n_tokens, 6) AS cleanness FROM d LEFT JOIN n USING (doc_id)""",
    "rich_text_plain": r"""WITH d AS (SELECT rec_no, regexp_replace(regexp_replace(regexp_replace(description, '(?i)<li\b[^>]*>', chr(10) || '• ', 'g'), '(?i)<br\s*/?>|</(?:p|div|h[1-6]|li|tr|ul|ol)>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM knowledge_objects WHERE description IS NOT NULL),
 e AS (SELECT rec_no, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM d)
 SELECT rec_no, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10)) AS plain FROM e""",
}
