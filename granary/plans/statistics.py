"""Queries on agreement, distributions and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import ranks, statistics, vectors
from granary.sources.tables import table
from granary.session import keep


def _t(spark, sf_dir, name):
    return table(spark, sf_dir, name)


_ITEM = ["rec_no", "field_name"]
_r = lambda df, *names, places=6: df.select(*[F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


def panel_majority(spark, sf_dir):
    rows = statistics.panel_grades(_t(spark, sf_dir, "reading_panel"), _ITEM, "band")
    return rows.select(*_ITEM, *[F.col(c).cast("long").alias(c) for c in ("grade", "spread", "n_votes")], "status")


def panel_pair_kappa(spark, sf_dir):
    return _r(statistics.rater_pairs(_t(spark, sf_dir, "reading_panel"), _ITEM, "rater", "band", [1, 2, 3]), "agreement", "kappa")


def panel_fleiss(spark, sf_dir):
    return _r(statistics.fleiss_kappa(_t(spark, sf_dir, "reading_panel"), _ITEM, "band", 3), "agreement", "kappa")


def _lengths(spark, sf_dir):
    w = T.cased_words(F.col("text"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).alias("c"), F.size(F.array_distinct(w)).alias("v"), (F.coalesce(F.lower(F.trim("lang")), F.lit("")) == "en").cast("long").alias("is_en"))
    return rows.where("n_words > 0").select("doc_id", "n_words", F.round(F.col("c") / F.col("n_words"), 6).alias("mean_word"), F.round(F.col("v") / F.col("n_words"), 6).alias("ttr"), "is_en")


def length_bias(spark, sf_dir):
    """Rank correlation of text measures with the number of words."""
    rows = keep(_lengths(spark, sf_dir))
    out = [ranks.spearman(rows, m, "n_words").select(F.lit(m).alias("metric"), "n", F.round("rho", 4).alias("rho")) for m in ("mean_word", "ttr")]
    return out[0].unionByName(out[1])


def calibration_bins(spark, sf_dir):
    rows = statistics.calibration_bins(keep(_lengths(spark, sf_dir)), "mean_word", "is_en", 10, 30)
    return rows.select("bin", "low", "high", "n", F.round("p", 6).alias("p"))


def area_under_curve(spark, sf_dir):
    return _r(statistics.area_under_curve(keep(_lengths(spark, sf_dir)), "mean_word", "is_en"), "auc")


def drift_ks(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("value", (F.col("ts") >= "2024-01-16").cast("long").alias("is_new"))
    return _r(statistics.drift(keep(rows), "value", "is_new"), "ks")


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def entropy_weights(spark, sf_dir):
    return _r(statistics.entropy_weights(_t(spark, sf_dir, "lineitem"), _MEASURES), "weight", places=4)


def critic_weights(spark, sf_dir):
    return _r(statistics.critic_weights(_t(spark, sf_dir, "lineitem"), _MEASURES), "weight", places=4)


def correlation_matrix(spark, sf_dir):
    return _r(statistics.correlations(_t(spark, sf_dir, "lineitem"), _MEASURES), "corr", places=4)


def length_bands(spark, sf_dir):
    n = F.size(T.words(F.col("text")))
    return _r(statistics.band_counts(_t(spark, sf_dir, "documents"), n, [50, 200, 1000], ["tiny", "short", "middle", "long"]), "pct", places=4)


def before_after_effects(spark, sf_dir):
    rows = statistics.effect_table(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", F.col("l_shipdate") >= "1995-06-17", 20000.0)
    return rows.select("l_returnflag", *[F.round(c, 4).alias(c) for c in rows.columns if c != "l_returnflag"])


def tail_risk(spark, sf_dir):
    return _r(statistics.tail(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice"), "cut", "mean", places=3)


def dense_topk(spark, sf_dir):
    rows = vectors.nearest(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=50, k=10)
    return rows.select(F.col("query").alias("vec_id"), "rank", "neighbour", F.round("cosine", 5).alias("cosine"))


def centroid_scores(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings")
    joined = rows.join(vectors.centroids(rows, "embedding", ["label"]), "label").select("vec_id", "label", F.round(vectors.cosine(F.col("embedding"), F.col("centroid")), 4).alias("cosine"))
    return joined.withColumn("score", vectors.similarity_band(F.col("cosine")))


def label_coherence(spark, sf_dir):
    return _r(vectors.coherence(_t(spark, sf_dir, "embeddings"), "embedding", "label"), "mean_pair_cosine", places=5)


QUERIES = {
    f.__name__: f
    for f in (
        panel_majority, panel_pair_kappa, panel_fleiss, length_bias, calibration_bins, area_under_curve, drift_ks, entropy_weights, critic_weights,
        correlation_matrix, length_bands, before_after_effects, tail_risk, dense_topk, centroid_scores, label_coherence,
    )
}

_LEN = r"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+') AS ws FROM documents),
 d AS (SELECT doc_id, len(ws) AS n_words, round(length(array_to_string(ws, '')) / len(ws), 6) AS mean_word, round(len(list_distinct(ws)) / len(ws), 6) AS ttr, (coalesce(lower(trim(lang, ' ')), '') = 'en')::BIGINT AS is_en FROM w WHERE len(ws) > 0)"""
_avg = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
_KAPPA = """WITH w AS (SELECT rec_no, field_name, max(band) FILTER (rater = 1) AS r1, max(band) FILTER (rater = 2) AS r2, max(band) FILTER (rater = 3) AS r3 FROM reading_panel GROUP BY ALL),
 p AS (SELECT 1 AS a, 2 AS b, r1 AS x, r2 AS y FROM w UNION ALL SELECT 1, 3, r1, r3 FROM w UNION ALL SELECT 2, 3, r2, r3 FROM w), q AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL), t AS (SELECT a, b, count(*) AS n, avg((x = y)::INT) AS agreement FROM q GROUP BY a, b),
 c AS (SELECT a, b, sum(rx * ry) AS s FROM (SELECT a, b, x AS v, count(*) AS rx FROM q GROUP BY ALL) JOIN (SELECT a, b, y AS v, count(*) AS ry FROM q GROUP BY ALL) USING (a, b, v) GROUP BY a, b)
 SELECT t.a::BIGINT AS a, t.b::BIGINT AS b, n, round(agreement, 6) AS agreement, round((agreement - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM t JOIN c USING (a, b)"""
_SUMS = ", ".join(f"sum({c}) AS s_{c}, sum(CASE WHEN {c} > 0 THEN {c} * ln({c}) ELSE 0 END) AS l_{c}" for c in _MEASURES)
_GAPS = ", ".join(f"1 - (ln(s_{c}) - l_{c} / s_{c}) / ln(n) AS g_{c}" for c in _MEASURES)
_PAIRS = [(a, b) for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1 :]]
_SCALED = ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in _MEASURES)
_CRITIC = ", ".join(f"stddev_samp({c}) * (" + " + ".join(f"1 - corr({c}, {o})" for o in _MEASURES if o != c) + f") AS g_{c}" for c in _MEASURES)
_WEIGHTS = "SELECT unnest([{0}]) AS indicator, round(unnest([{1}]) / ({2}), 4) AS weight FROM g".format(", ".join(f"'{c}'" for c in _MEASURES), ", ".join(f"g_{c}" for c in _MEASURES), " + ".join(f"g_{c}" for c in _MEASURES))
_DOT = "list_dot_product(a.embedding::DOUBLE[], {0})"

ORACLES = {
    "panel_majority": "WITH c AS (SELECT rec_no, field_name, band, count(*) AS c FROM reading_panel WHERE band IS NOT NULL GROUP BY ALL) SELECT rec_no, field_name, arg_max(band, {'c': c, 'b': -band})::BIGINT AS grade, (max(band) - min(band))::BIGINT AS spread, sum(c)::BIGINT AS n_votes, CASE WHEN max(band) = min(band) THEN 'unanimous' WHEN max(c) / sum(c) > 0.5 THEN 'majority' ELSE 'split' END AS status FROM c GROUP BY rec_no, field_name",
    "panel_pair_kappa": _KAPPA,
    "panel_fleiss": """WITH c AS (SELECT rec_no, field_name, band, count(*) AS c FROM reading_panel GROUP BY ALL), i AS (SELECT rec_no, field_name, sum(c) AS m, sum(c * c) AS sq FROM c GROUP BY ALL HAVING sum(c) = 3), p AS (SELECT count(*) AS n_items, avg((sq - 3) / 6) AS agreement FROM i),
 e AS (SELECT sum(t * t) / pow(sum(t), 2) AS pe FROM (SELECT band, sum(c) AS t FROM c SEMI JOIN i USING (rec_no, field_name) GROUP BY band)) SELECT n_items, round(agreement, 6) AS agreement, round((agreement - pe) / (1 - pe), 6) AS kappa FROM p, e""",
    "length_bias": _LEN + f", r AS (SELECT {_avg('n_words')} AS a, {_avg('mean_word')} AS b, {_avg('ttr')} AS c FROM d) SELECT 'mean_word' AS metric, count(*) AS n, round(corr(a, b), 4) AS rho FROM r UNION ALL SELECT 'ttr', count(*), round(corr(a, c), 4) FROM r",
    "calibration_bins": _LEN + """, n AS (SELECT count(*) AS total, greatest(30, count(*) // 10) AS per FROM d), i AS (SELECT *, row_number() OVER (ORDER BY mean_word, is_en DESC) - 1 AS i FROM d), b AS (SELECT least(i // per, greatest(0, total // per - 1 + CASE WHEN total % per >= 30 THEN 1 ELSE 0 END)) AS bin, mean_word, is_en FROM i, n)
 SELECT bin, min(mean_word) AS low, max(mean_word) AS high, count(*) AS n, round(avg(is_en), 6) AS p FROM b GROUP BY bin""",
    "area_under_curve": _LEN + f", r AS (SELECT is_en, {_avg('mean_word')} AS r FROM d), s AS (SELECT sum(r) FILTER (is_en = 1) AS s, sum(is_en) AS p, count(*) AS n FROM r) SELECT n, round((s - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc FROM s",
    "drift_ks": """WITH e AS (SELECT value, (ts >= '2024-01-16')::BIGINT AS x FROM events WHERE value IS NOT NULL), t AS (SELECT sum(x)::BIGINT AS n_new, sum(1 - x)::BIGINT AS n_old FROM e), c AS (SELECT value, sum(sum(x)) OVER (ORDER BY value) AS cx, sum(sum(1 - x)) OVER (ORDER BY value) AS cy FROM e GROUP BY value)
 SELECT n_old, n_new, round(max(abs(cx / n_new - cy / n_old)), 6) AS ks FROM c, t GROUP BY ALL""",
    "entropy_weights": f"WITH s AS (SELECT count(*) AS n, {_SUMS} FROM lineitem), g AS (SELECT {_GAPS} FROM s) {_WEIGHTS}",
    "critic_weights": f"WITH s AS (SELECT {_SCALED} FROM lineitem), g AS (SELECT {_CRITIC} FROM s) {_WEIGHTS}",
    "correlation_matrix": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS corr FROM lineitem" for a, b in _PAIRS),
    "length_bands": r"""WITH b AS (SELECT CASE WHEN n < 50 THEN 'tiny' WHEN n < 200 THEN 'short' WHEN n < 1000 THEN 'middle' ELSE 'long' END AS band FROM (SELECT len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS n FROM documents))
 SELECT x.band, count(b.band) AS n, round(100.0 * count(b.band) / (SELECT count(*) FROM documents), 4) AS pct FROM (SELECT unnest(['tiny', 'short', 'middle', 'long']) AS band) x LEFT JOIN b USING (band) GROUP BY x.band""",
    "before_after_effects": """WITH q AS (SELECT l_returnflag, quantile_cont(CASE WHEN l_shipdate < '1995-06-17' THEN l_extendedprice END, [0.25, 0.5, 0.75]) AS b, quantile_cont(CASE WHEN l_shipdate >= '1995-06-17' THEN l_extendedprice END, [0.25, 0.5, 0.75]) AS a,
  100.0 * avg((l_extendedprice < 20000)::INT) FILTER (l_shipdate < '1995-06-17') AS bb, 100.0 * avg((l_extendedprice < 20000)::INT) FILTER (l_shipdate >= '1995-06-17') AS ba FROM lineitem GROUP BY ALL)
 SELECT l_returnflag, round(b[2], 4) AS median_before, round(a[2], 4) AS median_after, round(b[3] - b[1], 4) AS iqr_before, round(a[3] - a[1], 4) AS iqr_after, round(a[2] - b[2], 4) AS change, round(bb, 4) AS below_before, round(ba, 4) AS below_after FROM q""",
    "tail_risk": "WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS cut FROM lineitem GROUP BY ALL) SELECT l_returnflag, round(cut, 3) AS cut, count(*) AS n, round(avg(l_extendedprice), 3) AS mean FROM lineitem JOIN q USING (l_returnflag) WHERE l_extendedprice <= cut GROUP BY ALL",
    "dense_topk": """WITH s AS (SELECT a.vec_id, b.vec_id AS neighbour, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS c FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
 SELECT vec_id, rank, neighbour, round(c, 5) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 9) DESC, neighbour) AS rank FROM s) WHERE rank <= 10""",
    "centroid_scores": """WITH p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label),
 s AS (SELECT vec_id, e.label, round(list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(c, c) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS cosine FROM embeddings e JOIN c USING (label))
 SELECT vec_id, label, cosine, CASE WHEN (cosine + 1) / 2 >= 0.65 THEN 5 WHEN (cosine + 1) / 2 >= 0.55 THEN 4 WHEN (cosine + 1) / 2 >= 0.45 THEN 3 WHEN (cosine + 1) / 2 >= 0.35 THEN 2 WHEN (cosine + 1) / 2 > 0 THEN 1 ELSE 0 END::BIGINT AS score FROM s""",
    "label_coherence": """WITH u AS (SELECT label, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings), p AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), s AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM p GROUP BY ALL)
 SELECT label, max(n) AS n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 5) AS mean_pair_cosine FROM s GROUP BY label""",
}
