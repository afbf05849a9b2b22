"""Queries on the search log."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import behaviour as B
from granary.operators.ranks import at_index, cumulative
from granary.session import keep
from granary.sources.tables import table


def _clean(spark, sf_dir):
    return B.clean_events(table(spark, sf_dir, "search_log"))


def _people(spark, sf_dir):
    return B.by_people(_clean(spark, sf_dir))


def _labelled(spark, sf_dir):
    return B.outcomes(_people(spark, sf_dir))


def search_events(spark, sf_dir):
    return _clean(spark, sf_dir).select("event_no", "t", "actor", "query", "results", "page", "arm", "latency")


def event_sessions(spark, sf_dir):
    return B.sessions(_people(spark, sf_dir))


def outcome_mix(spark, sf_dir):
    rows = _labelled(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))
    return rows.crossJoin(rows.agg(F.sum("n").alias("total"))).select("outcome", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def _rates(labelled, key):
    rows = B.failure_rates(labelled, key, 5)
    return rows.select(F.col("key"), "n", "failures", *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")])


def failure_by_lang(spark, sf_dir):
    return _rates(_labelled(spark, sf_dir), F.col("lang"))


def failure_by_shape(spark, sf_dir):
    return _rates(_labelled(spark, sf_dir), B.shape(F.col("raw")))


def failure_by_results(spark, sf_dir):
    n = F.col("results")
    return _rates(_labelled(spark, sf_dir), F.when(n == 0, "none").when(n <= 5, "few").when(n <= 20, "some").otherwise("many"))


def query_frequency(spark, sf_dir):
    """How often each query was asked and by how many people, and its most frequent spelling."""
    rows = _people(spark, sf_dir).where("query <> ''").groupBy("query", "raw").agg(F.count("*").alias("n"))
    return rows.groupBy("query").agg(F.sum("n").alias("times"), F.max(F.struct("n", "raw"))["raw"].alias("spelling"))


def ab_arms(spark, sf_dir):
    rows = B.arm_summary(_labelled(spark, sf_dir))
    return rows.select("arm", "actors", "searches", "failures", *[F.round(c, 6).alias(c) for c in ("rate", "share", "low", "high")])


def ab_bootstrap(spark, sf_dir):
    return B.cluster_bootstrap(_labelled(spark, sf_dir))


def aa_split(spark, sf_dir):
    """Actors split by a hash that has nothing to do with the experiment: any difference is the measurement's."""
    left = F.conv(F.substring(F.sha2(F.concat(F.lit("aa:"), "actor"), 256), 1, 2), 16, 10).cast("int") < 128
    rows = B.arm_summary(_labelled(spark, sf_dir).withColumn("arm", F.when(left, "aa_left").otherwise("aa_right")))
    return rows.select("arm", "actors", "searches", "failures", *[F.round(c, 6).alias(c) for c in ("rate", "share", "low", "high")])


def guardrails(spark, sf_dir):
    """Share without results, middle number of results, and middle and 95th latency of each arm, by place in the sorted values."""
    rows = keep(B.in_one_arm(_labelled(spark, sf_dir)))
    zero = rows.groupBy("arm").agg(F.round(F.avg((F.col("results") == 0).cast("double")), 6).alias("zero_share"))
    results, latency = cumulative(rows, "results", ["arm"]), cumulative(rows, "latency", ["arm"])
    place = lambda share: F.floor(F.col("total") * share)
    parts = [at_index(results, "results", ["arm"], place(0.5), "median_results"), at_index(latency, "latency", ["arm"], place(0.5), "latency_p50"), at_index(latency, "latency", ["arm"], place(0.95), "latency_p95")]
    for p in parts:
        zero = zero.join(p, "arm", "left")
    return zero


QUERIES = {
    f.__name__: f
    for f in (search_events, event_sessions, outcome_mix, failure_by_lang, failure_by_shape, failure_by_results, query_frequency, ab_arms, ab_bootstrap, aa_split, guardrails)
}

_E = r"""WITH p AS (SELECT event_no, epoch_us(try_cast(regexp_replace(ts, '(Z|\+00:00)$', '') AS TIMESTAMP)) AS t, substr(sha256(CASE WHEN trim(coalesce(user_uuid, ''), ' ') <> '' THEN trim(user_uuid, ' ') WHEN trim(coalesce(ip, ''), ' ') <> '' THEN trim(ip, ' ') END), 1, 16) AS a,
  array_to_string(regexp_extract_all(lower(coalesce(original_query, '')), '[\p{L}\p{N}_]+'), ' ') AS query, coalesce(original_query, '') AS raw, coalesce(detected_lang, 'unknown') AS lang, coalesce(results_count, 0)::BIGINT AS results, coalesce(page, 1)::BIGINT AS page,
  nullif(trim(experiment_arm, ' '), '') AS arm, latency_ms::BIGINT AS latency, coalesce(user_agent, '') AS agent, row_number() OVER (PARTITION BY event_no ORDER BY loaded_at DESC) AS i FROM search_log),
 e AS (SELECT * EXCLUDE (a, i), coalesce(a, '') AS actor FROM p WHERE i = 1 AND t IS NOT NULL),
 h AS (SELECT * FROM e WHERE NOT regexp_matches(agent, '""" + B.ROBOTS + r"""') AND actor <> '')"""
_L = _E + r""", n AS (SELECT *, lead(t) OVER w AS nt, lead(query) OVER w AS nq FROM h WINDOW w AS (PARTITION BY actor ORDER BY t, event_no)),
 g AS (SELECT *, CASE WHEN (nt - t) / 1e6 <= 1800 THEN (nt - t) / 1e6 END AS gap, list_filter(string_split(query, ' '), lambda w: w <> '') AS m, list_filter(string_split(nq, ' '), lambda w: w <> '') AS o FROM n),
 l AS (SELECT *, CASE WHEN results = 0 THEN 'zero' WHEN gap <= 120 AND query = nq THEN 'repeat' WHEN gap <= 120 AND coalesce(len(list_intersect(m, o)) / nullif(len(list_distinct(list_concat(m, o))), 0), 0) >= 0.2 THEN 'reformulated' WHEN gap <= 120 THEN 'switched' WHEN page > 1 THEN 'page_2' ELSE 'settled' END AS outcome FROM g)"""


def _rate_sql(key: str) -> str:
    return _L + f""", s AS (SELECT {key} AS key, count(*) AS n, count(*) FILTER (outcome IN ('zero', 'reformulated', 'repeat', 'page_2')) AS failures FROM l GROUP BY ALL HAVING count(*) >= 5)
 SELECT key, n, failures, round(failures / n, 6) AS rate, {_wilson('failures', 'n')} FROM s"""


def _wilson(k: str, n: str) -> str:
    p, z2 = f"({k} / {n})", "3.8416::DOUBLE"
    mid = f"({p} + {z2} / (2 * {n})) / (1 + {z2} / {n})"
    margin = f"1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n})) / (1 + {z2} / {n})"
    return f"round(greatest(0, least(1, {mid} - {margin})), 6) AS low, round(greatest(0, least(1, {mid} + {margin})), 6) AS high"


def _arms_sql(source: str) -> str:
    return f""", r AS ({source}), c AS (SELECT actor FROM r GROUP BY actor HAVING min(arm) <> max(arm)), o AS (SELECT * FROM r WHERE actor NOT IN (SELECT actor FROM c)),
 s AS (SELECT arm, count(DISTINCT actor) AS actors, count(*) AS searches, count(*) FILTER (outcome IN ('zero', 'reformulated', 'repeat', 'page_2')) AS failures FROM o GROUP BY arm), t AS (SELECT sum(actors)::DOUBLE AS total FROM s)
 SELECT arm, actors, searches, failures, round(failures / searches, 6) AS rate, round(actors / total, 6) AS share, {_wilson('actors', 'total')} FROM s, t"""


_SHAPE = f"CASE WHEN regexp_matches(raw, '{B.QUESTION}') THEN 'question' WHEN regexp_matches(raw, '{B.NAME}') THEN 'entity/name' ELSE 'topical phrase' END"

ORACLES = {
    "search_events": _E + " SELECT event_no, t, actor, query, results, page, arm, latency FROM e",
    "event_sessions": _E + """, o AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 1800000000 THEN 1 ELSE 0 END AS opens FROM h WINDOW w AS (PARTITION BY actor ORDER BY t, event_no)), s AS (SELECT *, sum(opens) OVER (PARTITION BY actor ORDER BY t, event_no) AS no FROM o)
 SELECT actor, min(t) AS session_start, max(t) AS session_end, count(*) AS n_events FROM s GROUP BY actor, no""",
    "outcome_mix": _L + " SELECT outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM l), 6) AS share FROM l GROUP BY outcome",
    "failure_by_lang": _rate_sql("lang"),
    "failure_by_shape": _rate_sql(_SHAPE),
    "failure_by_results": _rate_sql("CASE WHEN results = 0 THEN 'none' WHEN results <= 5 THEN 'few' WHEN results <= 20 THEN 'some' ELSE 'many' END"),
    "query_frequency": _E + ", c AS (SELECT query, raw, count(*) AS n FROM h WHERE query <> '' GROUP BY ALL) SELECT query, sum(n)::BIGINT AS times, arg_max(raw, {'n': n, 'r': raw}) AS spelling FROM c GROUP BY query",
    "ab_arms": _L + _arms_sql("SELECT * FROM l WHERE arm IS NOT NULL"),
    "aa_split": _L + _arms_sql("SELECT * EXCLUDE (arm), CASE WHEN substr(sha256('aa:' || actor), 1, 1) < '8' THEN 'aa_left' ELSE 'aa_right' END AS arm FROM l"),
    "guardrails": _L + """, r AS (SELECT * FROM l WHERE arm IS NOT NULL), c AS (SELECT actor FROM r GROUP BY actor HAVING min(arm) <> max(arm)), o AS (SELECT * FROM r WHERE actor NOT IN (SELECT actor FROM c)),
 s AS (SELECT arm, avg(CASE WHEN results = 0 THEN 1.0 ELSE 0 END) AS z, list_sort(list(results)) AS rs, list_sort(list(latency) FILTER (latency IS NOT NULL)) AS ls FROM o GROUP BY arm)
 SELECT arm, round(z, 6) AS zero_share, rs[len(rs) // 2 + 1] AS median_results, ls[len(ls) // 2 + 1] AS latency_p50, ls[CAST(floor(0.95 * len(ls)) AS BIGINT) + 1] AS latency_p95 FROM s""",
}
