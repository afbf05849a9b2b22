"""Named queries of the text problems, each over its whole tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, chunks, languages, markup, packing, reading, repetition, scans, text_types
from granary.session import keep
from granary.sources.tables import table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def _ko(spark, sf_dir):
    return _table(spark, sf_dir, "knowledge_objects")


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents")


def _limits(spark, sf_dir) -> dict[str, tuple[int, int]]:
    """A small table of settings, one row per limit; the first of several rows for a text field holds."""
    rows = _table(spark, sf_dir, "size_limits").where("unit = 'characters'").orderBy("limit_name").collect()
    out: dict[str, tuple[int, int]] = {}
    for r in rows:
        out.setdefault(r["applies_to"], (r["max_size"], r["overlap"]))
    return out


def _capacities(spark, sf_dir) -> dict[str, int]:
    rows = _table(spark, sf_dir, "size_limits").where("unit = 'tokens' AND applies_to = 'documents.text'").orderBy("limit_name").collect()
    return {r["limit_name"]: r["max_size"] for r in rows}


def p1_found(spark, sf_dir):
    return scans.noisy(_ko(spark, sf_dir))


def p1_repaired(spark, sf_dir):
    return scans.repair(_ko(spark, sf_dir))


def p2_found(spark, sf_dir):
    return markup.marked_up(_ko(spark, sf_dir))


def p2_clean(spark, sf_dir):
    return markup.clean(_ko(spark, sf_dir))


def p3_found(spark, sf_dir):
    return chunks.oversized(_ko(spark, sf_dir), _limits(spark, sf_dir))


def p3_pieces(spark, sf_dir):
    return chunks.split_texts(_ko(spark, sf_dir), _limits(spark, sf_dir))


def p3_rejoined(spark, sf_dir):
    """Every text put together from its pieces without their overlaps, with whether all pieces are within the limit and each overlap is the end of the piece before."""
    limits = _limits(spark, sf_dir)
    lap = F.element_at(F.create_map(*[F.lit(x) for f, (_, n) in limits.items() for x in (f, n)]), F.col("field_name")).cast("int")
    whole = chunks.split_texts(_ko(spark, sf_dir), limits).groupBy("rec_no", "field_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "piece"))), lambda x: x["piece"]).alias("p")
    )
    rest = F.transform("p", lambda x, i: F.when(i == 0, x).otherwise(F.substr(x, lap + 1)))
    fits = F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: (i == 1) | F.startswith(F.get("p", i - 1), F.right(F.get("p", F.greatest(i - 2, F.lit(0))), lap)))
    return whole.select("rec_no", "field_name", F.array_join(rest, "").alias("text"), (F.array_max(F.transform("p", F.char_length)) <= F.element_at(F.create_map(*[F.lit(x) for f, (n, _) in limits.items() for x in (f, n)]), F.col("field_name"))).alias("within"), fits.alias("lapped"))


def p4_found(spark, sf_dir):
    return languages.mislabelled(_ko(spark, sf_dir))


def p4_languages(spark, sf_dir):
    return languages.identify(_ko(spark, sf_dir))


def p4_passages(spark, sf_dir):
    return languages.passages(_ko(spark, sf_dir))


def p5_found(spark, sf_dir):
    return text_types.classify(_ko(spark, sf_dir)).where("content_class <> 'prose'").select("rec_no", "content_class")


def p5_statistics(spark, sf_dir):
    return text_types.classify(_ko(spark, sf_dir))


def p6_found(spark, sf_dir):
    levels = reading.reading_levels(_ko(spark, sf_dir), _table(spark, sf_dir, "reading_panel"))
    return levels.where("band <> 2").select("rec_no", "field_name", "band")


def p6_levels(spark, sf_dir):
    return reading.reading_levels(_ko(spark, sf_dir), _table(spark, sf_dir, "reading_panel"))


def p8_ids(spark, sf_dir):
    return bpe.encode_documents(_docs(spark, sf_dir))


def p8_ids_multi(spark, sf_dir):
    return bpe.encode_documents(_docs(spark, sf_dir), tokenizer="byte_bpe_multi_50k")


def p8_library_ids_word(spark, sf_dir):
    return bpe.encode_documents(_docs(spark, sf_dir), tokenizer="word_bpe_49k")


def p8_library_ids_piece(spark, sf_dir):
    return bpe.encode_documents(_docs(spark, sf_dir), tokenizer="piece_bpe_32k")


def p8_decoded(spark, sf_dir):
    """Every text again from its ids."""
    return bpe.decode_documents(bpe.encode_documents(_docs(spark, sf_dir)))


def p9_containers(spark, sf_dir):
    """(limit_name, doc_id, piece_no, piece_tokens, container_no) for every capacity; the tokens are counted once."""
    sized = keep(bpe.count_tokens(_docs(spark, sf_dir)))
    parts = [packing.fill_containers(sized, size).withColumn("limit_name", F.lit(name)) for name, size in _capacities(spark, sf_dir).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("limit_name", "doc_id", "piece_no", "piece_tokens", "container_no")


def p9_valid(spark, sf_dir):
    """Per capacity: documents, documents without a row, containers over the capacity, needless splits, pieces that come twice, and whether the number of containers is within one, or 0.2 %, of the waste-free number."""
    filled = p9_containers(spark, sf_dir)
    sizes = F.create_map(*[F.lit(x) for kv in _capacities(spark, sf_dir).items() for x in kv])
    filled = filled.withColumn("max_size", F.element_at(sizes, F.col("limit_name")))
    loads = filled.where("container_no IS NOT NULL").groupBy("limit_name", "max_size", "container_no").agg(F.sum("piece_tokens").alias("load"))
    by_load = loads.groupBy("limit_name").agg(
        F.count_if(F.expr("load > max_size")).alias("n_over_full"), (F.count("*") <= F.ceil(F.sum("load") / F.first("max_size")) * 1.002 + 1).alias("tight")
    )
    docs = filled.groupBy("limit_name", "max_size", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("piece_no").alias("d"), F.sum("piece_tokens").alias("tokens"))
    by_doc = docs.groupBy("limit_name").agg(
        F.count("*").alias("n_documents"), F.count_if(F.expr("n > 1 AND tokens <= max_size")).alias("n_needless_splits"), F.count_if(F.expr("n > d")).alias("n_repeated")
    )
    return by_doc.join(by_load, "limit_name")


def p10_found(spark, sf_dir):
    """Documents of which 0.4 repeats; this share is the query's, so no threshold of a group is learnt."""
    return repetition.measure(_docs(spark, sf_dir)).where("share >= 0.4").select("doc_id")


def p10_repetition(spark, sf_dir):
    """Documents that repeat more than is usual in their language and source."""
    found = repetition.repetitive(_docs(spark, sf_dir))
    return found.withColumn("share", F.round("share", 6)).withColumn("threshold", F.round("threshold", 6))


def p10_shares(spark, sf_dir):
    rows = repetition.measure(_docs(spark, sf_dir))
    return rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.round("share", 6).alias("share"))


_SHARES = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
runs AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS run FROM w, unnest(range(1, greatest(len(ws) - 6, 1))) AS t(i) WHERE len(ws) >= 8),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, run) AS first FROM runs) WHERE i > first),
covered AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM late) GROUP BY doc_id),
shares AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CASE WHEN k IS NULL THEN 0.0 ELSE CAST(k AS DOUBLE) / len(ws) END AS exact FROM w LEFT JOIN covered USING (doc_id))
"""

QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_repaired, p2_found, p2_clean, p3_found, p3_pieces, p3_rejoined, p4_found, p4_languages, p4_passages, p5_found, p5_statistics, p6_found, p6_levels,
        p8_ids, p8_ids_multi, p8_decoded, p8_library_ids_word, p8_library_ids_piece, p9_containers, p9_valid, p10_found, p10_repetition, p10_shares,
    )
}

ORACLES = {
    "p3_found": """
SELECT rec_no, l.applies_to AS field_name FROM knowledge_objects k
JOIN (SELECT applies_to, max_size FROM size_limits WHERE unit = 'characters') l
  ON length(CASE l.applies_to WHEN 'ko_content_flat' THEN k.ko_content_flat ELSE k.ko_content_flat_summarised END) > l.max_size""",
    "p3_rejoined": """
SELECT rec_no, 'ko_content_flat' AS field_name, ko_content_flat AS text, true AS within, true AS lapped FROM knowledge_objects WHERE ko_content_flat IS NOT NULL
UNION ALL SELECT rec_no, 'ko_content_flat_summarised', ko_content_flat_summarised, true, true FROM knowledge_objects WHERE ko_content_flat_summarised IS NOT NULL""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_valid": """
SELECT limit_name, (SELECT count(*) FROM documents) AS n_documents, CAST(0 AS BIGINT) AS n_needless_splits, CAST(0 AS BIGINT) AS n_repeated,
  CAST(0 AS BIGINT) AS n_over_full, true AS tight
FROM size_limits WHERE unit = 'tokens' AND applies_to = 'documents.text'""",
    "p10_found": _SHARES + "SELECT doc_id FROM shares WHERE exact >= 0.4",
    "p10_repetition": _SHARES
    + r"""
, named AS (SELECT doc_id, lower(trim(coalesce(lang, ''))) AS lang, lower(trim(coalesce(source, ''))) AS source, n_words, exact FROM shares JOIN documents USING (doc_id)),
limits AS (SELECT lang, source, greatest(quantile_disc(exact, 0.9), 1e-9) AS threshold FROM named GROUP BY lang, source)
SELECT doc_id, lang, source, CAST(n_words AS INTEGER) AS n_words, round(exact, 6) AS share, round(threshold, 6) AS threshold
FROM named JOIN limits USING (lang, source) WHERE exact >= threshold""",
    "p10_shares": _SHARES + "SELECT doc_id, n_words, round(exact, 6) AS share FROM shares",
}
