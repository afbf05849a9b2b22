"""Anchor texts and centroids from thesauri in triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def anchor_texts(triples: DataFrame, label: str = "prefLabel", synonym: str = "altLabel", broader: str = "broader", langs: tuple[str, ...] = ("en",), synonyms: int = 12, parents: int = 10, least: int = 30) -> DataFrame:
    """(uri, label, anchor_text) from (subject, predicate, object, lang): label, first synonyms and labels of broader terms.

    The best language is the first of ``langs`` that a concept has, else any, alphabetically. Texts under ``least`` characters are left out. A concept's lists are cut by rank
    before they are gathered, so no list grows with the data.
    """
    order = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in langs]), F.coalesce("lang", F.lit(""))).cast("int"), F.lit(0))
    ranked = triples.withColumn("_r", F.when(order > 0, order).otherwise(len(langs) + 1))
    labels = ranked.where(F.col("predicate") == label).groupBy(F.col("subject").alias("uri")).agg(F.min(F.struct("_r", "object"))["object"].alias("label"))

    def first(rows: DataFrame, n: int, name: str) -> DataFrame:
        w = Window.partitionBy("uri").orderBy("_r", "text")
        cut = rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n)
        return cut.groupBy("uri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "text"))), lambda x: x["text"]), ", ").alias(name))

    alts = first(ranked.where(F.col("predicate") == synonym).select(F.col("subject").alias("uri"), "_r", F.col("object").alias("text")).distinct(), synonyms, "alts")
    up = triples.where(F.col("predicate") == broader).select(F.col("subject").alias("uri"), F.col("object").alias("parent"))
    ups = first(up.join(labels.select(F.col("uri").alias("parent"), F.col("label").alias("text")), "parent").select("uri", F.lit(1).alias("_r"), "text").distinct(), parents, "ups")
    out = labels.join(alts, "uri", "left").join(ups, "uri", "left").select("uri", "label", F.concat_ws(". ", "label", "alts", "ups").alias("anchor_text"))
    return out.where(F.length("anchor_text") >= least)
