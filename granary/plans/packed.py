"""Queries on packed values."""

from __future__ import annotations

from granary.operators.keywords import infer_separators, split_values
from granary.sources.tables import table


def p7_found(spark, sf_dir):
    ko = table(spark, sf_dir, "knowledge_objects")
    return split_values(ko, only_packed=True).select("rec_no", "field_name", "pos", "keyword")


def p7_keywords(spark, sf_dir):
    """All values of all fields, also of those that hold one value a string."""
    return split_values(table(spark, sf_dir, "knowledge_objects"))


def p7_separators(spark, sf_dir):
    ko = table(spark, sf_dir, "knowledge_objects")
    return infer_separators(ko, "rec_no", ("keywords", "keywords_llm"), "ko_upload_source")


QUERIES = {f.__name__: f for f in (p7_found, p7_keywords, p7_separators)}
ORACLES: dict[str, str] = {}
