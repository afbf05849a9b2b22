"""Which fields find a record: retrieval by single fields, by bundles, and with one field left out."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from granary.functions import text as T
from granary.functions.arrow import map_columns
from granary.operators import retrieval as R
from granary.session import keep

_words = re.compile(r"\w\w+").findall


def bundle_mrr(df: DataFrame, key: str, bundles: dict[str, list[str]], queries: DataFrame, k: int = 10) -> DataFrame:
    """(bundle, n_queries, mrr): reciprocal rank of each query's own record when only a bundle's fields are searched.

    All bundles are scored in one plan: the bundle is part of the document's and the query's key.
    """
    each = F.array(*[F.struct(F.lit(b).alias("bundle"), F.concat_ws(" ", *fields).alias("text")) for b, fields in bundles.items()])
    texts = df.select(F.col(key).alias("k"), F.inline(each))
    posted = keep(R.postings(texts, "k", F.col("text"), "bundle"))
    asked = keep(queries.select("query", "term").distinct())
    ranked = R.search(texts, "k", F.col("text"), posted, asked, k, part="bundle")
    best = ranked.where(F.col("doc") == F.col("query")).select(F.col("part").alias("bundle"), "query", (1.0 / F.col("rank")).alias("rr"))
    every = asked.select("query").distinct().crossJoin(F.broadcast(df.sparkSession.createDataFrame([(b,) for b in bundles], "bundle string")))
    return every.join(best, ["bundle", "query"], "left").groupBy("bundle").agg(F.count("*").alias("n_queries"), F.avg(F.coalesce("rr", F.lit(0.0))).alias("mrr"))


def leave_one_out(fields: list[str]) -> dict[str, list[str]]:
    """The whole bundle and the bundles without one field."""
    return {"all": fields} | {f"without {f}": [x for x in fields if x != f] for f in fields}


def tfidf_pairs(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, cosine) of two texts of a row by tf-idf over both columns, smoothed as ln((1+n)/(1+df)) + 1; null where a side has no words."""
    each = F.array(F.struct(F.lit("a").alias("side"), F.col(a).alias("text")), F.struct(F.lit("b").alias("side"), F.col(b).alias("text")))
    texts = df.select(F.col(key).alias("k"), F.inline(each))
    posted = keep(R.postings(texts, "k", F.col("text"), "side"))
    n = texts.agg(F.count("*").alias("n"))
    freq = posted.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    # As below: postings are planned by their columns' default sizes, and without the hint Spark would broadcast them.
    wide = posted.join(freq.hint("merge"), "term").groupBy("doc", "term", "idf").agg(F.sum(F.when(F.col("side") == "a", F.col("tf")).otherwise(0)).alias("x"), F.sum(F.when(F.col("side") == "b", F.col("tf")).otherwise(0)).alias("y"))
    w = F.col("idf") * F.col("idf")
    sums = wide.groupBy("doc").agg(F.sum(w * F.col("x") * F.col("y")).alias("xy"), F.sum(w * F.col("x") * F.col("x")).alias("xx"), F.sum(w * F.col("y") * F.col("y")).alias("yy"))
    return df.select(F.col(key)).join(sums.select(F.col("doc").alias(key), F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("cosine")), key, "left")


def tfidf_phrase_pairs(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, cosine) as tfidf_pairs, over words of at least two signs without stop words, and pairs of successive such words; all terms count.

    ``key`` is unique. Both texts of a row are counted where it is read, at most 4,096 rows at once; a term leaves them once, with all its documents there.
    """
    stops = frozenset(T.STOP_WORDS)
    schema = f"term string, df int, doc array<{df.schema[key].dataType.simpleString()}>, x array<int>, y array<int>"
    kinds = [f.type for f in to_arrow_schema(_parse_datatype_string(schema))]

    def make():
        def count(keys, left, right):
            names: dict[str, int] = {}
            flat, sizes = [], []
            for t in (*left, *right):
                flat += (found := [names.setdefault(w, len(names)) for w in _words(t) if w not in stops])
                sizes.append(len(found))
            n, v, word = len(keys), len(names), np.array(flat, np.int64)
            text = np.repeat(np.arange(2 * n), sizes)
            follows = text[1:] == text[:-1]
            code = np.concatenate([word, (v + word[:-1] * v + word[1:])[follows]])  # below v a word, from there on a pair
            text = np.concatenate([text, text[1:][follows]])
            seen = np.sort((code * n + text % n) * 2 + text // n)  # by term, document and side
            cell = seen >> 1
            at = np.flatnonzero(np.diff(cell, prepend=-1))
            y = np.add.reduceat(seen & 1, at) if len(at) else at
            x = np.diff(at, append=len(seen)) - y
            term, doc = cell[at] // n, cell[at] % n
            first = np.flatnonzero(np.diff(term, prepend=-1))
            sides = np.add.reduceat((x > 0).astype(np.int32) + (y > 0), first) if len(first) else first
            every = list(names)
            shown = [every[c] if c < v else f"{every[c // v - 1]} {every[c % v]}" for c in term[first].tolist()]
            offsets = pa.array(np.append(first, len(at)), pa.int32())
            lists = (pa.array(keys, kinds[2].value_type).take(pa.array(doc)), pa.array(x, pa.int32()), pa.array(y, pa.int32()))
            return [pa.array(shown, kinds[0]), pa.array(sides, kinds[1]), *[pa.ListArray.from_arrays(offsets, c, type=kind) for c, kind in zip(lists, kinds[2:])]]

        def work(*columns):
            parts = [count(*(c[i : i + 4096] for c in columns)) for i in range(0, len(columns[0]), 4096)]
            return [pa.concat_arrays(c) for c in zip(*parts)]

        return work

    lower = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    counted = keep(map_columns(df.select(F.col(key).alias("k"), lower(a).alias("a"), lower(b).alias("b")), make, schema))
    n = df.agg((2 * F.count("*")).alias("n"))
    freq = counted.groupBy("term").agg(F.sum("df").alias("df")).crossJoin(F.broadcast(n)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = F.col("idf") * F.col("idf")
    # Postings are planned by their columns' default sizes, a small part of what they hold; without the hint Spark would broadcast them.
    each = counted.join(freq.hint("merge"), "term").select("idf", F.inline(F.arrays_zip("doc", "x", "y")))
    sums = each.groupBy("doc").agg(F.sum(w * F.col("x") * F.col("y")).alias("xy"), F.sum(w * F.col("x") * F.col("x")).alias("xx"), F.sum(w * F.col("y") * F.col("y")).alias("yy"))
    return df.select(F.col(key)).join(sums.select(F.col("doc").alias(key), F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("cosine")), key, "left")
