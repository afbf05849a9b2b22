"""Inverted index, BM25, rank fusion and relevance measures as joins and aggregates.

A corpus is a postings table (doc, term, tf); document frequencies and lengths are aggregates of it.
Queries are a table (query, term). Scoring joins queries to postings on the term, so only terms that some query
has are touched; a term that is in most documents is split over tasks by AQE's skew handling of that join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.arrow import map_columns
from granary.session import keep

_words = re.compile(r"\w+").findall

K1, B = 1.2, 0.75


def postings(df: DataFrame, doc: str, text: Column, *keep: str) -> DataFrame:
    """(doc, keep..., dl, term, tf): words in lower case with their count in each document, and its length.

    A document is counted where it is read, in one Arrow batch: its tokens are never shuffled, only whole postings leave. Documents without words
    have no posting; null counts as empty.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (doc, *keep)}
    rows = df.select(F.col(doc).alias("doc"), *keep, F.lower(F.coalesce(text, F.lit(""))).alias("_text"))

    def make():
        def work(*columns):
            *ids, texts = columns
            out = []
            for i, t in enumerate(texts):
                counts = Counter(_words(t))
                head = tuple(c[i] for c in ids)
                n = sum(counts.values())
                out += [(*head, n, w, k) for w, k in counts.items()]
            return list(zip(*out)) or [[]] * (len(ids) + 3)

        return work

    schema = ", ".join([f"doc {kinds[doc]}", *[f"{c} {kinds[c]}" for c in keep], "dl long, term string, tf long"])
    return map_columns(rows, make, schema)


def corpus_size(df: DataFrame, posted: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length in words."""
    return df.agg(F.count("*").alias("n_docs")).crossJoin(posted.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))).select("n_docs", (F.col("words") / F.col("n_docs")).alias("avg_dl"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def specificity(df: Column, n: Column) -> Column:
    """1 for a word of one document, 0 for one that all have."""
    return F.ln((n + 1) / (df + 1)) / F.ln(n + 1)


def bm25(posted: DataFrame, size: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query, doc, score): every document with a word of the query; each different word of a query counts once.

    ``size`` is the one row of corpus_size, the only side that is broadcast.
    """
    wanted = queries.select("query", "term").distinct()
    terms = wanted.select("term").distinct()
    hit = posted.join(terms, "term", "left_semi")
    weighted = hit.join(document_frequency(hit), "term").crossJoin(F.broadcast(size))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl"))
    weighted = weighted.select("doc", "term", (idf(F.col("df"), F.col("n_docs")) * F.col("tf") * (k1 + 1) / norm).alias("w"))
    return wanted.join(weighted, "term").groupBy("query", "doc").agg(F.sum("w").alias("score"))


def top_k(scores: DataFrame, k: int, by: str = "score", places: int = 6) -> DataFrame:
    """(query, doc, score, rank) of the k best; equal scores (to ``places`` decimals) fall by document."""
    w = Window.partitionBy("query").orderBy(F.round(by, places).desc(), "doc")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class _Block:
    """A block of queries against documents that are read once: for each part of the corpus and each term, which queries have it and what it weighs."""

    CHUNK = 512  # documents whose scores are held at once

    def __init__(self, names: list, weights: dict[tuple, tuple[list[int], float]], lengths: dict):
        self.names, self.lengths = names, lengths
        self.of: dict = {p: {} for p in lengths}
        for (p, term), (queries, w) in weights.items():
            self.of[p][term] = np.array(queries, np.int64), w

    def scores(self, part, texts: list[str]) -> np.ndarray:
        """Queries x documents."""
        out = np.zeros((len(self.names), len(texts)))
        terms, mean = self.of.get(part), self.lengths.get(part)
        if not terms:
            return out
        at: dict[str, tuple[list[int], list[float]]] = {}
        for i, t in enumerate(texts):
            counts = Counter(_words(t))
            fixed = K1 * (1 - B + B * sum(counts.values()) / mean)
            for w in counts.keys() & terms.keys():
                docs, tfs = at.setdefault(w, ([], []))
                docs.append(i)
                tfs.append(counts[w] * (K1 + 1) / (counts[w] + fixed))
        for w in sorted(at):
            queries, weight = terms[w]
            docs, tfs = at[w]
            out[np.ix_(queries, np.array(docs))] += weight * np.array(tfs)
        return out


def _blocks(posted: DataFrame, df: DataFrame, queries: DataFrame, part: str | None, block: int) -> Iterator[_Block]:
    """Blocks of at most about ``block`` queries, cut by a hash; each with the weights of its terms in each part of the corpus. What is collected are a block's terms."""
    by = [part] if part else []
    sizes = df.groupBy(*by).agg(F.count("*").alias("n")).collect()  # one row per part
    words = {tuple(r[c] for c in by): r["w"] for r in posted.groupBy(*by).agg(F.sum("tf").alias("w")).collect()}
    n_docs = {tuple(r[c] for c in by): r["n"] for r in sizes}
    lengths = {(p[0] if p else None): (words.get(p) or 0) / n for p, n in n_docs.items() if n and words.get(p)}
    wanted = keep(queries.select("query", "term").distinct())
    blocks = -(-wanted.select("query").distinct().count() // block)
    for b in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        freq = posted.join(mine.select("term").distinct(), "term", "left_semi").groupBy(*by, "term").agg(F.count("*").alias("df"))
        asked: dict[str, list[int]] = {}
        at: dict = {}
        for r in mine.orderBy("query", "term").toLocalIterator():
            asked.setdefault(r["term"], []).append(at.setdefault(r["query"], len(at)))
        weights = {}
        for r in freq.toLocalIterator():
            p = tuple(r[c] for c in by)
            weights[p[0] if p else None, r["term"]] = asked[r["term"]], float(np.log1p((n_docs[p] - r["df"] + 0.5) / (r["df"] + 0.5)))
        yield _Block(list(at), weights, lengths)


def _scan(df: DataFrame, doc: str, text: Column, part: str | None, block: _Block, make, schema: str) -> DataFrame:
    """Reads every document once; ``make()`` gives (take, flush) of a task: take(part, documents, scores) for each chunk, flush() for its rows at the end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    shared = df.sparkSession.sparkContext.broadcast(block)
    rows = df.select((F.col(part) if part else F.lit(None).cast("string")).alias("p"), F.col(doc).alias("d"), F.lower(F.coalesce(text, F.lit(""))).alias("t"))
    parsed = _parse_datatype_string(schema)
    out = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        take, flush = make(queries)
        for batch in batches:
            parts, docs, texts = (c.to_pylist() for c in batch.columns)
            for p in sorted(set(parts), key=str):
                at = [i for i, x in enumerate(parts) if x == p]
                for start in range(0, len(at), queries.CHUNK):
                    chunk = at[start : start + queries.CHUNK]
                    take(p, [docs[i] for i in chunk], queries.scores(p, [texts[i] for i in chunk]))
        for columns in flush():
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return rows.mapInArrow(run, parsed)


def search(df: DataFrame, doc: str, text: Column, posted: DataFrame, queries: DataFrame, k: int, part: str | None = None, block: int = 4096, places: int = 6, repeated: bool = False) -> DataFrame:
    """(part, query, doc, score, rank): the k documents that BM25 scores best for each query, exhaustively; of equal scores (to ``places`` decimals) the smaller documents.

    Queries (query, term) go round in blocks; each task reads its documents once, scores them against a whole block and keeps k a query, so the shuffle
    holds k rows per query and task instead of all scored pairs. ``posted`` are the postings of the same documents, for frequencies. With ``part``, each
    part of the corpus is searched on its own; without, the column is null. With ``repeated``, a document may have several rows, of which the best counts;
    as what stands above a document in the task of its best row does so everywhere, k different documents a task suffice there too.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (doc, *([part] if part else []))}
    query_kind = queries.schema["query"].dataType.simpleString()
    out = None
    for b in _blocks(posted, df, queries, part, block):

        def make(queries):
            best: dict = {}

            def prune(p):
                q, d, s = (np.concatenate(c) for c in zip(*best[p]))
                shown = np.array(d.tolist())
                order = np.lexsort((shown, -np.round(s, places), q))
                if repeated:
                    code = np.unique(shown, return_inverse=True)[1].astype(np.int64)
                    order = order[np.sort(np.unique((q * (code.max() + 1) + code)[order], return_index=True)[1])]
                q, d, s = q[order], d[order], s[order]
                place = np.arange(len(q)) - np.searchsorted(q, q, "left")
                best[p] = [(q[place < k], d[place < k], s[place < k])]

            def take(p, docs, scores):
                if repeated and len(at := {d: i for i, d in enumerate(sorted(set(docs)))}) < len(docs):
                    column = np.array([at[d] for d in docs])
                    order = np.argsort(column, kind="stable")
                    scores = np.maximum.reduceat(scores[:, order], np.searchsorted(column[order], np.arange(len(at))), axis=1)
                    docs = list(at)
                n = min(k, scores.shape[1])
                shown = np.round(scores, places)
                least = np.partition(shown, -n, axis=1)[:, -n]
                q, i = np.nonzero((shown >= least[:, None]) & (scores > 0))
                if len(q):
                    names = np.empty(len(docs), object)
                    names[:] = docs
                    best.setdefault(p, []).append((q, names[i], scores[q, i]))
                    if sum(len(x[0]) for x in best[p]) > 8 * k * len(queries.names):
                        prune(p)

            def flush():
                for p in best:
                    prune(p)
                    ((q, d, s),) = best[p]
                    yield [[p] * len(q), [queries.names[i] for i in q.tolist()], d.tolist(), s.tolist()]

            return take, flush

        schema = f"part {kinds.get(part, 'string')}, query {query_kind}, doc {kinds[doc]}, score double"
        found = _scan(df, doc, text, part, b, make, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return df.sparkSession.createDataFrame([], f"part {kinds.get(part, 'string')}, query {query_kind}, doc {kinds[doc]}, score double, rank int")
    if repeated:
        out = out.groupBy("part", "query", "doc").agg(F.max("score").alias("score"))
    w = Window.partitionBy("part", "query").orderBy(F.round("score", places).desc(), "doc")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def own_ranks(df: DataFrame, doc: str, text: Column, posted: DataFrame, queries: DataFrame, block: int = 4096, places: int = 6) -> DataFrame:
    """(query, rank): where each query's own document, the one of the same name, stands among all; ties share the middle, documents without a word of the
    query score 0 and share the end.

    Own scores are made first; then each task counts, per query, its documents above them, equal to them and with any score, and only these counts are shuffled.
    """
    kind = queries.schema["query"].dataType.simpleString()
    n_docs = df.count()
    out = None
    for b in _blocks(posted, df, queries, None, block):
        targets = df.join(F.broadcast(df.sparkSession.createDataFrame([(x,) for x in b.names], f"{doc} {kind}")), doc, "left_semi")  # a block's names

        def own(queries):
            at = {x: i for i, x in enumerate(queries.names)}
            found: dict = {}

            def take(_, docs, scores):
                found.update({at[d]: float(np.round(scores[at[d], i], places)) for i, d in enumerate(docs)})

            return take, lambda: [[list(found), list(found.values())]] if found else []

        mine = np.zeros(len(b.names))
        for r in _scan(targets, doc, text, None, b, own, "i int, s double").collect():
            mine[r["i"]] = r["s"]
        sent = df.sparkSession.sparkContext.broadcast(mine)

        def count(queries, sent=sent):
            sums = np.zeros((3, len(queries.names)), np.int64)

            def take(_, docs, scores):
                shown, line = np.round(scores, places), sent.value[:, None]
                sums[0] += (shown > line).sum(1)
                sums[1] += ((shown == line) & (scores > 0)).sum(1)
                sums[2] += (scores > 0).sum(1)

            return take, lambda: [[queries.names, sent.value.tolist(), *sums.tolist()]]

        counts = _scan(df, doc, text, None, b, count, f"query {kind}, mine double, above long, equal long, scored long")
        out = counts if out is None else out.unionByName(counts)
    if out is None:
        return df.sparkSession.createDataFrame([], f"query {kind}, rank double")
    sums = out.groupBy("query", "mine").agg(*[F.sum(c).alias(c) for c in ("above", "equal", "scored")])
    rank = F.when(F.col("scored") == 0, F.lit(float(n_docs))).when(F.col("mine") <= 0, 1 + F.col("above") + (F.lit(n_docs) - F.col("scored") - 1) / 2.0).otherwise(1 + F.col("above") + (F.col("equal") - 1) / 2.0)
    return sums.select("query", rank.alias("rank"))


def fuse(rankings: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query, doc, rank) tables: (query, doc, score, rank)."""
    every = rankings[0].select("query", "doc", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query", "doc", "rank"))
    fused = every.groupBy("query", "doc").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    return top_k(fused, k, places=9)


def key_terms(posted: DataFrame, n_docs: DataFrame, k: int, most_share: float = 0.2) -> DataFrame:
    """(doc, rank, term): the most characteristic words of each document by (1 + ln tf) ln((N+1)/(df+1)).

    Words of at least three letters; words that over ``most_share`` of all documents have count as function words and are left out.
    """
    return key_terms_by(posted, document_frequency(posted), n_docs, k, most_share)


def key_terms_by(posted: DataFrame, frequency: DataFrame, n_docs: DataFrame, k: int, most_share: float = 0.2) -> DataFrame:
    """As key_terms, by document frequencies (term, df) that may come from another corpus; terms that it lacks are left out."""
    words = posted.where(F.regexp_like("term", F.lit(r"^\p{L}{3,}$")))
    freq = frequency.crossJoin(F.broadcast(n_docs.select("n_docs"))).where(F.col("df") <= most_share * F.col("n_docs"))
    scored = words.join(freq, "term").withColumn("w", F.round((1 + F.ln("tf")) * F.ln((F.col("n_docs") + 1) / (F.col("df") + 1)), 6))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("w"), "term")))
    return ranked.where(F.col("rank") <= k).select("doc", "rank", "term")


def common_terms(posted: DataFrame, group: str, docs: DataFrame, share: float, least_docs: int) -> DataFrame:
    """(group, term, df): words that over ``share`` of a group's documents have, in groups of at least ``least_docs``."""
    sizes = docs.groupBy(group).agg(F.count("*").alias("n_group")).where(F.col("n_group") >= least_docs)
    counts = posted.groupBy(group, "term").agg(F.count("*").alias("df"))
    return counts.join(sizes, group).where(F.col("df") > share * F.col("n_group")).select(group, "term", "df")


def reciprocal_rank(ranked: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(query, rr, hit) for every target: 1/rank of the target within k, else 0."""
    t = targets.select("query", F.col("doc").alias("own"))
    best = ranked.where(F.col("rank") <= k).join(t, "query").where("doc = own").groupBy("query").agg(F.min("rank").alias("at"))
    return t.join(best, "query", "left").select("query", F.coalesce(1.0 / F.col("at"), F.lit(0.0)).alias("rr"), F.when(F.col("at") == 1, 1).otherwise(0).alias("hit"))


def graded_measures(ranked: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """(query, mrr, recall, recall_ceiling, ndcg, ap) at k for each query with a judgment; grade 0 is not relevant.

    ``ap`` divides by the smaller of k and the number of relevant documents. Documents judged twice keep their best grade.
    """
    g = grades.groupBy("query", "doc").agg(F.max("grade").alias("grade"))
    ideal = g.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "doc")))
    gain = lambda grade, rank: (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)
    per_query = ideal.groupBy("query").agg(
        F.sum(F.when(F.col("grade") > 0, 1).otherwise(0)).alias("n_rel"), F.sum(F.when((F.col("i") <= k) & (F.col("grade") > 0), gain(F.col("grade"), F.col("i"))).otherwise(0.0)).alias("ideal")
    )
    found = ranked.where(F.col("rank") <= k).join(g, ["query", "doc"]).where("grade > 0")
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("rank")))
    hits = found.groupBy("query").agg(
        F.min("rank").alias("first"), F.count("*").alias("hits"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"), F.sum(F.col("nth") / F.col("rank")).alias("precisions")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return per_query.join(hits, "query", "left").select(
        "query", zero(1.0 / F.col("first")).alias("mrr"), zero(F.col("hits") / F.greatest("n_rel", F.lit(1))).alias("recall"),
        F.least(F.lit(1.0), k / F.greatest("n_rel", F.lit(1))).alias("recall_ceiling"), zero(F.try_divide("dcg", "ideal")).alias("ndcg"),
        zero(F.try_divide("precisions", F.least(F.lit(k), F.col("n_rel")))).alias("ap"),
    )


def shared_key_grades(pool: DataFrame, df: DataFrame, doc: str, strong: list[str], weak: list[str], most_share: float = 0.25, least_shared: int = 2) -> DataFrame:
    """(query, doc, grade) of a judging pool by shared metadata: 3 the document itself, 2 a shared strong key, 1 at least ``least_shared`` weak values, else 0.

    ``pool`` has (query, doc), both documents; ``strong`` are scalar columns, ``weak`` array columns. A weak value of more than ``most_share`` of all documents says
    nothing and is left out. Only pairs of the pool are ever made: a project that has a third of all documents adds none.
    """
    n = df.agg(F.greatest(F.lit(1), F.floor(F.count("*") * most_share)).alias("most"))
    value = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    keys = df.select(F.col(doc).alias("doc"), F.explode(F.array_compact(F.array(*[F.when(value(c).isNotNull(), F.concat(F.lit(f"{c}="), value(c))) for c in strong]))).alias("key")).distinct()
    values = df.select(
        F.col(doc).alias("doc"),
        F.explode(F.array_distinct(F.concat(*[F.transform(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x) != ""), _prefixed(c)) for c in weak]))).alias("key"),
    )
    usable = values.groupBy("key").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).where("n <= most").select("key")
    values = values.join(usable, "key")
    pairs = pool.select("query", "doc").distinct()
    shared = lambda table: pairs.join(table.select(F.col("doc").alias("query"), "key"), "query").join(table, ["doc", "key"]).groupBy("query", "doc").agg(F.count("*").alias("n"))
    weakly = shared(values).where(F.col("n") >= least_shared).select("query", "doc", F.lit(1).alias("grade"))
    strongly = shared(keys).select("query", "doc", F.lit(2).alias("grade"))
    own = pairs.where("query = doc").select("query", "doc", F.lit(3).alias("grade"))
    best = weakly.unionByName(strongly).unionByName(own).groupBy("query", "doc").agg(F.max("grade").alias("grade"))
    return pairs.join(best, ["query", "doc"], "left").select("query", "doc", F.coalesce("grade", F.lit(0)).alias("grade"))


def related_grades(
    df: DataFrame, doc: str, strong: list[str], weak: list[str], queries: DataFrame, most_share: float = 0.25, least_shared: int = 2, lane_docs: int = 2000
) -> DataFrame:
    """(query, doc, grade) of every document that is related to a query's: 3 the document itself, 2 a shared strong key, 1 at least ``least_shared`` weak values.

    ``queries`` has (query), documents of ``df``; keys are as in shared_key_grades. No pair is left out, so the result grows with queries x documents of a key.
    Postings of a key lie in lanes of about ``lane_docs`` documents, so no task holds a hot project. Both sides carry all their keys, and a pair is graded
    where its first shared key joins it: pairs are not shuffled.
    """
    n = df.agg(F.greatest(F.lit(1), F.floor(F.count("*") * most_share)).alias("most"))
    value = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    strongs = [F.array(F.concat(F.lit(f"2{c}="), value(c))) for c in strong]
    weaks = [F.transform(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x) != ""), lambda x, c=c: F.concat(F.lit("1"), _prefixed(c)(x))) for c in weak]
    held = keep(df.select(F.col(doc).alias("doc"), F.explode(F.array_compact(F.concat(*strongs, *weaks))).alias("key")).distinct())
    asked = queries.select("query").where("query IS NOT NULL").distinct()
    wanted = held.join(asked.select(F.col("query").alias("doc")), "doc", "left_semi").select("key").distinct()
    sizes = held.join(wanted, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n))
    usable = sizes.where(F.startswith("key", F.lit("2")) | (F.col("n") <= F.col("most"))).select("key", F.ceil(F.col("n") / lane_docs).alias("lanes"))
    sets = keep(held.join(usable, "key").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("key", "lanes"))).alias("of")).withColumn("keys", F.col("of.key")))
    postings = sets.select("doc", "keys", F.inline("of")).select("doc", F.col("keys").alias("theirs"), "key", F.pmod(F.xxhash64("doc"), "lanes").alias("lane"))
    mine = sets.join(asked.select(F.col("query").alias("doc")), "doc", "left_semi").select(F.col("doc").alias("query"), "keys", F.inline("of"))
    mine = mine.select("query", "keys", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)).alias("lane"))
    met = mine.join(postings, ["key", "lane"]).where("query <> doc").withColumn("shared", F.array_intersect("keys", "theirs")).where(F.col("key") == F.get("shared", F.lit(0)))
    grade = F.when(F.exists("shared", lambda x: F.startswith(x, F.lit("2"))), 2).when(F.size("shared") >= least_shared, 1)
    own = asked.select("query", F.col("query").alias("doc"), F.lit(3).alias("grade"))
    return met.select("query", "doc", grade.alias("grade")).where("grade IS NOT NULL").unionByName(own)


def _prefixed(name: str):
    return lambda x: F.concat(F.lit(f"{name}="), F.lower(F.trim(x)))


def pseudo_queries(posted: DataFrame, size: DataFrame, every: int = 50, terms: int = 5) -> DataFrame:
    """(query, term, i): the best tf-idf words of each document whose number is divisible by ``every``; that document is the target."""
    words = posted.where((F.length("term") > 2) & ~F.regexp_like("term", F.lit("^[0-9]+$")) & ~F.col("term").isin(T.STOP_WORDS))
    asked = words.where(F.col("doc") % every == 0)
    needed = asked.select("term").distinct()
    freq = document_frequency(words.join(needed, "term", "left_semi")).crossJoin(F.broadcast(size))
    scored = asked.join(freq, "term").withColumn("w", F.round(F.col("tf") * idf(F.col("df"), F.col("n_docs")), 6))
    ranked = scored.withColumn("i", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("w"), "term")))
    return ranked.where(F.col("i") <= terms).select(F.col("doc").alias("query"), "term", F.col("i").cast("long").alias("i"))


def term_leakage(queries: DataFrame, posted_field: DataFrame) -> DataFrame:
    """One row: the mean share of a query's words that its own document's field has."""
    has = queries.join(posted_field.select(F.col("doc").alias("query"), "term").withColumn("there", F.lit(1)), ["query", "term"], "left")
    per_query = has.groupBy("query").agg((F.count("there") / F.count("*")).alias("share"))
    return per_query.agg(F.count("*").alias("n_queries"), F.avg("share").alias("leakage"))
