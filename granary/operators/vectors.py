"""Dense vectors: cosine, nearest rows, centroids, coherence.

Nearest rows use the stated query set (ids divisible by a number) against all rows: queries go round in blocks, every block multiplies
whole Arrow batches, and only each batch's best k leave it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.arrow import map_columns


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a side has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def centroids(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """(by..., n, centroid): the mean vector of each group, of unit length. Sums of each dimension are combined before the shuffle."""
    parts = df.where(F.col(vector).isNotNull()).select(*by, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    packed = means.groupBy(*by).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"))  # one entry per dimension
    mean = F.transform("v", lambda p: p["m"])
    length = norm(mean)
    return packed.select(*by, "n", F.transform(mean, lambda x: x / length).alias("centroid"))


def nearest(df: DataFrame, key: str, vector: str, every: int = 50, k: int = 10, most_bytes: int = 128_000_000) -> DataFrame:
    """(query, rank, neighbour, cosine): the k nearest other rows of each row whose key is divisible by ``every``.

    Queries go round in blocks of at most about ``most_bytes``, cut by a hash of the key, so keys need not be dense; a query set within that bound is one
    block and one pass over the rows. Each batch of rows is compared with a block by one matrix product and keeps k candidates per query, so the shuffle holds
    k rows per query and batch. Rows without a vector are left out; equal cosines fall by key.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    asked = rows.where(F.col("k") % every == 0)
    size = asked.agg(F.sum(F.size("v") * 8 + 8).alias("bytes")).first()["bytes"] or 0
    blocks = -(-size // most_bytes)
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).collect()
        if not part:
            continue
        names = np.array([r["k"] for r in part], np.int64)
        q = np.array([r["v"] for r in part]).reshape(len(part), -1)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        sent = df.sparkSession.sparkContext.broadcast((names, q))

        def make(sent=sent):
            names, matrix = sent.value

            def work(keys, vectors):
                x, ids = np.array(vectors), np.array(keys, np.int64)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                sims = matrix @ x.T
                shown = np.round(sims, 9)
                shown[names[:, None] == ids[None, :]] = -np.inf
                least = np.partition(shown, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
                row, col = np.nonzero((shown >= least[:, None]) & np.isfinite(shown))
                # Of equal candidates at the edge, those with the smaller keys stay.
                order = np.lexsort((ids[col], -shown[row, col], row))
                row, col = row[order], col[order]
                place = np.arange(len(row)) - np.searchsorted(row, row, "left")
                row, col = row[place < k], col[place < k]
                return [names[row].tolist(), ids[col].tolist(), sims[row, col].tolist()]

            return work

        near = map_columns(rows, make, "query long, neighbour long, cosine double")
        out = near if out is None else out.unionByName(near)
    if out is None:
        return df.sparkSession.createDataFrame([], "query long, rank long, neighbour long, cosine double")
    w = Window.partitionBy("query").orderBy(F.round("cosine", 9).desc(), "neighbour")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query", "rank", "neighbour", "cosine")


def rank_of_own(df: DataFrame, key: str, query: str, vector: str, every: int = 50, most_bytes: int = 128_000_000) -> DataFrame:
    """(key, rank): where a row's own vector stands when its query vector is compared with all rows, ties sharing the middle; for keys divisible by ``every``.

    Each batch counts, per query, the rows above the own cosine and equal to it; only these counts are shuffled. Rows without a vector are left out.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(query).cast("array<double>").alias("q"))
    asked = rows.where((F.col("k") % every == 0) & F.col("q").isNotNull())
    size = asked.agg(F.sum(F.size("q") * 8 + 16).alias("bytes")).first()["bytes"] or 0
    blocks = -(-size // most_bytes)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).collect()
        if not part:
            continue
        names = [r["k"] for r in part]
        q, own = (unit(np.array([r[c] for r in part]).reshape(len(part), -1)) for c in ("q", "v"))
        sent = df.sparkSession.sparkContext.broadcast((names, q, np.round((q * own).sum(1), 9)))

        def make(sent=sent):
            names, matrix, mine = sent.value

            def work(_, vectors):
                sims = np.round(matrix @ unit(np.array(vectors)).T, 9)
                return [names, (sims > mine[:, None]).sum(1).tolist(), (sims == mine[:, None]).sum(1).tolist()]

            return work

        counts = map_columns(rows.select("k", "v"), make, "k long, above long, equal long")
        out = counts if out is None else out.unionByName(counts)
    if out is None:
        return df.sparkSession.createDataFrame([], f"{key} long, rank double")
    sums = out.groupBy("k").agg(F.sum("above").alias("above"), F.sum("equal").alias("equal"))
    return sums.select(F.col("k").alias(key), (1 + F.col("above") + (F.greatest(F.col("equal"), F.lit(1)) - 1) / 2.0).alias("rank"))


def coherence(df: DataFrame, vector: str, by: str) -> DataFrame:
    """(by, n, mean_pair_cosine): the mean over all pairs of unit vectors, from the length of their sum alone: no pair is built."""
    unit = df.where(F.col(vector).isNotNull()).select(by, F.transform(vector, lambda x: x.cast("double")).alias("v")).withColumn("l", norm(F.col("v"))).where("l > 0")
    parts = unit.select(by, F.posexplode(F.transform("v", lambda x: x / F.col("l"))).alias("i", "x"))
    sums = parts.groupBy(by, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return sums.groupBy(by).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("sq")).where("n > 1").select(by, "n", ((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_pair_cosine"))


def similarity_band(cos: Column) -> Column:
    """0 to 5 points for a cosine mapped to 0..1."""
    s = (cos + 1) / 2
    return F.when(s >= 0.65, 5).when(s >= 0.55, 4).when(s >= 0.45, 3).when(s >= 0.35, 2).when(s > 0, 1).otherwise(0).cast("long")
